"""Sinks and table merges. Parquet tables are not updated in place: a merge is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append to a table, in folders by the given columns; every task writes its own files."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def split_plan(df: DataFrame, pages: str, size: int) -> DataFrame:
    """A row for each range of `size` pages (1-based, ends included)."""
    start = F.explode(F.sequence(F.lit(1).cast("long"), F.col(pages), F.lit(size).cast("long")))
    out = df.withColumn("page_start", start)
    return out.withColumn("page_end", F.least(F.col("page_start") + size - 1, F.col(pages)))


def merge_counts(old: DataFrame, new: DataFrame, key: str, count: str) -> DataFrame:
    """Counts by key plus the number of new rows of each key. New rows are counted before they meet the old."""
    added = new.groupBy(key).agg(F.count("*").alias(count))
    return old.select(key, count).unionByName(added).groupBy(key).agg(F.sum(count).alias(count))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in the order; a maximum of structs, so partly done before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def get_or_create(have: DataFrame, asked: DataFrame, key: str, *new: Column) -> DataFrame:
    """The rows there are, and a row for each asked key that has none."""
    missing = asked.select(key).distinct().join(have, key, "left_anti").select(key, *new)
    return have.unionByName(missing)


def coalescing_update(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where they are not null, else the old ones."""
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(n, key, "left").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])
