"""Vector search over stored lists: rows lie in the folder of their nearest centroid.

Centroids are fitted by k-means on a bounded sample of directions; every row is then put into a list, and a list keeps the least similarity of its rows to
the centroid. A search orders the lists by what a row of theirs can reach at most, by the triangle inequality of angles, reads the first ones, and
then, to be exact, all those that can still reach the k-th similarity found; without that second step it is approximate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import vector

#: Lists at most, so that the centroids stay small; rows of the sample for each.
MOST_LISTS, SAMPLE_ROWS = 4096, 64


@dataclass(frozen=True)
class Lists:
    """An opened index: rows by list, and the centroids (unit vectors) with the least similarity and the rows of each."""

    rows: DataFrame
    ids: list[int]
    centres: np.ndarray
    least: np.ndarray
    sizes: np.ndarray


def _assign(centres: np.ndarray, column: str):
    def run(batches):
        for b in batches:
            v = np.array(b.column(column).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, centres.shape[1])
            norm = np.linalg.norm(v, axis=1)
            s = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0) @ centres.T
            best = s.argmax(axis=1)
            found = np.where(norm > 0, best, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(norm > 0, s[np.arange(len(s)), best], 0.0)), pa.array(found.astype(np.int32))], names=[*b.schema.names, "_near", "_list"])

    return run


def build(df: DataFrame, vector_col: str, path: str, lists: int | None = None, seed: int = 1) -> Lists:
    """Write the index of a table under `path`, with all its columns, and open it. lists: the square root of the rows unless given.

    Rows without a vector, or with one of null or non-finite components, are in no list and never found; zero vectors, similar to nothing, have a list of their
    own. All vectors have one length. A list that many rows share is written by several tasks.
    """
    spark, v = df.sparkSession, F.col(vector_col)
    df = df.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    n = df.count()
    k = min(MOST_LISTS, lists or max(1, math.isqrt(n)))
    some = df.where(F.exists(v, lambda x: x != 0)).select(array_to_vector(v.cast("array<double>")).alias("features"))
    share = min(1.0, k * SAMPLE_ROWS / max(1, n))
    some = some.sample(share, seed) if share < 1 else some
    if some.limit(2).count() < 2:
        centres = np.array([x["features"].toArray() for x in some.limit(1).collect()] or np.zeros((1, 1)))
    else:
        centres = np.array(KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10).fit(some).clusterCenters())
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres[norm[:, 0] > 0] / norm[norm > 0][:, None] if norm.any() else np.zeros((1, len(df.select(vector_col).first()[0]) if n else 1))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _near double, _list int"
    put = df.mapInArrow(_assign(centres, vector_col), schema)
    put.hint("rebalance", "_list").write.partitionBy("_list").parquet(f"{path}/rows")
    found = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("_list").agg(F.min("_near").alias("least"), F.count("*").alias("n")) if n else spark.createDataFrame([], "_list int, least double, n long")
    stats = [(r["_list"], centres[r["_list"]].tolist() if r["_list"] >= 0 else [0.0] * centres.shape[1], r["least"], r["n"]) for r in found.collect()]
    spark.createDataFrame(stats, "list int, centre array<double>, least double, n long").coalesce(1).write.parquet(f"{path}/lists")
    return open_index(spark, path, df.schema)


def open_index(spark: SparkSession, path: str, schema) -> Lists:
    rows = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _near double, _list int")
    s = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    table = rows.parquet(f"{path}/rows") if s else spark.createDataFrame([], schema).withColumn("_list", F.lit(0))
    return Lists(table, [r["list"] for r in s], np.array([r["centre"] for r in s]), np.array([r["least"] for r in s]), np.array([r["n"] for r in s]))


def reach(ix: Lists, q: list[float]) -> np.ndarray:
    """The highest similarity that a row of each list can have: the angle to it is at least that to the centroid less the list's widest."""
    x = np.array(q, float)
    size = np.linalg.norm(x)
    if not size or not len(ix.ids):
        return np.zeros(len(ix.ids))
    to = np.arccos(np.clip(ix.centres @ (x / size), -1, 1))
    wide = np.arccos(np.clip(ix.least, -1, 1))
    return np.where(np.array(ix.ids) < 0, 0.0, np.cos(np.maximum(0, to - wide)))


def search(ix: Lists, id_col: str, vector_col: str, q: list[float], limit: int, least: float | None = None, probes: int = 8, exact: bool = True, where: str | None = None) -> DataFrame:
    """(id, similarity, vector_rank) of the nearest rows, as retrieval.vector gives them: `probes` lists whose centroids are nearest, and if exact
    all further ones that can hold a row as near as the k-th. least is inclusive; where: a condition on the table's columns."""

    def near(ids: list[int]) -> DataFrame:
        some = ix.rows.where(F.col("_list").isin(*ids)) if ids else ix.rows.limit(0)
        return vector(some.where(where) if where else some, id_col, vector_col, q, limit, least)

    x = np.array(q, float)
    order = np.argsort(-(ix.centres @ x), kind="stable") if len(ix.ids) else np.zeros(0, int)
    first = [ix.ids[i] for i in order[:probes]]
    if not exact or len(first) == len(ix.ids):
        return near(first)
    found = near(first).collect()
    floor = found[-1]["similarity"] if len(found) == limit else least
    most = reach(ix, q)
    # similarities are rounded to nine digits, angles are exact to fewer than that
    more = [i for i, m in zip(ix.ids, most, strict=True) if i in first or floor is None or m >= floor - 1e-7]
    if len(more) == len(first):
        return ix.rows.sparkSession.createDataFrame(found, "id long, similarity double, vector_rank int")
    return near(more)
