"""Aggregates for operations, cost and data-quality reports.

Money is summed as decimals, so results do not depend on the order of rows; every function is one
partial-aggregation shuffle on its own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(c: Column | str, digits: int = 2) -> Column:
    """Exact sum of an amount, as double."""
    return F.coalesce(F.sum(F.col(c).cast(f"decimal(18,{digits})") if isinstance(c, str) else c.cast(f"decimal(18,{digits})")), F.lit(0)).cast("double")


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def status_counts(df: DataFrame, group: list[str], status: str, statuses: dict[str, str], duration: str | None = None, done: str | None = None) -> DataFrame:
    """A count for each named status, the total, and the mean duration of the finished rows (null without any)."""
    cols = [count_where(F.col(status) == v).alias(f"n_{name}") for name, v in statuses.items()]
    if duration:
        at_end = F.when(F.col(status) == done, F.col(duration).cast("decimal(18,2)"))
        cols.append(F.round(F.sum(at_end).cast("double") / F.count(at_end), 4).alias("mean_duration"))
    return df.groupBy(*group).agg(F.count("*").alias("total"), *cols)


def null_rates(df: DataFrame, group: str, column: Column, least: float) -> DataFrame:
    """Share of rows without a value, for the groups above a limit."""
    out = df.groupBy(group).agg(F.count("*").alias("total"), count_where(column.isNull()).alias("missing"))
    return out.withColumn("rate", F.round(F.col("missing") / F.when(F.col("total") != 0, F.col("total")), 6)).where(F.col("rate") > least)


def operation_name(c: Column) -> Column:
    """Report name of an operation; the first rule that fits, else title case."""
    # Fixed rules, in order: substrings, report name.
    rules = [(("embed",), "Embedding"), (("rag", "qa", "answer"), "Q&A"), (("citation",), "Citations"), (("entity", "ner"), "Entities"), (("contradiction",), "Contradictions"), (("timeline", "date"), "Timeline"), (("summary",), "Summary"), (("ocr",), "OCR")]
    low, out = F.lower(c), None
    for words, name in rules:
        cond = None
        for w in words:
            cond = low.contains(w) if cond is None else cond | low.contains(w)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))


def verification_tier(confidence: Column) -> Column:
    """Above 90 optional, above 70 suggested, else required."""
    return F.when(confidence > 90, "optional").when(confidence > 70, "suggested").otherwise("required")


def ocr_quality(c: Column) -> Column:
    return F.when(c >= 0.85, "good").when(c >= 0.70, "fair").otherwise("poor")


def usage_trend(daily: DataFrame, key: str, day: str, amount: str, limit: float, current: DataFrame, as_of: str) -> DataFrame:
    """(key, n_days, trend, exhausted): trend of daily usage, and the day on which the daily limit would be used up.

    trend: mean of the later half of the days against the earlier one, with a tenth to either side as stable; fewer than four
    days are stable. exhausted: as_of plus what the day's own usage, `current` (key, used), leaves of the limit over the mean of a
    day; as_of itself if it leaves nothing; null for a mean of nothing, beyond a year, or without a limit, which gives no trend either.
    """
    if not limit:
        return daily.groupBy(key).agg(F.count("*").alias("n_days")).select(key, "n_days", F.lit("stable").alias("trend"), F.lit(None).cast("date").alias("exhausted"))
    w, all_days = Window.partitionBy(key).orderBy(day), Window.partitionBy(key)
    d = daily.select(key, F.row_number().over(w).alias("i"), F.count("*").over(all_days).alias("n"), F.col(amount).alias("x"))
    first = F.col("i") <= F.floor(F.col("n") / 2)
    out = d.groupBy(key).agg(F.max("n").alias("n_days"), F.avg(F.when(first, F.col("x"))).alias("a"), F.avg(F.when(~first, F.col("x"))).alias("b"), F.avg("x").alias("mean"))
    trend = F.when(F.col("n_days") < 4, "stable").when(F.col("b") > F.col("a") * 1.1, "increasing").when(F.col("b") < F.col("a") * 0.9, "decreasing").otherwise("stable")
    out = out.join(current, key, "left").withColumn("left", F.lit(limit) - F.coalesce("used", F.lit(0)))
    days = F.col("left") / F.col("mean")
    moment = F.to_timestamp(F.lit(as_of))
    later = F.to_date(F.timestamp_micros(F.unix_micros(moment) + F.round(days * 86_400_000_000).cast("long")))
    exhausted = F.when(F.col("mean") > 0, F.when(F.col("left") <= 0, F.to_date(moment)).when(days <= 365, later))
    return out.select(key, "n_days", trend.alias("trend"), exhausted.alias("exhausted"))


def eta_range(pages: Column, seconds_a_page: Column, workers: Column, samples: Column) -> list[Column]:
    """best, least and most seconds, whole and 30 at least; the fewer samples the wider."""
    best = pages * seconds_a_page / F.greatest(workers, F.lit(1))
    wide = F.when(samples >= 10, 1.3).when(samples >= 5, 1.5).otherwise(2.0)
    floor = lambda c: F.greatest(F.floor(c), F.lit(30)).cast("long")
    return [floor(best).alias("best"), floor(best / wide).alias("least"), floor(best * wide).alias("most")]
