"""Stateful operators on event time. Each has a batch form and a streaming form over the same columns.

The streaming forms keep state by key with a watermark, so state is dropped once it can no longer change.
Processing-time rules of interactive systems are stated on event time here: results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsluice.functions.fixed import PRONOUNS


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table folder as a file stream with the table's schema."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(path[:-1] + "[" + path[-1] + "]")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, with a checkpoint of its own, and read what it wrote."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def sessions(df: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Runs of events of a key with less than the gap between neighbours. Works on a stream with a watermark too."""
    return df.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def windowed_counts(df: DataFrame, at: str, key: str, size: str, late: str) -> DataFrame:
    """Counts in tumbling windows; a window is final once the watermark has passed its end."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def carried(key: str, order: list[str], value: Column) -> Column:
    """The last value that is not null before each row of its key. order must tell all rows of a key apart."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(w)


def referent(pronoun: str, key: str, order: list[str], kind: Column, mention: Column) -> Column:
    """What a pronoun means at each row: the last mention before it of a kind that the pronoun may stand for; any kind
    for they and for words that are no known pronoun."""
    kinds = PRONOUNS.get(pronoun.lower())
    return carried(key, order, F.when(F.lower(kind).isin(*kinds), mention) if kinds else mention)


def recover_stale(df: DataFrame, status: str, since: str, attempts: str, as_of: str, minutes: int, most: int) -> DataFrame:
    """Processing longer than `minutes` at as_of: queued again with one more attempt, failed after `most`."""
    stale = (F.col(status) == "P") & (F.col(since) < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTE"))
    again = F.col(attempts) < most
    return df.withColumns({"next_status": F.when(stale & again, "O").when(stale, "X").otherwise(F.col(status)), "next_attempts": F.when(stale & again, F.col(attempts) + 1).otherwise(F.col(attempts))})
