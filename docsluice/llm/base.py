"""What the operators share: reading tables, the shared folder, tables between steps, ordered shards."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; a batch is also closed at Spark's own limit of bytes.
ARROW_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver runs it from a checkout.

    On a cluster the package comes with --py-files; the extra path is then simply absent.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and all runs in one process, as in tests, a local one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="docsluice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/docsluice/{what}-{uuid.uuid4().hex}"


def save(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this worker process has freed to the system. A worker serves one task after the other, of all stages
    of a job, and the C library would keep the most that any of them needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def discard(*tables: DataFrame) -> None:
    """Delete tables that save() wrote and that nothing will read again. What depends on one must be saved before."""
    for df in tables:
        path = df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else None
        if path and "/docsluice/" in path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def splitters(df: DataFrame, key: str, shards: int, rows: int, oversample: int = 16) -> list:
    """Boundaries that cut the ordered keys into about `shards` parts of about equal row counts.

    A key is a candidate if its hash says so, hence the boundaries depend on the keys alone, not on
    partitioning or timing, and a rerun cuts alike. About `oversample` candidates a shard reach the
    driver: their number follows the number of output shards, not the number of rows.
    """
    if shards <= 1 or not rows:
        return []
    every = max(1, rows // (shards * oversample))
    found = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(every)) == 0).where(F.col(key).isNotNull()).select(key).distinct().collect()
    keys = sorted(x[0] for x in found)
    step = max(1, len(keys) // shards)
    return keys[step::step][: shards - 1] if len(keys) > shards else keys


def shard_of(key: Column, bounds: list) -> Column:
    """Index of the shard of a key: how many boundaries are at or below it. Null keys are in shard 0."""
    if not bounds:
        return F.lit(0)
    edges = np.array(bounds)

    @F.pandas_udf("int")
    def found(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy().astype(edges.dtype), side="right").astype(np.int32))

    # pandas would turn whole numbers beside nulls into floats, so no null goes in
    return F.when(key.isNull(), F.lit(0)).otherwise(found(F.coalesce(key, F.lit(bounds[0]))))


#: Most ranges of one output, each the work of one task. Beyond it a task writes several files one after the other, so
#: files keep their size, the driver sorts few boundaries, and the one shuffle has no more blocks than Spark can track.
MOST_TASKS = 16_384


def shard_count(total_bytes: int | None, shard_bytes: int) -> int:
    return min(MOST_TASKS, max(1, math.ceil((total_bytes or 0) / shard_bytes)))


def carried(df: DataFrame, id_col: str) -> tuple[Column, str, str]:
    """(column, its type, type to cast back to) of an id on its way through pandas.

    Whole numbers go as strings: beside nulls pandas would make them floats, which are exact up to 2 ** 53 only.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(id_col).cast("string"), "string", kind
    return F.col(id_col), kind, kind


def utf8(column: str) -> Column:
    """The bytes of a text column, null as empty: saves Python a decode and an encode of each text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


#: What tells a row of a table of texts from others: its id and 128 bits of its text.
KEY = ["id", "x", "y"]
#: Values of 8 bytes that may be broadcast; more are joined by shuffle.
BROADCAST_VALUES = 3 << 20


def few(values: int) -> bool:
    return values <= BROADCAST_VALUES


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """id, x, y: equal keys mean equal ids and, but for 128-bit collisions, equal texts (null and empty ones differ)."""
    text = F.col(text_col).cast("string")
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(42), text, F.isnull(text)).alias("y")]


def same_key(prefix: str) -> list[Column]:
    """Join condition of two keys, of which one has a prefix to its names; null ids are equal."""
    return [F.col(k).eqNullSafe(F.col(prefix + k)) for k in KEY]


def among(df: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """The rows of df whose key is among the given (left_semi) or is not (left_anti), columns as they are, whatever their
    names. Few keys are broadcast, so texts stay where they are; many are joined by shuffle."""
    free = "key_"
    while any(c.lower().startswith(free) for c in df.columns):
        free += "_"
    named = keys.toDF(*[free + k for k in keys.columns])
    cond = [a.eqNullSafe(F.col(b)) for a, b in zip(row_key(id_col, text_col), named.columns, strict=True)]
    return df.join(F.broadcast(named) if few(3 * keys.count()) else named, cond, how)
