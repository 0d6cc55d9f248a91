"""Typed table sources and the tenant guard."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the data folder; Spark prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def own_folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share (spark.checkpoint.dir). Only where a session in one
    process names none, as in tests, it is under the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/docsluice/{uuid.uuid4().hex}"


def version(spark: SparkSession, path: str) -> str:
    """Changes when the files of a table do: names, sizes and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))
    return hashlib.sha256(repr((path, files)).encode()).hexdigest()[:32]


def stored(spark: SparkSession, sf_dir: str, name: str, what: str, build: Callable[[DataFrame, str], object]) -> str:
    """The folder of an index of a table, under the shared one; build(table, folder) makes it where this version of the table has none.

    It is built beside its place and renamed when whole, so an unfinished one is never read; of two builders the first wins.
    """
    path = f"{own_folder(spark).rsplit('/', 1)[0]}/{what}-{version(spark, f'{sf_dir.rstrip("/")}/{name}.parquet')}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        part = f"{path}-{uuid.uuid4().hex}"
        build(table(spark, sf_dir, name), part)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(part), at) and not fs.exists(at):
            raise OSError(f"{path} could not be put in place")
    return path


def for_tenant(df: DataFrame, column: str, tenant: object) -> DataFrame:
    """The rows of one tenant. A missing tenant is an error, never an empty or a full result."""
    if tenant is None:
        raise ValueError(f"{column}: a tenant is required")
    return df.where(F.col(column) == F.lit(tenant))


def namespace_filter(tenant_col: str, tenant: object, doc_col: str | None = None, documents: list | None = None, type_col: str | None = None, chunk_type: str | None = None) -> Column:
    """Tenant always; documents and chunk type where given."""
    if tenant is None:
        raise ValueError("a tenant is required")
    out = F.col(tenant_col) == F.lit(tenant)
    if documents is not None:
        out = out & F.col(doc_col).isin(*documents)
    if chunk_type is not None:
        out = out & (F.col(type_col) == F.lit(chunk_type))
    return out


def reference_data(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of reference data (one document), small enough to join by broadcast if Spark finds it so."""
    return spark.read.option("multiLine", True).json(path)


def html_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_no, row_no, col_no, cell) of the tables in HTML texts: the grid of each, tags dropped, entities undone,
    spaces collapsed. Tables inside tables end the outer one early; null texts have none."""

    def cut(c: Column, pattern: str) -> Column:
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    t = pages.select(F.col(id_col), F.posexplode(cut(F.col(html_col), "(?is)<table[^>]*>.*?</table>")).alias("table_no", "t"))
    r = t.select(id_col, "table_no", F.posexplode(cut(F.col("t"), "(?is)<tr[^>]*>.*?</tr>")).alias("row_no", "r"))
    c = r.select(id_col, "table_no", "row_no", F.posexplode(cut(F.col("r"), r"(?is)<t[dh](?:\s[^>]*)?>.*?</t[dh]>")).alias("col_no", "c"))
    plain = F.regexp_replace("c", "<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return c.select(id_col, "table_no", "row_no", "col_no", F.trim(F.regexp_replace(plain, r"\s+", " ")).alias("cell"))
