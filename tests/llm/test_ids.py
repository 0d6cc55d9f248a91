"""Ids past 2 ** 53 stay exact beside null ids, in every operator that hands them to Python."""

from docsluice.llm import repetition, tokens, warc, winnowing
from docsluice.llm.base import shard_of

BIG = 2**62 + 1
ROWS = [(BIG, "a b c"), (None, "x y"), (BIG + 2, "z " * 200), (BIG + 4, "z " * 200)]
IDS = [None, BIG, BIG + 2, BIG + 4]


def ids(df):
    return sorted((r[0] for r in df.collect()), key=lambda x: x or 0)


def test_large_ids_beside_null_ones(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    assert ids(repetition.repetition(df)) == IDS
    items = spark.createDataFrame([("i", "x y")], "item_id string, text string")
    found = winnowing.contamination(df, items)
    assert ids(found) == IDS and found.schema[0].dataType == df.schema[0].dataType
    assert ids(tokens.write_and_read(df)) == IDS
    pages = df.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    path = f"file://{tmp_path}/warc"
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_warc(warc.write_warc(pages, path), path).collect()}
    assert got == {None: ("response", None), BIG: ("response", None), BIG + 2: ("response", None), BIG + 4: ("revisit", BIG + 2)}


def test_shards_of_large_ids(spark):
    df = spark.createDataFrame([(BIG,), (None,), (BIG + 1,)], "i long").coalesce(1)
    assert {r.i: r.s for r in df.select("i", shard_of(df.i, [BIG + 1]).alias("s")).collect()} == {BIG: 0, None: 0, BIG + 1: 1}


def test_ids_keep_their_type(spark):
    for kind in ("int", "string"):
        df = spark.createDataFrame(ROWS[:2], "doc_id long, text string").selectExpr(f"CAST(doc_id % 1000 AS {kind}) AS doc_id", "text")
        assert repetition.repetition(df).dtypes[0] == ("doc_id", kind)
        assert {r[0] for r in repetition.repetition(df).collect()} == {r[0] for r in df.collect()}
