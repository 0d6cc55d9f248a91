"""Stored indexes give what scans give, and read less."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsluice.operators import centroids as C
from docsluice.operators import postings as P
from docsluice.operators import retrieval as R
from docsluice.sources.tables import stored

WORDS = [f"w{i}" for i in range(30)]


def some_texts(n, seed=1):
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS[: r.choice([3, 10, 30])]) for _ in range(r.choice([1, 5, 40, 400]))) for _ in range(n)]
    return [(i, t, f"t{i % 3}") for i, t in enumerate([*texts, texts[0], texts[0], "", None, "¿ – ?"])]


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    df = spark.createDataFrame(some_texts(300), "id long, text string, tenant string").repartition(3)
    return df, P.build(df, "id", "text", f"{tmp_path_factory.mktemp('ix')}/p", "tenant", range_docs=20, buckets=8)


@pytest.mark.parametrize("q", ["w0", "w29 w3", "W1 w2, w20 w20", "nothing", "", "w5 nothing"])
@pytest.mark.parametrize(("mode", "every"), [("tf", False), ("tf", True), ("bm25", False), ("bm25", True)])
def test_postings_give_what_a_scan_gives(words, q, mode, every):
    df, ix = words
    for limit in (3, 1000):
        assert P.lexical(ix, q, limit, mode, every).collect() == R.lexical(df, "id", "text", q, limit, mode, every).collect()


def test_postings_of_a_tenant_and_of_all(words):
    df, ix = words
    assert P.lexical(ix, "w1 w9", 7, tenant="t1").collect() == R.lexical(df.where("tenant = 't1'"), "id", "text", "w1 w9", 7).collect()
    want = df.select("tenant", "id", F.size(F.filter(R.tokens("text"), lambda w: w.isin("w1", "w9"))).alias("score")).where("score > 0")
    assert {tuple(r) for r in P.term_counts(ix, "w1 w9").collect()} == {tuple(r) for r in want.collect()}


def test_ranges_that_cannot_reach_the_best_are_left_out_and_bounds_hold(spark, words, tmp_path):
    df, ix = words
    for mode in ("tf", "bm25"):
        by_range, _ = P.bounds(ix, ["w0", "w25"], mode)
        best = P.lexical(ix, "w0 w25", 1000, mode).select(F.pmod(F.xxhash64("id"), F.lit(ix.ranges)).cast("int").alias("range"), "score").groupBy("range").agg(F.max("score").alias("best"))
        assert by_range.join(best, "range").where("best > bound + 1e-9").count() == 0
    plan = P._of_terms(ix, ["w0", "w25"], ["term", "range", "most"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan and "postings" not in plan.split("ReadSchema")[-1]
    # one document far ahead of the others: most ranges are bounded below its score
    ahead = spark.createDataFrame([(i, "x " * (500 if i == 77 else 1) + "y", "t") for i in range(400)], "id long, text string, tenant string")
    far = P.build(ahead, "id", "text", f"{tmp_path}/far", range_docs=10)
    top = P.lexical(far, "x", 1, first=1)
    assert [tuple(r) for r in top.collect()] == [(77, 500.0, 1)]
    assert "blocks" not in top._jdf.queryExecution().toString()  # nothing more is read


def test_postings_of_nothing(spark, tmp_path):
    for k, rows in enumerate([[], [(1, None, "t"), (2, "", "t")]]):
        df = spark.createDataFrame(rows, "id long, text string, tenant string")
        ix = P.build(df, "id", "text", f"{tmp_path}/{k}")
        assert P.lexical(ix, "w1", 5).count() == P.term_counts(ix, "w1").count() == 0


def test_stored_indexes_follow_their_table(spark, tmp_path):
    built = []

    def build(df, path):
        built.append(df.count())
        df.write.parquet(path)

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    a = stored(spark, str(tmp_path), "t", "x", build)
    assert stored(spark, str(tmp_path), "t", "x", build) == a and built == [3]
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert stored(spark, str(tmp_path), "t", "x", build) != a and built == [3, 8]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    centre = r.normal(size=(12, 16)) * 2
    x = [(i, (centre[i % 12] + r.normal(size=16)).tolist(), i % 5) for i in range(900)]
    x += [(900 + i, x[3][1], 1) for i in range(30)] + [(950, [0.0] * 16, 1), (951, None, 1), (952, [float("nan")] * 16, 1)]
    df = spark.createDataFrame(x, "id long, v array<double>, label int").repartition(3)
    return df, x[:930], C.build(df, "v", f"{tmp_path_factory.mktemp('ix')}/v")


def test_lists_give_what_a_scan_gives(vectors):
    df, x, ix = vectors
    whole = df.where("id <= 950")
    assert sum(ix.sizes) == 931 and len(ix.ids) > 10
    for q, least, where in ((x[3][1], None, None), (x[5][1], 0.5, "label = 1"), ([1.0] * 16, None, None), ([0.0] * 16, None, None), ((-np.array(x[9][1])).tolist(), None, None)):
        for limit in (1, 20, 2000):
            got = C.search(ix, "id", "v", q, limit, least, probes=2, where=where).collect()
            assert got == R.vector(whole.where(where or "true"), "id", "v", q, limit, least).collect()


def test_approximate_search_has_a_recall_of_nine_tenths_and_reads_its_lists(vectors):
    df, x, ix = vectors
    v = np.array([r[1] for r in x])
    v /= np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for i in range(0, 900, 60):
        s = v @ v[i]
        got = C.search(ix, "id", "v", x[i][1], 10, exact=False, probes=6)
        hits += sum(s[r["id"]] >= np.sort(s)[-10] - 1e-9 for r in got.collect())
    assert hits >= 0.9 * 150
    assert "PartitionFilters: [_list" in got._jdf.queryExecution().toString()


def test_no_row_is_nearer_than_its_list_can_reach(vectors):
    df, x, ix = vectors
    for q in (x[0][1], [1.0] * 16):
        most = dict(zip(ix.ids, C.reach(ix, q), strict=True))
        for r in ix.rows.select("_list", R.cosine("v", q).alias("s")).groupBy("_list").agg(F.max("s").alias("s")).collect():
            assert r["s"] <= most[r["_list"]] + 1e-9


def test_lists_of_little(spark, tmp_path):
    for k, rows in enumerate([[], [(1, None)], [(1, [0.0, 0.0])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5]):
        df = spark.createDataFrame(rows, "id long, v array<double>")
        ix = C.build(df, "v", f"{tmp_path}/{k}")
        assert C.search(ix, "id", "v", [1.0, 0.0], 3).collect() == R.vector(df.where("v IS NOT NULL"), "id", "v", [1.0, 0.0], 3).collect()
