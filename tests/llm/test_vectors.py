"""Operators 11 to 13 against brute force, with nulls, ties, repeats, empty tables and odd components."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docsluice.llm import hnsw, rtree, vectors, whitening

KIND = "vec_id long, embedding array<float>, label int, rank string"
NAN, INF = float("nan"), float("inf")
ODD = [(None, [1.0, 2.0], 1, "x"), (1000, None, 1, "x"), (1100, [None, 1.0], 1, "x"), (1200, [NAN, 1.0], 1, "x"), (1300, [INF, 1.0], 1, "x"), (1400, [], 1, "x")]


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def random_rows(n, dim, seed, groups=4):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dim))
    return [(i, (centre[i % groups] + r.normal(size=dim)).astype(np.float32).tolist(), int(r.integers(0, 3)), None) for i in range(n)]


def nearest(rows, k, every):
    """(query, rank, id, score) by plain loops."""
    ok = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for q, a in ok:
        if q % every == 0:
            x = np.array(a, float)
            found = sorted((-float(x @ np.array(b, float) / (np.linalg.norm(x) * np.linalg.norm(b))), i) for i, b in ok if i != q and len(a) == len(b))
            out |= {(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(found[:k])}
    return out


def as_set(df, *cols):
    return {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()}


def test_neighbours_of_odd_rows_and_ties_are_those_of_brute_force(spark):
    rows = [
        *ODD, (1500, [0.0, 0.0], 1, "zero"), *[(i, [1.0, 2.0], 1, "x") for i in range(0, 60, 2)], (0, [1.0, 2.0], 1, "again"), (7, [2.0, 1.0], 1, "x"), (8, [-1.0, 1e-30], 1, "x"), (9, [3e38, 3e38], 1, "big"),
        (50, [1.0, 0.0, 0.0], 1, "other length"), (61, [2.0, 0.0, 1.0], 1, "other length"), (100, [1.0], 1, "alone"),
    ]
    df = table(spark, rows)
    got = hnsw.neighbours(hnsw.index(df, shard_rows=8), df.where("vec_id % 10 = 0"))
    assert as_set(got, "query_id", "rank", "vec_id", "score") == nearest(rows, 5, 10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_few_rows_give_all_of_them_and_empty_tables_none(spark):
    df = table(spark, [(0, [1.0, 0.0], 1, None), (1, [0.0, 1.0], 1, None)])
    assert as_set(hnsw.neighbours(hnsw.index(df), df), "query_id", "rank", "vec_id") == {(0, 1, 1), (1, 1, 0)}
    none = df.limit(0)
    assert hnsw.neighbours(hnsw.index(none), df).count() == hnsw.neighbours(hnsw.index(df), none).count() == 0


def test_recall_in_shards_and_in_blocks_of_queries(spark):
    rows = random_rows(3000, 32, 1)
    df = table(spark, rows).repartition(5)
    want = {(q, i) for q, _, i, _ in nearest(rows, 5, 50)}
    for shard_rows, block_rows in ((400, 1 << 16), (8192, 17)):
        got = hnsw.neighbours(hnsw.index(df, shard_rows=shard_rows), df.where("vec_id % 50 = 0"), block_rows=block_rows)
        assert got.groupBy("query_id").count().where("count <> 5").count() == 0
        assert len(want & as_set(got, "query_id", "vec_id")) >= 0.95 * len(want)


def test_recall_on_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = {(q, i) for q, _, i, _ in nearest([tuple(r)[:2] for r in df.select("vec_id", "embedding").collect()], 5, 50)}
    assert len(want & as_set(hnsw.op11_hnsw_neighbours(spark, sf_dir), "query_id", "vec_id")) >= 0.9 * len(want)


def test_a_graph_reaches_all_its_nodes_and_bounds_its_lists():
    x = np.random.default_rng(3).normal(size=(900, 6))
    x[300:600] = x[0] + 1e-4 * x[300:600]  # a group of near copies far from the rest
    p = hnsw.unit(x)
    links = hnsw.build(p)
    assert hnsw.reached(links[0]).all()
    assert [len(v) for v in links] == sorted((len(v) for v in links), reverse=True)
    for v in links:
        rows = [r[r >= 0].tolist() for r in v]
        assert all(len(set(r)) == len(r) and i not in r and max(r, default=0) < len(v) for i, r in enumerate(rows))
    assert (np.sort(hnsw.search(p, links, p[:50], 40)[1], axis=1)[:, -1] > 1 - 1e-5).all()


def negatives(df):
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding", "label").toArrow())
    return {tuple(r.values()) for r in con.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({rtree.SQL})").to_arrow_table().to_pylist()}


@pytest.mark.parametrize("shard_rows", [10, 150, 16_384])
def test_hard_negatives_are_those_of_sql(spark, shard_rows):
    rows = random_rows(400, 5, 2) + [(i, random_rows(1, 3, i)[0][1], i % 2, None) for i in range(400, 430)]
    rows += [(500 + i, [0.5, 0.25, 1.0, 0.0, 0.0], i % 3, None) for i in range(40)]  # ties
    rows += [(600 + i, [-0.5, 0.0, 0.0, 0.0, 0.0], 5, None) for i in range(2)] + [(700, [0.0] * 5, 1, None), (701, [0.0] * 5, 1, None), (800, [1.0] * 5, None, None)]
    rows += [rows[0], rows[100], *ODD]
    df = table(spark, rows)
    part = vectors_saved(df)
    got = rtree.hard_negatives(part, part.where("id % 100 = 0"), shard_rows=shard_rows, block_rows=3)
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == cols
    # the SQL moves the label of every seventh id
    assert as_set(got, *cols) == negatives(df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 9) % 10).otherwise(F.col("label")))) != set()


def vectors_saved(df):
    from docsluice.llm.base import save

    return save(rtree.taking_part(df), "rows")


def test_scores_beyond_doubles_and_beyond_longs_and_empty_tables(spark):
    big = [(100, [1e7, 3e6], 1, None), (1, [1e7, 3e6], 1, None), (2, [7e6, 3e6], 2, None), (3, [7e6, 3e6 + 1], 2, None)]
    df = table(spark, big)
    part = vectors_saved(df)
    got = rtree.hard_negatives(part, part.where("id % 100 = 0"))
    x = [[math.floor(256 * c) for c in np.array(v, np.float32).tolist()] for _, v, *_ in big]
    score = [sum(a * b for a, b in zip(x[0], y, strict=True)) for y in x]
    assert score[0] > 2**53 and as_set(got, "positive_id", "rank", "negative_id", "positive_score", "negative_score") == {(1, 1, 3, score[1], score[3]), (1, 2, 2, score[1], score[2])}
    more = vectors_saved(table(spark, [(100, [1e8, 3e7], 1, None), (1, [1e8, 3e7], 1, None)]))
    with pytest.raises(Exception, match="too (large|big)"):
        rtree.hard_negatives(more, more).count()
    assert rtree.hard_negatives(part.limit(0), part.limit(0)).count() == rtree.hard_negatives(part, part.limit(0)).count() == 0


def test_boxes_prune_rows_that_cannot_count():
    r = np.random.default_rng(5)
    x, label = r.integers(-100, 100, (4096, 2)), r.integers(0, 2, 4096)
    order = rtree.tile(x, label)
    assert sorted(order.tolist()) == list(range(4096))
    x, label = x[order], label[order]
    boxes = rtree.levels(x, label)
    flat = {k: np.concatenate([b[i].ravel() for b in boxes]) for i, k in enumerate(("lo", "hi", "first", "last"))}
    tree = {"dim": 2, "x": x.ravel(), "ids": np.arange(4096), "labels": label, "sizes": np.array([len(b[0]) for b in boxes])} | flat
    anchors, best = x[:20], rtree.Best(20, 3)
    everything = np.arange(20)[:, None], np.full((20, 1), 1000), np.full((20, 1), 9000)
    opened = rtree.best_first(tree, anchors, lambda first, last: np.ones((20, len(first)), bool), lambda who, rows: np.ones(rows.shape, bool), best, *everything)
    for a in range(20):
        s = x @ anchors[a]
        want = sorted((-v, i) for i, v in enumerate(s.tolist()) if 1000 <= v <= 9000)[:3]
        assert [(-v, i) for v, i, t in zip(best.scores[a], best.ids[a], best.there[a], strict=True) if t] == want
    assert opened < 20 * 4096 / rtree.LEAF / 4  # a fourth of the leaves at most


def plain(rows, k=4):
    """The rows that take part, and the fit, by numpy's own eigenvectors."""
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in ok}))
    cov = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(cov)
    return ok, fit, e[::-1][:k], u[:, ::-1][:, :k], np.trace(cov)


def test_whitening_is_that_of_plain_eigenvectors(spark):
    r = np.random.default_rng(9)
    rows = [(i, (3 + r.normal(size=6) * [5, 3, 2, 1.5, 1, 0.5]).astype(np.float32).tolist(), 0, None) for i in range(300)]
    rows += [rows[5]] * 3 + [(900 + i, rows[7][1], 0, None) for i in range(50)] + [(None, rows[8][1], 0, None), (1, [1.0, 2.0], 0, "other length")]
    odd = [(i, v and [*v, *([1.0] * 4)] if v else v, x, y) for i, v, x, y in ODD[1:]]
    got = whitening.whiten(table(spark, rows + odd).repartition(7)).collect()
    ok, fit, e, u, trace = plain(rows[:-1])
    n, s = len(fit), fit.sum(axis=0)
    assert len(got) == 4 * len(ok) and {r["n"] for r in got} == {n}
    sign = {}
    want = {}
    for i, v in ok:
        want.setdefault(i, (((n * np.array(v) - s) ** 2).sum(), (np.array(v) - s / n) @ u / np.sqrt(e)))
    first = {r["component"]: r for r in got if r["vec_id"] == 0}
    for c in range(1, 5):
        sign[c] = np.sign(first[c]["whitened"] * want[0][1][c - 1])
    for g in got:
        dev, w = want[g["vec_id"]]
        assert g["deviation"] == dev and abs(g["whitened"] * sign[g["component"]] - w[g["component"] - 1]) < 1e-9
        assert abs(g["explained"] - e[g["component"] - 1] / trace) < 1e-12 and g["identity_error"] < 1e-9


def test_whitening_of_little_and_of_large_numbers(spark):
    assert whitening.whiten(table(spark, [])).count() == whitening.whiten(table(spark, ODD[1:])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 1, None)] * 4)).count() == 0
    two = whitening.whiten(table(spark, [(1, [1.0, 2.0], 1, None), (2, [3.0, 4.0], 1, None)])).collect()
    assert {(g["vec_id"], g["component"], g["n"], round(abs(g["whitened"]), 9)) for g in two} == {(1, 1, 2, 1.0), (2, 1, 2, 1.0)}
    big = whitening.whiten(table(spark, [(i, [1e12 * i, -1e13 * i * i, 5.0], 1, None) for i in range(6)])).collect()
    assert {g["deviation"] for g in big} == {None} and max(g["identity_error"] for g in big) < 1e-6


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigenvectors_of_clusters_and_of_split_matrices(n):
    r = np.random.default_rng(n)
    q = np.linalg.qr(r.normal(size=(n, n)))[0]
    for values in (np.ones(n), np.r_[np.full(min(3, n), 2.0), r.random(max(0, n - 3))], 10.0 ** -np.arange(n), r.random(n) + 1):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        for m in (a, np.diag(values)):
            e, u = whitening.principal(m, 4)
            want = np.sort(values)[::-1][:4]
            want = want[want > 8 * n * whitening.EPS * values.sum()]
            assert len(e) == len(want) and np.allclose(e, want, rtol=0, atol=1e-14 * values.sum())
            assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
            assert np.abs(m @ u - u * e).max() < 1e-13 * max(1, values.sum())


def test_exact_products_of_any_size():
    for reach in (10, 2**20, 2**31, 2**40):
        y = np.random.default_rng(1).integers(-reach, reach, (50, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whitening.exact_products(y).tolist() == want


def test_fixed_point_and_usable(spark):
    df = spark.createDataFrame([([-0.001, 0.5],), ([1e300, 0.0],), (None,), ([],), ([None],), ([NAN],)], "v array<double>")
    got = df.select(vectors.usable(F.col("v")).alias("u"), vectors.fixed_point(F.col("v")).alias("x")).collect()
    assert [r["u"] for r in got] == [True, True, False, False, False, False]
    assert [got[0]["x"], got[1]["x"]] == [[-1, 128], None]
