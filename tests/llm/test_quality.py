import zlib

import numpy as np

from docsluice.llm import quality as Q


def test_features_are_finite_and_features_of_a_text_do_not_depend_on_the_batch():
    texts = [b"", b" \n", "Ünï wörds".encode(), b"a a a a", b"### $$$ a|b", b"x" * 9000, b"one two three\none two three\n"]
    x = Q.features(texts)
    assert x.shape == (len(texts), len(Q.FEATURES)) and np.isfinite(x).all()
    assert np.allclose(x, np.concatenate([Q.features([t]) for t in texts]))


def test_pairs_rank_and_calibrate():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (900, 3)), rng.normal(-1, 1, (100, 3))
    m = Q.fit_pairs(good, bad, 0.9)
    assert (m.score(good)[:, None] > m.score(bad)[None, :]).mean() > 0.95
    assert abs(np.concatenate([m.score(good), m.score(bad)]).mean() - 0.9) < 0.03


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1), (2, None), (None, 0)]):
        m = Q.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        got = [r[0] for r in docs.select(Q.score(m)).collect()]
        assert len(set(got)) == 1 and 0 < got[0] < 1


def test_query_on_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = Q.op3_quality_scores(spark, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) >= 0.95


def test_ids_do_not_matter_for_scores(spark):
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (None, "same text"), (4, None), (5, "")], "doc_id long, text string").selectExpr("*", "1 AS score")
    m = Q.fit_pairs(np.random.default_rng(1).normal(1, 1, (50, len(Q.FEATURES))), np.random.default_rng(2).normal(0, 1, (50, len(Q.FEATURES))), 0.5)
    s = [r[0] for r in docs.select(Q.score(m)).collect()]
    assert s[0] == s[1] == s[2] and s[3] == s[4]


def test_keep_by_quantile(spark):
    good, bad = "Plain words in a row that say something new each time.", "### $$$ ### $$$ &&& ### %%% $$$"
    docs = spark.createDataFrame([(i, good + f" w{i}") for i in range(40)] + [(100 + i, bad + f" w{i}") for i in range(10)], "doc_id long, text string").selectExpr("*", "'k' AS extra")
    labels = docs.selectExpr("doc_id", "int(doc_id < 100) AS quality")
    m = Q.train(docs, labels)
    kept = Q.keep_by_quantile(docs, m, 0.2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    assert sorted(r.doc_id for r in Q.keep_predicted(docs, m).collect()) == list(range(40))
    assert sorted(r.doc_id for r in Q.keep_by_quantile(docs, m).collect()) == list(range(40))
    # the quantile decides alone, above CUT too; at most the level goes, ties in a bin stay together
    few = Q.keep_by_quantile(docs, m, 0.02)
    assert few.count() >= 49 and {r.doc_id for r in few.collect()} >= set(range(40))
    assert Q.keep_by_quantile(docs, m, 0.0).count() == 50 and 5 <= Q.keep_by_quantile(docs, m, 0.9).count()
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, "k"), (1, "", "k"), (1, "", "k"), (None, bad, "k")], "doc_id long, text string, extra string"))
    assert Q.keep_by_quantile(odd, m).columns == docs.columns and Q.keep_by_quantile(docs.limit(0), m).count() == 0
    scores = docs.select(Q.score(m).alias("s"))
    assert Q.quantile(scores, "s", 0.0) <= min(r.s for r in scores.collect())
    assert Q.quantile(scores.limit(0), "s", 0.5) == 1.0
    tied = spark.createDataFrame([(0.11111,)] * 3 + [(0.9,)], "s double")
    assert Q.quantile(tied, "s", 0.5) == 0.1111 and Q.quantile(tied, "s", 0.8) == 0.9
    assert Q.quantile(tied, "s", 0.75) == 0.9 and Q.quantile(tied, "s", 0.74) == 0.1111
    # a quantile above CUT moves with the level
    high = spark.createDataFrame([(0.5 + k / 1000,) for k in range(400)], "s double")
    assert [Q.threshold(high, "s", x) for x in (0.1, 0.25, 0.5)] == [0.54, 0.6, 0.7] and Q.threshold(high, "s") > Q.CUT


def test_threshold_against_plain_loops(spark):
    """The cut is the edge of the bin in which the sorted scores reach the expected share of bad ones."""
    rng = np.random.default_rng(3)
    for high in (0.2, 1.0):
        values = (rng.random(500) * high).round(6).tolist()
        expected = sum(1 - v for v in values) / len(values)
        edges = sorted(int(np.floor(v * Q.BINS)) for v in values)
        want = edges[int(expected * len(values))] / Q.BINS
        assert Q.threshold(spark.createDataFrame([(v,) for v in values], "s double"), "s") == want
    assert Q.threshold(spark.createDataFrame([], "s double"), "s") == 0


def test_repeated_labelled_rows_reach_the_driver_once(spark):
    docs = spark.createDataFrame([(1, "a good text here")] * 500 + [(3, "### $$$")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    one, many = Q.train(docs.dropDuplicates(), labels), Q.train(docs, labels)
    assert np.array_equal(one.weight, many.weight) and one.offset == many.offset


def test_pairs_against_plain_gradient_descent():
    """Bradley-Terry weights by Newton's method are those that plain descent on the same pairs' logistic loss finds."""
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.4, 1, (40, 2)), rng.normal(-0.4, 1, (40, 2))
    m = Q.fit_pairs(good, bad, 0.5)
    a, b = ((x - m.mean) / m.scale for x in (good, bad))
    pairs = [(a[i % 40], b[(i * 7 + 13 * j + i // 40) % 40]) for j in range(Q.PARTNERS) for i in range(40)]
    w = np.zeros(2)
    for _ in range(600):
        g = w.copy()  # the ridge
        for x, y in pairs:
            g -= (x - y) / (1 + np.exp(w @ (x - y))) / Q.PARTNERS
        w -= 0.02 * g
    assert np.allclose(w, m.weight, atol=1e-4)
