import hashlib
import re

import numpy as np
import pytest

from docsluice.llm import mixing as M

TARGETS = {"source": {"a": 0.5, "b": 0.3}, "lang": {"en": 0.6, "de": 0.4}, "topic": {}}


def test_rake_meets_feasible_targets():
    rng = np.random.default_rng(0)
    tokens = {(s, g, M.OTHER): float(rng.integers(500, 1500)) for s in ("a", "b", M.OTHER) for g in ("en", "de")}
    fit = M.rake(tokens, TARGETS, 0.3)
    total = sum(tokens.values())
    p = {c[:3]: c[3] for c in fit.cells}
    assert fit.error < 1e-8 and all(0 <= x <= 1 for x in p.values())
    got = lambda k, x: sum(p[c] * n for c, n in tokens.items() if c[k] == x) / (0.3 * total)
    assert [round(got(0, x), 6) for x in ("a", "b", M.OTHER)] == [0.5, 0.3, 0.2]
    assert [round(got(1, x), 6) for x in ("en", "de")] == [0.6, 0.4]


def test_rake_of_scarce_missing_and_empty_levels():
    scarce = M.rake({("a", "en", M.OTHER): 1.0, ("b", "en", M.OTHER): 1000.0, ("b", "de", M.OTHER): 900.0}, TARGETS, 0.5)
    assert scarce.error > 0.01 and dict((c[:3], c[3]) for c in scarce.cells)[("a", "en", M.OTHER)] == 1
    assert [c[3] for c in M.rake({("a", "en", M.OTHER): 0.0}, TARGETS, 0.5).cells] == [0.0]
    assert M.rake({}, TARGETS, 0.5).cells == []
    one = M.rake({("b", "de", M.OTHER): 10.0}, TARGETS, 0.5)
    assert one.cells[0][3] == pytest.approx(0.5)


ROWS = [(i, f"text {'w ' * (i % 7)}", "ab?"[i % 3], ("en", "de")[i % 2]) for i in range(600)] + [(None, None, None, None), (1, "", "a", "en"), (1, "", "a", "en"), (5000, "x " * 30_000, "a", "de")]


def brute_draw(i):
    return int(hashlib.md5(f"{M.SEED}/{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52


def test_mix_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS weight", "2 AS topic", "3 AS mix0_source")
    got = M.mix(df, targets=TARGETS).collect()
    cell = lambda t, s, g: (s if s in TARGETS["source"] else M.OTHER, g if g in TARGETS["lang"] else M.OTHER, M.OTHER)
    tokens = {}
    for _, t, s, g in ROWS:
        tokens[cell(t, s, g)] = tokens.get(cell(t, s, g), 0) + len(re.findall(r"\S+", t or ""))
    p = {c[:3]: c[3] for c in M.rake(tokens, TARGETS, M.SHARE).cells}
    want = sorted((str(i), len(re.findall(r"\S+", t or "")), round(p[cell(t, s, g)], 9), brute_draw(i) < p[cell(t, s, g)]) for i, t, s, g in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.probability, 9), r.sampled) for r in got) == want
    kept = M.sample(df, targets=TARGETS)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if w[3])


def test_topics_and_empty_table(spark):
    texts = [("MIT Licence terms", "legal"), ("mail a@b.c", "contact"), ("a | b", "data"), ("plain", "general"), (None, "general")]
    df = spark.createDataFrame([(i, t, "s", "en") for i, (t, _) in enumerate(texts)], "doc_id long, text string, source string, lang string")
    assert [r.topic for r in M.mix(df).orderBy("doc_id").collect()] == [x for _, x in texts]
    assert M.mix(df.limit(0)).count() == 0 and M.sample(df.limit(0)).count() == 0


def test_query_covers_every_document(spark, sf_dir):
    assert M.op5_mixture(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_production_targets_keep_null_and_unknown_values(spark):
    rows = [(i, "w " * 50, ("src1", "src2", None, "crawl-9")[i % 4], ("en", "de", None, "it")[i // 4 % 4]) for i in range(1600)]
    df = spark.createDataFrame([*rows, (5000, "", "src3", "fr"), (5001, None, None, "fr")], "doc_id long, text string, source string, lang string")
    got = M.mix(df).collect()
    assert all(r.probability > 0 for r in got)
    taken = [r for r in got if r.sampled]
    total = sum(r.n_tokens * r.probability for r in got)
    share = lambda axis: sum(r.n_tokens * r.probability for r in got if r[axis] == M.OTHER) / total
    assert share("source") == pytest.approx(0.5, abs=1e-6) and share("lang") == pytest.approx(0.5, abs=1e-6)
    assert {(r.source, r.lang) for r in taken} >= {(M.OTHER, M.OTHER), (M.OTHER, "en"), ("src1", M.OTHER)}
    assert {r.doc_id: r.probability for r in got}[5000] == M.SHARE == {r.doc_id: r.probability for r in got}[5001]
    assert {r.doc_id for r in M.sample(df).collect()} == {r.doc_id for r in taken}
    assert {r.probability for r in M.mix(df.where("doc_id >= 5000")).collect()} == {M.SHARE}


def test_rake_against_plain_scaling():
    """Cells scaled axis by axis in plain loops until their marginals hold: the same probabilities."""
    rng = np.random.default_rng(9)
    targets = {"source": {"a": 0.5, "b": 0.3}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.7, "y": 0.3}}
    tokens = {(s, g, t): float(rng.integers(500, 1500)) for s in ("a", "b", M.OTHER) for g in ("en", "de") for t in ("x", "y")}
    want = [{"a": 0.5, "b": 0.3, M.OTHER: 0.2}, {"en": 0.6, "de": 0.4}, {"x": 0.7, "y": 0.3}]
    total = sum(tokens.values())
    cell = {c: n / total for c, n in tokens.items()}
    for _ in range(200):
        for k in range(3):
            for level, target in want[k].items():
                now = sum(v for c, v in cell.items() if c[k] == level)
                for c in cell:
                    if c[k] == level:
                        cell[c] *= target / now
    got = {c[:3]: c[3] for c in M.rake(tokens, targets, 0.25).cells}
    for c in tokens:
        assert got[c] == pytest.approx(0.25 * cell[c] / (tokens[c] / total), rel=1e-6)


def test_targets_that_cannot_be_met_are_reported(spark):
    rows = [(i, "w " * 20, "b", "en") for i in range(200)] + [(1000, "w w", "a", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = M.mix(df, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {}, "topic": {}}).collect()
    assert len({r.error for r in got}) == 1 and got[0].error > 0.1
    assert M.mix(df, targets={"source": {}, "lang": {}, "topic": {}}).first().error == 0
    with pytest.raises(ValueError, match="a target is missed"):
        M.sample(df, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {}, "topic": {}}, most_error=0.01)


def test_rows_without_an_id_draw_by_their_text(spark):
    df = spark.createDataFrame([(None, f"text {i} " * 9, "a", "en") for i in range(400)], "doc_id long, text string, source string, lang string")
    assert 100 < M.sample(df).count() < 300
