import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from docsluice.llm import mixing, tokens
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_winnowing import brute as brute_contamination


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A data folder with a few documents of every kind that a stage must decide on."""
    words = lambda s, n: " ".join(f"{s}{chr(97 + (i * 7) % 26)}{chr(97 + i // 26)}{chr(97 + (i * 3) % 26)}" for i in range(n))
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew potions quietly"
    good = [(i, f"A plain text number {words(f'w{i}', 80)}. It goes on here.", "en", f"src{i % 4}", 0) for i in range(60)]
    bad = [(100 + i, " ".join(f"x{i}$$$ &&& ###" for _ in range(60)), "en", "src1", 0) for i in range(25)]
    near = [(200 + i, good[3][1], "de", "src2", 0) for i in range(5)]
    leak = [(300 + i, f"{words(f'z{i}', 40)} {item} {words(f'y{i}', 40)}", "fr", "src3", 0) for i in range(4)]
    docs = [*good, *bad, *near, *leak]
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}", docs, [(1, item)]


def test_stages_against_brute_force(spark, small):
    folder, docs, items = small
    df = spark.read.parquet(f"{folder}/documents.parquet")
    f = dict(C.STAGES)
    kept = f["quality classifier"](spark, df, folder)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, *_ in docs if not 100 <= i < 200}

    text = {i: t for i, t, *_ in docs}
    kept = f["SimHash near-dedup"](spark, kept, folder)
    groups = brute_components({i: brute_print(text[i]) for i in ids})
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(groups.values())

    kept = f["benchmark decontamination"](spark, kept, folder)
    want = {i for i in set(groups.values()) if not brute_contamination(text[i], items)[-1]}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want and not any(300 <= i < 400 for i in want)

    mixed = f["mixing to target weights"](spark, kept, folder)
    p = {r.doc_id: r.probability for r in mixing.mix(kept).collect()}
    import hashlib

    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}/{i}".encode()).hexdigest()[:13], 16) / 2**52
    chosen = sorted(i for i in want if draw(i) < p[i])
    assert mixed.columns == df.columns and sorted(r.doc_id for r in mixed.collect()) == chosen and chosen

    from tests.llm.test_tokens import library

    out = sorted(tuple(r) for r in f["token binary output"](spark, mixed, folder).collect())
    at, rows = 0, []
    for i in chosen:
        got = library(text[i]) + [tokens.END_ID]
        rows.append((i, at, len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
        at += len(got)
    assert out == rows
    assert sorted(tuple(r) for r in C.run(spark, folder).collect()) == rows


def test_shape(spark, sf_dir):
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None
    out = C.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_stages_on_empty_and_null_rows(spark, small):
    folder, docs, _ = small
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS score", "2 AS p")
    for name, f in C.STAGES[:-1]:
        assert f(spark, df.limit(0), folder).count() == 0, name
        assert f(spark, df, folder).columns == df.columns, name
    assert C.STAGES[-1][1](spark, df, folder).count() == 4
