import re

import pytest

from docsluice.llm.repetition import COVERAGE, LEAST_WORDS, LINE_COVERAGE, repetition

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two\nthree"), (5, "a b c d e " * 4), (5, "a b c d e " * 4), (None, "x y\nx y\nx  y\n z é ünï"),
    (7, "# * $ % & | < > ! thin"), (8, LONG), (9, "\n\nsame line here\nsame line here\n\nsame line here"), (10, "x" * 50_000),
    (11, " ".join(f"tok{i}" for i in range(40)) + " " + " ".join(f"tok{i}" for i in range(6))),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    inside = set()
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in where.values():
        if len(at) > 1:
            inside.update(i + k for i in at for k in range(5))
    failed = len(words) < LEAST_WORDS or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def check(rows, texts):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(i), *brute(t)) for i, t in texts)
    assert not any(r.kept and r.base_failed for r in rows)


def test_against_brute_force(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    rows = repetition(df.selectExpr("doc_id", "text", "1 AS kept", "'x' AS n_words")).collect()
    check(rows, TEXTS)


def test_whole_table(spark, sf_dir):
    from docsluice.llm.repetition import op8_repetition_rules

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(op8_repetition_rules(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def verdict(text):
    """Coverage of characters in repeated windows and lines, counted word by word, and what they mean together."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = max(1, sum(map(len, words)))
    out = {}
    for n in COVERAGE:
        where = {}
        for i in range(len(words) - n + 1):
            where.setdefault(tuple(words[i : i + n]), []).append(i)
        inside = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(n)}
        out[f"cover_{n}"] = sum(len(words[i]) for i in inside) / chars
    seen, again = set(), 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in seen:
            again += sum(map(len, own))
        seen.add(line)
    out["cover_lines"] = again / chars
    out["kept"] = not brute(text)[-1] and out["cover_lines"] <= LINE_COVERAGE and all(out[f"cover_{n}"] <= limit for n, limit in COVERAGE.items())
    return out


def test_coverage_and_verdict_against_brute_force(spark, sf_dir):
    """On real texts, with a share of them repeated in part so that every limit decides some rows."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10_000 + i, (t or "") + "\n" + (t or "")[: len(t or "") * (i % 5) // 6]) for i, t in rows]
    got = {r.doc_id: r for r in repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = set()
    for i, t in rows:
        want = verdict(t)
        assert got[i].kept == want["kept"], i
        for k in want:
            assert got[i][k] == pytest.approx(want[k]), (i, k)
        kept.add(want["kept"])
    assert kept == {True, False}


@pytest.mark.parametrize("n", [3, 5, 8, 10])
def test_coverage_counts_characters(spark, n):
    unit = [f"word{i}" for i in range(n)]
    filler = [f"other{i}" for i in range(100)]
    text = " ".join([*unit, *filler, *unit])
    row = repetition(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    share = 2 * sum(map(len, unit)) / sum(len(w) for w in text.split())
    assert row[f"cover_{n}"] == pytest.approx(share)
