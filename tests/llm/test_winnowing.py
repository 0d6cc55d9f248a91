import hashlib
import re

import pytest

from docsluice.llm import base
from docsluice.llm import winnowing as N


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(doc, items):
    w = words(doc)
    hit, found = set(), set()
    for item, text in items:
        iw = words(text)
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item) if item is not None else "null")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEM = " ".join(f"b{i}" for i in range(30))
ITEMS = [(1, ITEM), (2, "short item here"), (3, None), (4, ""), (5, "the the the the the the the the the the the the"), (6, ITEM), (None, "nine words one two three four five six seven"), (10, "É Ünï-ß 日本 five six seven eight nine ten eleven"), (11, "uniqueword")]
DOCS = [
    (1, None), (2, ""), (3, " ".join(ITEM.split()[:10])), (4, " ".join(ITEM.split()[:9])), (5, "x " + ITEM.upper() + " y"), (5, "x " + ITEM.upper() + " y"),
    (None, "a short, ITEM. here b"), (7, "the " * 30), (8, "É Ünï-ß 日本 five six seven eight nine ten eleven"), (9, " ".join(f"w{i}" for i in range(30_000)) + " " + " ".join(ITEM.split()[7:19])),
    (10, "pre " + ITEM.replace("b14", "zz") + " post"), (11, "a uniqueword b uniqueword"), (12, "nine\nwords one two  three four; five six seven"), (13, "b0 b1 b2 b3 b4 " + ITEM),
]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_against_brute_force(spark, monkeypatch, most):
    """With and without what tasks hold to drop fingerprints early, by broadcast and by shuffle."""
    monkeypatch.setattr(N, "MOST_KNOWN", most)
    monkeypatch.setattr(base, "BROADCAST_VALUES", most)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "0 AS spans", "1 AS n_hit")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in N.contamination(docs, items).collect())
    assert got == sorted((i or 0, *brute(t, ITEMS)) for i, t in DOCS)
    kept = N.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in DOCS if not brute(t, ITEMS)[-1])


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert N.contamination(docs, none).where("contaminated").count() == 0
    assert N.contamination(docs.limit(0), none).count() == 0
    assert N.without_contaminated(docs, none).count() == len(DOCS)


def test_every_shared_span_is_found(spark):
    import random

    random.seed(3)
    item = [f"i{k}" for k in range(40)]
    rows, want = [], {}
    for k in range(200):
        a = random.randrange(31)
        n = random.randrange(10, 41 - a)
        text = [f"d{random.randrange(50)}" for _ in range(random.randrange(30))] + item[a : a + n] + [f"d{random.randrange(50)}" for _ in range(5)]
        rows.append((k, " ".join(text)))
        start = len(text) - 5 - n
        want[k] = [(start, start + n)]
    out = N.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("q", " ".join(item))], "item_id string, text string"))
    assert {r.doc_id: [tuple(x) for x in r.spans] for r in out.collect()} == want


def test_one_word_many_times_is_linear(spark):
    """Equal words give one fingerprint at every place; places are counted, not their pairs."""
    docs = spark.createDataFrame([(1, "the " * 200_000), (2, "the " * 9)], "doc_id long, text string")
    out = {r.doc_id: r for r in N.contamination(docs, spark.createDataFrame([(1, "the " * 20_000), (2, "the " * 10)], "item_id long, text string")).collect()}
    assert out[1].n_hit == 200_000 and out[1].n_items == 2 and not out[2].contaminated
