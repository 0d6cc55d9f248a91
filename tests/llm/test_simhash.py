import re

import numpy as np
import pytest
import xxhash

from docsluice.llm import base
from docsluice.llm import overlap as O
from docsluice.llm import simhash as S
from docsluice.llm.components import components


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, radius=2):
    """prints: id -> fingerprint."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


TEXTS = ["", None, " \n", "One", "one", "one two", "ONE TWO three", "É é Ünï x y", "a b c d e f g", "a b c d e f g", "word " * 40_000, "tail", "tail\ttail  tail"]


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_fingerprint(text):
    assert S.simhash(text.encode()) % 2**64 == brute_print(text)


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(5)
    ms = [m % 2**64 for m in S.masks()]
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
        assert any(a & m == b & m for m in ms)


def dense(seed, n):
    rng = np.random.default_rng(seed)
    out = {int(x) for x in rng.integers(0, 2**63, n // 3)}
    seeds = sorted(out)
    while len(out) < n:
        x = seeds[int(rng.integers(len(seeds)))] if rng.random() < 0.3 else sorted(out)[int(rng.integers(len(out)))]
        for _ in range(int(rng.integers(1, 4))):
            x ^= 1 << int(rng.integers(64))
        out.add(x)
    return sorted(out)


def groups(pairs, members):
    return sorted(sorted(m for m in members if pairs[m] == r) for r in set(pairs.values()))


def test_tree_finds_what_brute_force_finds():
    prints = np.array(dense(1, 400), dtype=np.uint64)
    root = np.zeros(len(prints), dtype=np.int64)
    q, n = S.near(prints, root, S.grow(prints, root), 2, 0, len(prints))
    want = {(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert want and set(zip(q.tolist(), n.tolist())) == want


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_links_of_shards_and_batches(spark, batch):
    values = dense(2, 300)
    signed = [x - 2**64 if x >> 63 else x for x in values]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    links = S.print_links(spark.createDataFrame([(x,) for x in signed], "p long"))
    got = {r.node % 2**64: r.root % 2**64 for r in components(links).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    want = brute_components({x: x for x in values})
    assert groups({x: got.get(x, x) for x in values}, values) == groups(want, values)


def test_near_duplicates_and_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, base), (101, base + " end"), (102, base), (102, base), (None, base), (7_000, base.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS p", "2 AS component_id", "3 AS c")
    got = S.near_duplicates(df.select("doc_id", "text", "p")).collect()
    want = brute_components({i: brute_print(t) for i, t in rows if i is not None})
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got if r.doc_id is not None} == {(i, brute_print(t), want[i]) for i, t in rows if i is not None}
    assert [r.component_id for r in got if r.doc_id is None] == [want[100]]
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 0  # a copy of row 100 goes, also without an id


def test_keep_one_decides_for_each_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(0, b, "p"), (1, a, "q"), (1, b, "r"), (2, a, "s"), (None, c, "t"), (None, c, "t"), (None, a, "u"), (3, c + "".join(f" v{i}" for i in range(60)), "v"), (4, None, "w"), (4, None, "w"), (None, None, "w"), (5, "  ", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, g string").selectExpr("*", "1 AS id", "2 AS root", "map('k', g) AS `a.b`")
    want = [("p", 0), ("q", 1), ("t", None), ("v", 3), ("w", 4)]
    for most in (base.BROADCAST_VALUES, 0):  # by broadcast and by shuffle
        with pytest.MonkeyPatch.context() as m:
            m.setattr(base, "BROADCAST_VALUES", most)
            for find in (S.print_groups, O.groups):
                out = S.keep_one(df, find=find)
                assert out.columns == df.columns and sorted((r.g, r.doc_id) for r in out.collect()) == want
    # rows of equal id and text: one stays, the same at every order of the rows
    rows = [(7, a, k) for k in "xyz"]
    got = {S.keep_one(spark.createDataFrame(x, "doc_id long, text string, k string")).collect()[0].k for x in (rows, rows[::-1])}
    assert len(got) == 1


def test_large_shards_are_dealt_again(spark, monkeypatch):
    """A template: fingerprints that agree in all bits but the lowest ten, so they are crowded in their shards."""
    values = sorted({0x5A5A5A5A5A5A5000 | x for x in range(0, 1 << 10, 2)} | set(dense(6, 60)))
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in values], "p long")
    largest = lambda x: x.groupBy("m", "key").count().agg({"count": "max"}).first()[0]
    before = largest(S.shards(df))
    monkeypatch.setattr(S, "_FOREST", 4)
    cut = S.shards(df)
    assert before > 4 and largest(cut) <= 4 and cut.select("m").distinct().count() > len(S.masks())
    got = {r.node % 2**64: r.root % 2**64 for r in components(S.print_links(df)).collect()}
    want = brute_components({x: x for x in values})
    assert groups({x: got.get(x, x) for x in values}, values) == groups(want, values)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(200, 260)] + [(5, 5), (-3, 900), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 200 for i in [*range(200, 260), 1000]} | {-3: -3, 900: -3}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    want = brute_components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.op6_simhash_near_duplicates(spark, sf_dir).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}
