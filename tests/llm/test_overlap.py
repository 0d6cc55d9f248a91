import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from docsluice.llm import overlap as O


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_pairs(texts):
    s = {i: brute_set(t) for i, t in texts.items()}
    ids = sorted(s)
    return {(a, b) for a in ids for b in ids if a < b and (s[a] == s[b] or 9 * len(s[a] & s[b]) >= 4 * (len(s[a]) + len(s[b])))}


def kept(texts):
    least = {i: i for i in texts}
    pairs = brute_pairs(texts)
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {i for i in texts if least[i] == i}


def edited(seed=3, groups=25):
    """Texts with edited copies on both sides of the threshold, all around one shared passage."""
    rng = random.Random(seed)
    shared = " ".join(f"common{k}" for k in range(12))
    out = {}
    for g in range(groups):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))]
        out[len(out)] = " ".join(words) + " " + shared
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 20))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out[len(out)] = " ".join(copy) + " " + shared
    return out | {1000: "", 1001: None, 1002: "one two", 1003: "ONE  two", 1004: "one two three", 1005: shared}


@pytest.mark.parametrize("order", ["sample", "hash"])
def test_pairs_of_edited_copies_are_those_of_brute_force(spark, order, monkeypatch):
    if order == "hash":
        monkeypatch.setattr(O, "MOST_FREQUENT", 0)
    texts = edited()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = O.lookups(df, "doc_id", "text")
    ids = {}
    for r in rows.collect():
        ids.setdefault(r.s, []).append(r.id)
    got = {tuple(sorted((i, j))) for r in O.similar_pairs(df, rows, "doc_id", "text").collect() for i in ids[r.a] for j in ids[r.b]}
    got |= {(i, j) for v in ids.values() for i in v for j in v if i < j}
    assert got == brute_pairs(texts) and len(got) > 50


@pytest.mark.parametrize(("crowd", "rounds", "order", "small"), [(0, 4, "hash", 2048), (0, 1, "sample", 2048), (5, 1, "hash", 60), (10**9, 4, "hash", 2048)])
def test_stage_keeps_the_same_rows_however_many_turns_it_takes(spark, crowd, rounds, order, small, monkeypatch):
    """A group of near copies in a chain of edits, texts of a passage and little else, and others."""
    monkeypatch.setattr(O, "CROWD", crowd)
    monkeypatch.setattr(O, "ROUNDS", rounds)
    monkeypatch.setattr(O, "SMALL", small)
    monkeypatch.setattr(O, "TILE", 7)
    if order == "hash":
        monkeypatch.setattr(O, "MOST_FREQUENT", 0)
    rng = random.Random(rounds)
    texts, words = edited(seed=5, groups=8), [f"c{k}" for k in range(120)]
    for k in range(60):
        words[rng.randrange(len(words))] = f"e{k}"
        texts[2000 + k] = " ".join(words)
    passage = " ".join(f"p{k}" for k in range(60))
    texts |= {3000 + k: passage + " " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))) for k in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    small, roots = O.groups(df, "doc_id", "text")
    root = {r.g: r.root for r in roots.collect()}
    ids = {}
    for r in small.collect():
        ids.setdefault(root.get(r.g, r.g), set()).add(r.id)
    least = {i: i for i in texts}
    pairs = brute_pairs(texts)
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    want = {}
    for i, v in least.items():
        want.setdefault(v, set()).add(i)
    assert sorted(map(sorted, ids.values())) == sorted(map(sorted, want.values()))


def test_tiles_link_what_is_similar():
    """Every block against every block gives pairs that are similar, enough of them to connect all that are, none inside a component."""
    rng = np.random.default_rng(4)
    base, sets_ = np.arange(300), []
    for k in range(90):
        own = base[rng.random(300) > rng.choice([0.02, 0.1, 0.2])]
        sets_.append(np.unique(np.concatenate([own * 7919 * (1 << 40), rng.integers(-(2**62), 2**62, rng.integers(0, 40))])))
    n, s = np.array([len(x) for x in sets_]), np.arange(90) + 1000
    alike = {(i, j) for i in range(90) for j in range(i + 1, 90) if 9 * len(np.intersect1d(sets_[i], sets_[j])) >= 4 * (n[i] + n[j])}
    block, c = s % 3, s.copy()
    c[10:14] = 1010
    got = {tuple(sorted((a - 1000, b - 1000))) for i in range(3) for j in range(i, 3) for a, b in O.linked(s, n, c, block, sets_, i, j)}
    assert got <= alike and len(alike) > 100 and not any(10 <= a < 14 and 10 <= b < 14 for a, b in got)

    def groups(pairs):
        own = {i: {i} for i in range(90)}
        for a, b in pairs:
            if own[a] is not own[b]:
                own[a] |= own[b]
                for x in own[b]:
                    own[x] = own[a]
        return {frozenset(x) for x in own.values()}

    known = {(10, 11), (11, 12), (12, 13)}
    assert groups(got | known) == groups(alike | known)


def test_stage_drops_edited_copies(spark, tmp_path):
    texts = edited(seed=8)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = dict(C.STAGES)["SimHash near-dedup"](spark, df, str(tmp_path))
    want = kept(texts)
    assert {r.doc_id for r in out.collect()} == want and len(want) < 100


@pytest.mark.parametrize(("strip", "wide"), [(1024, 8192), (7, 8192), (7, 64)])
def test_strips_and_columns_do_not_change_the_links(strip, wide, monkeypatch):
    monkeypatch.setattr(O, "STRIP", strip)
    monkeypatch.setattr(O, "WIDE", wide)
    test_tiles_link_what_is_similar()


def test_the_order_knows_what_stands_in_a_twentieth_of_many_texts(spark, monkeypatch):
    """Else such a shingle's texts are a crowd that grows with the table. With one text of 400, as before, none of it is named."""
    monkeypatch.setattr(O, "SAMPLE", 10)
    rng = random.Random(8)
    texts = [(i, ("this stands in some of them " if i % 20 == 0 else "") + " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))) for i in range(4000)]
    df = spark.createDataFrame(texts, "id long, text string")
    assert set(O.shingles(b"this stands in some of them").tolist()) <= set(O.frequent(df, "text").tolist())


def test_places_are_dealt_by_shingle_once(spark):
    rows = spark.createDataFrame([(1, 9, [1, 2]), (2, 9, [1, 3]), (2, 9, [1, 3])], "s long, n int, hashes array<long>")
    assert sorted(map(tuple, O.shared(rows).collect())) == [(1, 1, 9, 0), (1, 2, 9, 0)]
