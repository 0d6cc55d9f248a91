"""What grows with the input only: rows moved, names measured, groups handed to Python."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsluice.functions import similarity as S
from docsluice.operators import chunking, fuzzy, linking, pairs, postings, timeline
from docsluice.operators import entities as E


def moved(spark, run):
    """Rows that the shuffles of what run() starts write."""
    sc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def plan(df):
    return df._jdf.queryExecution().toString()


def test_an_index_moves_texts_and_blocks_not_words(spark, tmp_path):
    r = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(f"w{r.randrange(200)}" for _ in range(400)), "t") for i in range(200)], "id long, text string, tenant string").repartition(4).persist()
    df.count()
    n = moved(spark, lambda: postings.build(df, "id", "text", f"{tmp_path}/p", "tenant", range_docs=50, buckets=4))
    assert n < 200 + 4 * 200 + 300  # texts, blocks of 200 words in 4 ranges, and a few; words by themselves are over 30,000


def test_an_index_moves_a_row_for_each_range_and_folder(spark, tmp_path):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50)), "t") for i in range(200)], "id long, text string, tenant string").repartition(4).persist()
    df.count()
    n = moved(spark, lambda: postings.build(df, "id", "text", f"{tmp_path}/p", "tenant", range_docs=50, buckets=4))
    assert n < 200 + 4 * 4 + 300  # each of the 10,000 words is a block of its own


def test_an_index_makes_no_row_of_a_word_and_its_ranges_hold_few_bytes(spark, tmp_path):
    sizes = [400_000 + i for i in range(24)]
    df = spark.createDataFrame([(i, "Word " * (n - 1) + f"w{i}", "t") for i, n in enumerate(sizes)], "id long, text string, tenant string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    ix = postings.build(df, "id", "text", f"{tmp_path}/p", "tenant")
    done = store.executionsList()
    plans = [done.apply(i).physicalPlanDescription() for i in range(before, done.size())]
    assert any("FlatMapGroupsInArrow" in p for p in plans)
    assert not any("Generate" in p or "ObjectHashAggregate" in p for p in plans)
    assert ix.ranges == -(-sum(5 * n for n in sizes) // postings.RANGE_BYTES)  # last words are shorter by a few bytes
    assert ix.mean == sum(sizes) / len(sizes)
    assert [tuple(r) for r in postings.lexical(ix, "word w3", 2).collect()] == [(23, 400_022.0, 1), (22, 400_021.0, 2)]


def test_ranges_meet_points_in_buckets(spark):
    r = random.Random(2)
    points = [(r.randrange(3), r.randrange(-300, 300)) for _ in range(300)]
    ranges = [(r.randrange(3), i, s := r.randrange(-300, 300), s + r.choice([-1, 0, 1, 20, 63, 64, 200])) for i in range(120)]
    a, b = spark.createDataFrame(points, "k int, at long"), spark.createDataFrame([*ranges, (1, 500, None, 5)], "k int, id int, s long, e long")
    j = pairs.range_join(a, b, "k", "at", "s", "e")
    want = sorted((x[1], y[1]) for x in points for y in ranges if x[0] == y[0] and y[2] <= x[1] <= y[3])
    assert sorted((x["at"], x["id"]) for x in j.collect()) == want
    assert "BroadcastHashJoin" not in plan(j)


def test_many_pairs_of_names_as_one_by_one():
    r = random.Random(3)
    names = ["", "a", "b", "ab", "ba", "é€𝄞x", "x" * 63, "x" * 64] + ["".join(r.choice("abcé 1") for _ in range(r.randrange(r.choice([4, 12, 70])))) for _ in range(150)]
    a, b = (np.array([r.randrange(len(names)) for _ in range(20_000)]) for _ in range(2))
    assert S.many_jaro_winkler(names, a, b).tolist() == [S.jaro_winkler(names[i], names[j]) for i, j in zip(a, b, strict=True)]
    assert S.many_jaro_winkler([], a[:0], b[:0]).tolist() == []


@pytest.mark.parametrize(("first", "many", "cells", "wide", "kinds"), [(16, 1 << 18, 1 << 21, 1024, 64), (1, 4, 10, 1024, 4), (3, 50, 100, 0, 64)])
def test_best_of_many_names_is_that_of_all(monkeypatch, first, many, cells, wide, kinds):
    for k, v in zip(("FIRST", "PAIRS", "BOUNDS", "WIDE", "KINDS"), (first, many, cells, wide, kinds), strict=True):
        monkeypatch.setattr(S, k, v)
    r = random.Random(10)
    for _ in range(25):
        signs, longest = r.choice(["ab", "abc12", "0123456789", "abcdefghij é"]), r.choice([3, 6, 12, 70])
        mine, others = ([r.choice(["", "x", "same"])] + ["".join(r.choice(signs) for _ in range(r.randrange(longest))) for _ in range(r.randrange(25))] for _ in range(2))
        for slack in (2e-9, 0.1):
            want = []
            for i, x in enumerate(mine):
                values = [S.jaro_winkler(x, y) for y in others]
                near = {}
                for k, v in enumerate(values):
                    if v >= max(values) - slack:
                        near.setdefault(v, k)
                want += [(i, k, v) for v, k in sorted(near.items())]
            assert list(zip(*(x.tolist() for x in S.best_jaro_winkler(mine, others, slack)), strict=True)) == want
    assert [len(x) for x in S.best_jaro_winkler([], ["a"], 0.1)] == [len(x) for x in S.best_jaro_winkler(["a"], [], 0.1)] == [0, 0, 0]


def test_best_names_measure_few_of_all_pairs(monkeypatch):
    measured, many = [], S.many_jaro_winkler
    monkeypatch.setattr(S, "many_jaro_winkler", lambda names, a, b: measured.append(len(a)) or many(names, a, b))
    r = random.Random(11)
    mine, others = [f"Customer#{r.randrange(900_000):09}" for _ in range(2000)], [f"Supplier#{i * 37 % 60_000:09}" for i in range(2000)]
    assert len(S.best_jaro_winkler(mine, others, 2e-9)[0]) >= 2000
    assert 0 < sum(measured) < 2000 * 2000 / 4


def test_best_names_are_those_of_all_pairs(spark):
    r = random.Random(4)
    name = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 7)))
    left, right = [(r.randrange(3), name()) for _ in range(80)], [(r.randrange(1, 4), name(), i) for i in range(90)]
    a = spark.createDataFrame([*left, (None, "a"), (1, None)], "k int, n string")
    b = spark.createDataFrame([*right, (None, "a", 100), (1, None, 101)], "k int, n string, id long")
    for tile in (5, 2048):
        got = {(x["k"], x["n"]): (x["id"], x["score"]) for x in pairs.best_names(a, b, "k", "n", "id", tile).collect()}
        want = {}
        for k, n in left:
            some = sorted((-round(S.jaro_winkler(n, m), 9), i) for j, m, i in right if j == k)
            if some:
                want[k, n] = (some[0][1], -some[0][0])
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_scores_are_measured_once_for_two_names(spark):
    rows = [("k", f"n{i % 3}", i) for i in range(60)] + [("l", "n1", 100), ("l", "n9", 99), ("l", None, 98)]
    df = spark.createDataFrame(rows, "k string, n string, id long")
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def both(x, y):
        asked.add(1)
        return x + y

    got = sorted(tuple(x) for x in pairs.scored_pairs(df, "k", "n", "id", lambda x, y: [both(x, y).alias("s")]).collect())
    want = sorted((p[2], q[2], p[1] + q[1]) for p, q in itertools.permutations([x for x in rows if x[1]], 2) if p[0] == q[0] and p[2] < q[2])
    assert got == want and asked.value == 10


@pytest.mark.parametrize(("tile", "few"), [(3, 500_000), (4096, 500_000), (3, 20), (4096, 20)])
def test_scored_pairs_are_all_pairs(spark, monkeypatch, tile, few):
    """By place where names are few, by a join where they are not; in one tile and in many; equal ids and nulls too."""
    monkeypatch.setattr(pairs, "FEW_SCORES", few)
    r = random.Random(9)
    rows = [(r.choice(["k", "l", None]), r.choice(["a", "b", "c", "d", None]), r.choice([i, i, i, None])) for i in range(60)] + [("m", "a", 7), ("m", "b", 7), ("m", "z", 6)]
    df = spark.createDataFrame(rows, "k string, n string, id long").repartition(3)
    got = sorted(tuple(x) for x in pairs.scored_pairs(df, "k", "n", "id", lambda x, y: [F.concat(x, y).alias("s"), F.when(x != y, 1).alias("t")], tile).collect())
    whole = [x for x in rows if None not in x]
    assert [x[:3] for x in got] == sorted((p[2], q[2], p[1] + q[1]) for p, q in itertools.permutations(whole, 2) if p[0] == q[0] and p[2] < q[2])
    assert all(t == (1 if s[0] != s[1] else None) for _, _, s, t in got)
    assert pairs.scored_pairs(df.limit(0), "k", "n", "id", lambda x, y: [F.concat(x, y).alias("s")], tile).count() == 0


def test_pairs_of_rows_take_their_scores_by_place(spark, sf_dir):
    """Nothing is worked out, and no name is looked for, for a pair of rows."""
    from docsluice import catalog

    p = plan(catalog.queries()["r8_23_component_scores"](spark, sf_dir)).split("== Physical Plan ==")[1]
    ends = p[: p.index("posexplode")]
    assert "round(" not in p and "Join" not in ends


@pytest.mark.parametrize("n", [1, 7, 40, 10_000])
def test_top_similar_sets_are_those_of_all_pairs(spark, n):
    r = random.Random(5)
    rows = [(r.randrange(3), i, sorted(r.sample("abcdef", r.choice([1, 2, 2, 3])))) for i in range(150)]
    want = []
    for (k, i, x), (m, j, y) in itertools.combinations(rows, 2):
        s = round(len(set(x) & set(y)) / len(set(x) | set(y)) + 1e-12, 2)
        want += [(-s, i, j)] if k == m and s >= 0.4 else []
    df = spark.createDataFrame([*rows, (0, 500, []), (0, 501, [])], "k int, id long, c array<string>").repartition(3)
    got = pairs.top_similar(df, "k", "id", "c", 0.4, n)
    assert [(x["similarity"], x["a"], x["b"]) for x in got.collect()] == [(-s, a, b) for s, a, b in sorted(want)[:n]]


def test_corrections_do_not_meet_pairs(spark):
    r = random.Random(6)
    said = [("t", i, r.choice(["add", "merge", "remove", "view"]), f"N{r.randrange(5)}", f"n{r.randrange(5)}") for i in range(300)]
    met = [("t", f"n{i}", f"n{j}") for i in range(6) for j in range(6)]
    a, b = spark.createDataFrame(met, "tenant string, a string, b string"), spark.createDataFrame(said, "tenant string, id long, kind string, alias string, merged string")
    df = E.learned_adjustments(a, b)
    worth = {"add": 1, "merge": 1, "remove": -1, "view": 0}
    want = {(x, y): round(max(-0.3, min(0.3, 0.1 * sum(worth[s[2]] for s in said if {s[3].lower(), s[4]} & {x, y}))), 2) for _, x, y in met}
    assert {(x["a"], x["b"]): x["adjustment"] for x in df.collect()} == want
    assert moved(spark, df.collect) < 4000


def test_names_of_a_question_are_measured_once(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    def measure(a, b):
        @F.pandas_udf("double")
        def run(x, y):
            asked.add(len(x))
            return x.str.len() * 0.0 + 0.9

        return run(a, b)

    monkeypatch.setattr(fuzzy, "partial_ratio_column", measure)
    df = spark.createDataFrame([(i, "red rung") for i in range(100)], "id long, n string").repartition(4)
    assert fuzzy.named_in(df, "the red ring", "id", "n").count() == 100 and 1 <= asked.value <= 3


def test_leaders_of_small_keys_share_a_task(spark):
    r = random.Random(7)
    rows = [(r.randrange(60) if i % 9 else None, i, r.choice([None, float("nan"), 1.0, 2.0]), r.choice([None, "abcd", "abce", "xyz"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, id long, s double, t string").repartition(3)
    made = timeline.leader_clusters(df, "k", "t", "s", "id", 0.7)
    want = set()
    for k in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == k]
        group = {}
        for x, leader in zip(mine, timeline.first_leaders([x[3] or "" for x in mine], 0.7), strict=True):
            group.setdefault(leader, []).append(x)
        want |= {max(g, key=lambda x: (x[2] if x[2] is not None and x[2] == x[2] else -1.0, -x[1]))[1] for g in group.values()}
    got = [x["id"] for x in made.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "FlatMapGroups" not in plan(made)


def test_windows_are_handed_on_in_small_batches():
    texts = [f"{i} " * 400_000 if i < 6 else None for i in range(7)]
    made = list(chunking.cut_batches(chunking.windows)([pa.RecordBatch.from_pydict({"id": list(range(7)), "text": texts})]))
    assert [tuple(x.values()) for b in made for x in b.to_pylist()] == [(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(chunking.windows(t or ""))]
    assert max(b.nbytes for b in made) < 2 * chunking.HELD


def test_candidate_pages_move_sets_not_words(spark):
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(90)}" for _ in range(n))
    docs = spark.createDataFrame([(i, "\n".join(text(12) for _ in range(30))) for i in range(20)] + [(50, ""), (51, None)], "doc_id long, text string").persist()
    chunks, boxes = linking.line_chunks(docs), linking.line_boxes(docs)
    found = linking.candidate_pages(chunks, boxes)
    want = set()
    for doc in docs.collect():
        words = {}
        for x in boxes.where(F.col("doc_id") == doc["doc_id"]).collect() if doc["doc_id"] < 3 else []:
            words.setdefault(x["page"], set()).update(x["box"].split())
        for x in chunks.where(F.col("doc_id") == doc["doc_id"]).collect() if words else []:
            shared = sorted((-len(w & set(x["chunk_text"].split())), p) for p, w in words.items())
            want |= {(doc["doc_id"], x["chunk"], p, -n) for n, p in shared[:3] if n}
    assert {tuple(x) for x in found.where("doc_id < 3").collect()} == want
    assert moved(spark, found.collect) <= 22 * (31 + 5)


def test_pairs_of_small_rows_are_many_tasks_work(spark):
    df = spark.createDataFrame([(f"k{i % 40}", i) for i in range(2000)], "k string, id long")
    p = pairs.statement_pairs(df, "k", "id")
    assert p.count() == 40 * 50 * 49 // 2
    assert p.select(F.spark_partition_id().alias("p")).distinct().count() > 1
