"""Matches of names against brute force: nothing is lost, nothing is measured that need not be."""

import random

import pytest
from pyspark.sql import functions as F

from docsluice.functions.similarity import indel_ratio, partial_ratio, token_set_ratio
from docsluice.operators.fuzzy import changes, lengths, may_be_named, named_in, pieces, similar_names


def some_names(seed, n=120):
    r = random.Random(seed)
    out = ["", "a", "ab", "ravi", "raxvi", "abcd", "abxcd", "é", "straße", "strasse"]
    for _ in range(n):
        w = "".join(r.choice("abcr ") for _ in range(r.randrange(1, 14)))
        out.append(w)
        k = r.randrange(len(w) + 1)
        out.append(w[:k] + r.choice("abx") + w[k + r.randrange(2) :])
    return out


@pytest.mark.parametrize("least", [0.6, 0.75, 0.85, 1.0])
def test_similar_names_are_those_of_brute_force(spark, least):
    a, b = some_names(1), some_names(2)
    left, right = spark.createDataFrame([(x,) for x in [*a, None, "ravi"]], "n string"), spark.createDataFrame([(x,) for x in [*b, None]], "m string")
    got = [tuple(r) for r in similar_names(left, right, "n", "m", least).collect()]
    want = {(x, y, round(indel_ratio(x, y), 9)) for x in a for y in b if round(indel_ratio(x, y), 9) >= least}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert similar_names(left.limit(0), right, "n", "m", least).count() == 0


def test_a_piece_is_always_untouched():
    for t in (0.6, 0.85):
        for m in range(1, 30):
            cut = pieces(m, t)
            assert sum(n for _, n in cut) == m and len(cut) == changes(m, t) + 1
            assert all(int((1 - t) * (m + n) + 1e-9) <= changes(m, t) for n in lengths(m, t))


@pytest.mark.parametrize("question", ["abxcd", "raxvi", "the abc car, a cab", "a", "", "cab cab abc", "abc rab car bar arc crab bac"])
def test_names_in_a_question_are_those_of_brute_force(spark, question):
    names = some_names(3)
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*names, None, "ABXCD"])], "id int, n string")
    for least in (85.0, 65.0):
        got = {r["id"]: (r["score"], r["is_exact"]) for r in named_in(df, question, "id", "n", least).collect()}
        want = {}
        for i, x in enumerate([*names, None, "ABXCD"]):
            x = x and x.lower()
            if x is None:
                continue
            score = 100.0 if x in question else round(100 * max(token_set_ratio(x, question), partial_ratio(x, question)), 9)
            if score >= least:
                want[i] = (score, x in question)
        assert got == want


def test_the_bound_rules_names_out(spark):
    df = spark.createDataFrame([("zzyzx qqq",), ("mmmm nnnn",), ("ravi kumar",), ("ravi kumra",)], "n string")
    assert [r[0] for r in df.select(may_be_named(F.col("n"), "where is ravi kumar", 0.85)).collect()] == [False, False, True, True]
