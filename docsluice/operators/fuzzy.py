"""Matches of names that lose nothing: what a bound proves too different is dropped by equal pieces of text, only the rest is measured.

Two texts of m and n characters with an indel ratio 2 LCS / (m + n) of t or more are at most (1 - t) (m + n) insertions and deletions apart. If one of
them is cut into more pieces than that, one piece at least is untouched and stands in the other as it is, no further from its place than the
number of changes. So pieces are keys of an equi join, or a test that Spark evaluates without Python.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions.columns import indel_ratio_column, partial_ratio_column, token_set_ratio_column

#: Ratios are rounded to this many digits before they are compared, changes are counted with as much slack.
DIGITS = 9


def changes(m: int, t: float) -> int:
    """The most insertions and deletions between a text of m characters and any text alike by t."""
    return math.floor(2 * (1 - t) * m / t + 1e-9)


def pieces(m: int, t: float) -> list[tuple[int, int]]:
    """(start, length) of one piece more than there can be changes, as even as can be; empty ones where m is too small for that many."""
    k = changes(m, t) + 1
    edges = [i * m // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def lengths(n: int, t: float) -> range:
    """Lengths that a text alike by t to one of n characters can have."""
    return range(math.ceil(n * t / (2 - t) - 1e-9), math.floor(n * (2 - t) / t + 1e-9) + 1)


def _keys(t: float, probe: bool):
    """(row, m, piece, text): the pieces of each name, or, as a probe, all that could be pieces of a name like it, at the places where they could stand."""

    def of(name: str) -> set[tuple[int, int, str]]:
        if not probe:
            return {(len(name), i, name[a : a + n]) for i, (a, n) in enumerate(pieces(len(name), t))}
        out = set()
        for m in lengths(len(name), t):
            for i, (a, n) in enumerate(pieces(m, t)):
                far = changes(m, t)
                out.update((m, i, name[s : s + n]) for s in range(max(0, a - far), min(len(name) - n, a + far) + 1))
        return out

    def run(batches):
        for b in batches:
            rows = [(x, *k) for x in b.column(0).to_pylist() for k in of(x)]
            for a in range(0, len(rows), 1 << 16):
                name, m, i, text = zip(*rows[a : a + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_pydict({"name": pa.array(name), "m": pa.array(m, pa.int32()), "i": pa.array(i, pa.int32()), "piece": pa.array(text)})

    return run


def similar_names(left: DataFrame, right: DataFrame, name_a: str, name_b: str, least: float = 0.85) -> DataFrame:
    """(a, b, ratio): all pairs of distinct names of two tables with an indel ratio of `least` or more, above 0.5.

    Names meet at equal pieces; each pair is measured once, by its own characters. Join the pairs to the tables for the rows of a name. Null names have no pair; two empty ones are
    alike. A name gives about as many keys as the cube of its length, so this is for names, not for texts.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be above 0.5 and at most 1")
    schema = "name string, m int, i int, piece string"
    a = left.select(F.col(name_a).cast("string").alias("a")).where("a IS NOT NULL").distinct().mapInArrow(_keys(least, False), schema).withColumnRenamed("name", "a")
    b = right.select(F.col(name_b).cast("string").alias("b")).where("b IS NOT NULL").distinct().mapInArrow(_keys(least, True), schema).withColumnRenamed("name", "b")
    met = a.join(b, ["m", "i", "piece"]).select("a", "b").distinct()
    return met.withColumn("ratio", F.round(indel_ratio_column(F.col("a"), F.col("b")), DIGITS)).where(F.col("ratio") >= least)


def _stands_in(small: Column, large: Column, m: Column, t: float, far: Column) -> Column:
    """Whether one of far + 1 even pieces of `small` (of m characters) stands in `large`."""
    k = far + 1
    cut = lambda i: F.substr(small, F.floor(i * m / k).cast("int") + 1, (F.floor((i + 1) * m / k) - F.floor(i * m / k)).cast("int"))
    return F.exists(F.sequence(F.lit(0), far), lambda i: F.contains(large, cut(i)))


def may_be_named(name: Column, question: str, t: float) -> Column:
    """False only where neither the token-set ratio nor the partial ratio of a lower-case name and a lower-case question can reach t.

    Both ratios are indel ratios. A shared word decides nothing, so such names pass. Else the token sets are the sorted words of both, and the partial ratio
    has a stretch of the longer text no longer than the shorter one: in each case a piece of one stands in the other.
    """
    q, n = F.lit(question), F.length(name)
    words = F.array_sort(F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != "")))
    mine = sorted(set(question.split()))
    shares = F.arrays_overlap(words, F.array(*map(F.lit, mine))) if mine else F.lit(False)
    sorted_name, sorted_question = F.array_join(words, " "), " ".join(mine)
    own = F.length(sorted_name)
    far = lambda m: F.floor(m * (2 * (1 - t) / t) + 1e-9).cast("int")
    sets = own.between(math.ceil(len(sorted_question) * t / (2 - t) - 1e-9), math.floor(len(sorted_question) * (2 - t) / t + 1e-9)) & _stands_in(sorted_name, F.lit(sorted_question), own, t, far(own))
    inside = F.floor(n * (2 * (1 - t)) + 1e-9).cast("int")
    around = math.floor(len(question) * 2 * (1 - t) + 1e-9)
    part = F.when(n <= len(question), _stands_in(name, q, n, t, inside)).otherwise(_stands_in(q, name, F.lit(len(question)), t, F.lit(around)))
    return shares | sets | part


def named_in(df: DataFrame, question: str, id_col: str, name_col: str, least: float = 85.0) -> DataFrame:
    """(id, score, is_exact) of the rows whose name a question has, best first: 100 where it is contained, else the better of the
    token-set and the partial ratio, from `least` on (above 50). Of several names of one id the best counts. Names that are not contained are measured only where a
    bound does not rule them out, each distinct name once; no match is lost. Null names match nothing."""
    q = question.lower()
    rows = df.select(F.col(id_col), F.lower(F.col(name_col)).alias("n")).where(F.col("n").isNotNull())
    # m is n: a filter on the grouping column would move below the grouping and over to the other side of the join, and measure every row
    every, rows = rows, rows.groupBy("n").agg(F.first("n").alias("m"))
    inside = F.contains(F.lit(q), F.col("m"))
    near = rows.where(~inside & may_be_named(F.col("m"), q, least / 100))
    score = F.round(F.greatest(token_set_ratio_column(F.col("m"), F.lit(q)), partial_ratio_column(F.col("m"), F.lit(q))) * 100, DIGITS)
    found = rows.where(inside).select("n", F.lit(100.0).alias("score"), F.lit(True).alias("is_exact")).unionByName(near.select("n", score.alias("score"), F.lit(False).alias("is_exact")).where(F.col("score") >= least))
    found = every.join(found, "n")
    best = found.groupBy(id_col).agg(F.max(F.struct("score", "is_exact")).alias("b")).select(id_col, "b.*")
    return best.orderBy(F.desc("score"), id_col)
