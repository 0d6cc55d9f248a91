"""Order, gaps, duplicates and outliers of dated events.

Every function is one shuffle by the tenant key, then windows over the same partitioning. Today's date is
never read: what depends on it takes an as_of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions.fixed import AHEAD_KINDS, CRITICAL_SEQUENCES, YEARS_AHEAD, YEARS_BEFORE
from docsluice.functions.similarity import indel_ratio


def sequence_violations(df: DataFrame, key: str, at: str, kind: str, order: dict[str, int], id_col: str, critical: list[tuple[str, str]] = CRITICAL_SEQUENCES) -> DataFrame:
    """Consecutive events of the ordered kinds whose place in the workflow goes back; high if the pair of kinds is critical, else medium."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, v) for k, v in order.items()])
    w = Window.partitionBy(key).orderBy(at, id_col)
    e = df.where(F.col(kind).isin(*order)).select(key, at, kind, id_col, rank.alias("r"))
    e = e.select("*", F.lead(F.struct("r", kind, id_col)).over(w).alias("next"))
    back = F.col("r") - F.col("next.r")
    return e.where(back > 0).select(key, F.col(id_col).alias("first_id"), F.col(f"next.{id_col}").alias("next_id"), F.col(kind).alias("first_kind"), F.col(f"next.{kind}").alias("next_kind"), F.when(F.concat_ws("\0", kind, f"next.{kind}").isin(*["\0".join(p) for p in critical]), "high").otherwise("medium").alias("severity"))


def gaps(df: DataFrame, key: str, at: str, kind: str, id_col: str, limits: DataFrame, default: tuple[int, int] = (180, 365)) -> DataFrame:
    """Days to the next event beyond the limit of the pair of kinds; high beyond its critical limit (both strict).

    limits: first_kind, next_kind, days, critical. A pair without a row has the default.
    """
    w = Window.partitionBy(key).orderBy(at, id_col)
    e = df.select(key, F.col(id_col).alias("first_id"), F.col(kind).alias("first_kind"), F.col(at).cast("date").alias("day"), F.lead(kind).over(w).alias("next_kind"), F.lead(F.col(at).cast("date")).over(w).alias("next_day"))
    e = e.where(F.col("next_day").isNotNull()).withColumn("gap", F.datediff("next_day", "day"))
    j = e.join(limits, ["first_kind", "next_kind"], "left").withColumns({"days": F.coalesce("days", F.lit(default[0])), "critical": F.coalesce("critical", F.lit(default[1]))})
    return j.where(F.col("gap") > F.col("days")).select(key, "first_id", "first_kind", "next_kind", "gap", F.when(F.col("gap") > F.col("critical"), "high").otherwise("medium").alias("severity"))


def date_outliers(df: DataFrame, key: str, at: str, kind: str, id_col: str, as_of: str, ahead: float = YEARS_AHEAD, before: tuple[float, float] = YEARS_BEFORE, may_lie_ahead: list[str] = AHEAD_KINDS) -> DataFrame:
    """(key, id, rule, days, severity) of dates that cannot be right, at most one rule for each event.

    future: later than as_of, except kinds that may lie ahead, up to `ahead` years; days after as_of; high beyond `ahead` years, else medium.
    past: more than before[0] years ahead of the middle half of the key's dates (the row at n // 4 in order, the first of fewer than three);
    days before it; high beyond before[1] years, else medium. A year has 365.25 days. Rows without a date are no outliers.
    """
    w, whole = Window.partitionBy(key).orderBy("day", id_col), Window.partitionBy(key)
    e = df.select(key, id_col, F.col(kind).alias("kind"), F.col(at).cast("date").alias("day")).where("day IS NOT NULL")
    e = e.select("*", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(whole).alias("n"))
    q1 = F.max(F.when(F.col("i") == F.when(F.col("n") >= 3, F.floor(F.col("n") / 4)).otherwise(0), F.col("day"))).over(whole)
    today = F.lit(as_of).cast("date")
    e = e.withColumns({"later": F.datediff("day", today), "early": F.datediff(q1, "day")})
    allowed = F.col("kind").isin(*may_lie_ahead) & (F.col("later") <= int(ahead * 365.25))
    far = lambda c, years: F.col(c) / 365.25 > years
    rule = F.when(F.col("later") > 0, F.when(~F.coalesce(allowed, F.lit(False)), "future")).when(far("early", before[0]), "past")
    severity = F.when(F.when(F.col("later") > 0, far("later", ahead)).otherwise(far("early", before[1])), "high").otherwise("medium")
    return e.select(key, id_col, rule.alias("rule"), F.when(F.col("later") > 0, F.col("later")).otherwise(F.col("early")).alias("days"), severity.alias("severity")).where("rule IS NOT NULL")


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that must end in a unique key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n rows of each group that come first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def running_offset(df: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Sum of the sizes of the rows before, zero for the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("page_offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def contiguity_errors(df: DataFrame, key: str, index: str, start: str, end: str) -> DataFrame:
    """Rows that do not begin right after the row before, or at 1 for the first."""
    w = Window.partitionBy(key).orderBy(index, start)
    want = F.coalesce(F.lag(end).over(w) + 1, F.lit(1))
    return df.withColumn("expected", want).where(F.col(start) != F.col("expected"))


#: Buckets of characters whose counts bound what two texts have in common.
BAG = 32


def first_leaders(texts: list[str], ratio: float) -> list[int]:
    """For each text the place of the first leader before it that is alike by `ratio` or more, its own if none is: such a text leads.

    What two texts have in common is at most what the counts of their characters have; leaders that this bound rules out are passed over all at once,
    the others are measured in order. Equal texts have equal leaders.
    """
    bags, sizes, leaders = np.zeros((256, BAG), np.uint16), np.zeros(256), []
    seen: dict[str, int] = {}
    out = []
    for i, t in enumerate(texts):
        if t not in seen:
            bag = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % BAG, minlength=BAG).astype(np.uint16)
            n = len(leaders)
            common = np.minimum(bags[:n], bag).sum(axis=1, dtype=np.int64)
            may = np.flatnonzero(2 * common >= ratio * (sizes[:n] + len(t)) - 1e-9)
            home = next((leaders[j] for j in may.tolist() if indel_ratio(texts[leaders[j]], t) >= ratio), None)
            if home is None:
                if n == len(bags):
                    bags, sizes = np.concatenate([bags, np.zeros_like(bags)]), np.concatenate([sizes, np.zeros_like(sizes)])
                bags[n], sizes[n], home = bag, len(t), i
                leaders.append(i)
            seen[t] = home
        out.append(seen[t])
    return out


def leader_clusters(df: DataFrame, key: str, text: str, score: str, id_col: str, ratio: float) -> DataFrame:
    """Per key, rows in the order of ids join the first leader whose text has at least `ratio` of the longer one's
    Indel similarity (2 LCS / both lengths), else lead a cluster of their own; the best score of a cluster is kept, the first of equals.

    The result depends on that order, so a key's rows are one task's work; a key is one day of one tenant. Texts that share too few
    characters with a leader are not measured, and each distinct text is placed once. Null texts are empty; null scores come last.
    """
    schema, columns = df.select(key, id_col, score).schema, [key, id_col, score]

    def best(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:
            return [rows[0][:3]]
        first: dict[int, tuple] = {}
        for r, leader in zip(rows, first_leaders([r[3] or "" for r in rows], ratio), strict=True):
            s, b = r[2], first.get(leader)
            # null and NaN come last; of equals the first stays
            if b is None or (s is not None and s == s and (b[2] is None or b[2] != b[2] or s > b[2])):
                first[leader] = r
        return [first[k][:3] for k in sorted(first)]

    def run(batches):
        held, kinds = [], None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], columns)

        for b in batches:
            kinds, done = b.schema.types, []
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and held[0][0] != r[0]:
                    done += best(held)
                    held = []
                held.append(r)
            if done:
                yield table(done)
        if held:
            yield table(best(held))

    # many small keys share a task's batches; a key's rows follow each other in the order of ids
    rows = df.select(key, id_col, score, text).repartition(key).sortWithinPartitions(key, id_col)
    return rows.mapInArrow(run, schema)
