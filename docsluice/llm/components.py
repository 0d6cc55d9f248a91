"""Connected components of an undirected graph of long keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .base import save

#: The number of rounds grows with the logarithm of the longest chain; more than this means an error.
MOST_ROUNDS = 60


def _saved(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written and read back, and what tells them from others, taken while they are written."""
    seen = Observation()
    out = save(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge, root the smallest node reachable; roots are listed too.

    Each round writes its edges to the shared folder. Minima are saved before they are joined, so both
    sides of a join are plain exchanges and Spark can split a node with very many edges. Loops and rows
    with a null end are dropped; an empty graph has no rows.
    """
    x, y = F.col(a), F.col(b)
    edges, before = _saved(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    for _ in range(MOST_ROUNDS if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges, now = _saved(small.select("e.u", "e.v").where("u != v").distinct())
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
