"""Operator 12: hard negatives by integer inner products, found in R-trees that are packed sort-tile-recursively.

Rows are dealt to shards by hash. A task sorts the rows of its shard by label and tiles each label's rows by the coordinates of
the largest variance, one cut after the other (STR); runs of LEAF rows are leaves, runs of FAN boxes are the boxes above
them. A tree is a row of a saved table: vectors, ids, labels, and the minimum bounding boxes of all levels in flat arrays. For an anchor, a
box's bounds give an interval of each coordinate's product, hence of the score. A search is best-first: an anchor opens the box of
the highest possible score, and drops boxes that hold no row of the labels it asks for, whose interval misses its score windows,
or whose best is strictly below its k-th score so far (equal ones may hold a smaller id). Many anchors open their boxes at once in numpy.

Anchors are taken in blocks of bounded size, which every task holds while it walks its trees, first for the positives, then
for the negatives in the windows that the positives give. All arithmetic is on integers: in doubles while every sum is below 2 ** 53,
else in longs or Python's integers; a score that does not fit a long is an error. In many dimensions boxes are wide and little is pruned; the result is exact all the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import read, save
from .vectors import BLOCK_ROWS, blocks, fixed_point, matrix, shard_count, shards, usable

#: Rows of a tree at most, rows of a leaf, boxes under a box, anchors that search a tree at once.
SHARD_ROWS, LEAF, FAN, AT_ONCE = 16_384, 64, 8, 256
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def tile(x: np.ndarray, label: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """An order of the rows in which every run of `leaf` rows is a compact box: by label, then cut in two at the median of one
    coordinate after another."""
    order = np.lexsort((label,))
    dims = np.argsort(-x.var(axis=0), kind="stable")
    todo = [(int(a), int(b), 0) for a, b in zip(*_runs(label[order]), strict=True)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= leaf or level == len(dims):
            continue
        part = order[a:b]
        order[a:b] = part[np.argsort(x[part, dims[level]], kind="stable")]
        half = (a + b) // 2 // leaf * leaf  # where a leaf begins, so no leaf crosses the cut
        todo += [(a, half, level + 1), (half, b, level + 1)] if a < half else [(half + leaf, b, level + 1)]
    return order


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, np.r_[starts[1:], len(values)]


def pack(lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, fan: int) -> tuple:
    """Bounds of each run of `fan` neighbours."""
    at = np.arange(0, len(lo), fan)
    return np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)


def levels(x: np.ndarray, label: np.ndarray) -> list[tuple]:
    """(lo, hi, smallest label, largest label) of the boxes of each level, leaves first, up to one root."""
    out = [pack(x, x, label, label, LEAF)]
    while len(out[-1][0]) > 1:
        out.append(pack(*out[-1], FAN))
    return out


def bounds(anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with the points of each box: one interval a coordinate, summed."""
    up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


TREE = "dim int, x array<long>, ids array<long>, labels array<long>, lo array<long>, hi array<long>, first array<long>, last array<long>, sizes array<int>"


def _trees(rows: int):
    def run(batches):
        for dim, t in shards(batches, "x", rows):
            x, label, ids = matrix(t["x"], dim, np.int64), t["label"].to_numpy(), t["id"].to_numpy()
            order = tile(x, label)
            x, label, ids = x[order], label[order], ids[order]
            boxes = levels(x, label)
            flat = {k: [np.concatenate([b[i].ravel() for b in boxes])] for i, k in enumerate(("lo", "hi", "first", "last"))}
            out = {"x": [x.ravel()], "ids": [ids], "labels": [label]} | flat
            lists = {k: pa.array(v, pa.list_(pa.int64())) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32())} | lists | {"sizes": pa.array([[len(b[0]) for b in boxes]], pa.list_(pa.int32()))})

    return run


def taking_part(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, x) of the rows that take part: id, label and vector are there, all components are finite and fit a long when
    scaled. Rows that repeat all three count once. Ids and labels are whole numbers."""
    x = fixed_point(F.col(vector_col), scale)
    rows = df.where(usable(F.col(vector_col))).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x")).where("x IS NOT NULL").distinct()


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trees of a saved table of taking_part(), a row each, saved in the shared folder."""
    n = shard_count(rows.count(), shard_rows)
    return save(rows.repartition(n, "id", "x").mapInArrow(_trees(shard_rows), TREE), "trees")


class Best:
    """The first k rows of each of many lists, by falling score, then id."""

    def __init__(self, lists: int, k: int) -> None:
        self.ids, self.scores = np.zeros((lists, k), np.int64), np.full((lists, k), LOWEST)
        self.there = np.zeros((lists, k), bool)

    def kth(self, at: np.ndarray) -> np.ndarray:
        """The score below which nothing enters a list any more; LOWEST while it has room."""
        return np.where(self.there[at, -1], self.scores[at, -1], LOWEST)

    def put(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray, ok: np.ndarray) -> None:
        """Offer (lists, rows) to the lists `at`, which are all different."""
        k = self.ids.shape[1]
        kept = ok.any(axis=1)
        at, ids, scores, ok = at[kept], ids[kept], scores[kept], ok[kept]
        if not len(at):
            return
        i, s, t = np.concatenate([self.ids[at], ids], axis=1), np.concatenate([self.scores[at], scores], axis=1), np.concatenate([self.there[at], ok], axis=1)
        order = np.lexsort((i, -s, ~t), axis=1)[:, :k]
        self.ids[at], self.scores[at], self.there[at] = (np.take_along_axis(v, order, axis=1) for v in (i, s, t))


def best_first(tree: dict, anchors: np.ndarray, wants, keeps, best: Best, lists: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
    """Search one tree for all anchors at once; returns how many leaves were opened.

    wants(first, last): (anchors, boxes) whether boxes with labels in that range may hold a wanted row; keeps(rows): (anchors, rows) whether a row is
    wanted, given the rows of each anchor's leaf. lists, low, high: (anchors, windows) the list of each window of an anchor and its inclusive
    bounds; an empty window has low > high.
    """
    n, dim, top = len(anchors), tree["dim"], len(tree["sizes"]) - 1
    offset = np.concatenate([[0], np.cumsum(tree["sizes"])]).astype(np.int64)
    x, lo, hi = tree["x"].reshape(-1, dim), tree["lo"].reshape(-1, dim), tree["hi"].reshape(-1, dim)
    largest = max(int(np.abs(v).max(initial=0)) for v in (lo, hi)) * int(np.abs(anchors).max(initial=0)) * dim
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 62 else object
    a, points = anchors.astype(kind), x.astype(kind)
    # bounds of all boxes of a tree for all anchors are two products of matrices; which of them are looked at is up to the search
    least, most = (np.clip(v, LOWEST + 1, HIGHEST).astype(np.int64) if kind is object else v.astype(np.int64) for v in bounds(a, lo.astype(kind), hi.astype(kind)))
    good = wants(tree["first"], tree["last"])
    queued = np.full((n, len(lo)), LOWEST)
    queued[:, offset[top]] = np.where(good[:, offset[top]], most[:, offset[top]], LOWEST)
    live, opened = np.arange(n), 0
    while live.size:
        box = queued[live].argmax(axis=1)
        reach = queued[live, box]
        go = reach > LOWEST
        # the best box is strictly below every window's k-th score, or all windows begin above it: nothing behind it counts either
        go &= ((reach[:, None] >= best.kth(lists[live])) & (reach[:, None] >= low[live]) & (low[live] <= high[live])).any(axis=1)
        live, box, reach = live[go], box[go], reach[go]
        if not live.size:
            break
        queued[live, box] = LOWEST
        # a box whose interval misses all windows that still take its best is not opened
        meets = ((reach[:, None] >= best.kth(lists[live])) & (reach[:, None] >= low[live]) & (least[live, box][:, None] <= high[live])).any(axis=1)
        ask, box = live[meets], box[meets]
        level = np.searchsorted(offset, box, side="right") - 1
        for k in np.unique(level).tolist():
            who, which = ask[level == k], box[level == k] - offset[k]
            if k:
                child = offset[k - 1] + which[:, None] * FAN + np.arange(FAN)
                real = child < offset[k]
                child = np.where(real, child, offset[k - 1])
                row = np.broadcast_to(who[:, None], child.shape)
                ok = real & good[row, child]
                queued[row[ok], child[ok]] = most[row[ok], child[ok]]
            else:
                rows = which[:, None] * LEAF + np.arange(LEAF)
                real = rows < len(points)
                rows = np.where(real, rows, 0)
                score = np.einsum("brd,bd->br", points[rows], a[who]).astype(np.int64)  # an error where one does not fit
                ok = real & keeps(who, rows)
                opened += len(who)
                for w in range(lists.shape[1]):
                    best.put(lists[who, w], tree["ids"][rows], score, ok & (score >= low[who, w][:, None]) & (score <= high[who, w][:, None]))
    return opened


def _read_trees(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch[k][i].as_py() if k == "dim" else batch[k][i].values.to_numpy() for k in batch.schema.names}


def _found(asked, k: int, same: bool):
    """A task's best k of all its trees for each list of a block of anchors: of the anchor's label (same) or of other labels."""

    def run(batches):
        id_, label, by_dim, low, high = asked.value
        lists = np.arange(low.size).reshape(low.shape)
        best = Best(low.size, k)
        for tree in _read_trees(batches):
            if tree["dim"] not in by_dim:
                continue
            row, x = by_dim[tree["dim"]]
            for at in range(0, len(row), AT_ONCE):
                r = row[at : at + AT_ONCE]
                mine = label[r]
                if same:
                    wants = lambda first, last, m=mine: (first <= m[:, None]) & (last >= m[:, None])
                    keeps = lambda who, rows, m=mine, i=id_[r]: (tree["labels"][rows] == m[who][:, None]) & (tree["ids"][rows] != i[who][:, None])  # noqa: E731, B023
                else:
                    wants = lambda first, last, m=mine: (first != m[:, None]) | (last != m[:, None])
                    keeps = lambda who, rows, m=mine: tree["labels"][rows] != m[who][:, None]  # noqa: E731, B023
                best_first(tree, x[at : at + AT_ONCE], wants, keeps, best, lists[r], low[r], high[r])
        at, place = np.nonzero(best.there)
        for a in range(0, len(at), 8192):
            s = slice(a, a + 8192)
            yield pa.RecordBatch.from_pydict({"list": at[s], "id": best.ids[at[s], place[s]], "score": best.scores[at[s], place[s]]})

    return run


def _search(trees: DataFrame, t: pa.Table, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """(list, rank, id, score) of the first k rows of every list of a block; list = row of t * windows + window."""
    dims = np.array(t["x"].combine_chunks().value_lengths())
    by_dim = {d: (np.flatnonzero(dims == d), matrix(t["x"].filter(pa.array(dims == d)), d, np.int64)) for d in np.unique(dims).tolist()}
    asked = trees.sparkSession.sparkContext.broadcast((t["id"].to_numpy(), t["label"].to_numpy(), by_dim, low, high))
    found = trees.mapInArrow(_found(asked, k, same), "list long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, block_rows: int = BLOCK_ROWS // 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over saved tables of taking_part().

    An anchor's positives are its first `positives` rows of its label and of another id, by falling score, then id. The negatives of a positive are the
    first `negatives` rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score; a negative
    positive_score leaves that window empty. Vectors of another length than the anchor's are not compared. Different rows under one id are
    rows of their own. Anchors without positives, positives without negatives and empty tables give no rows.
    """
    spark, trees, out = rows.sparkSession, index(rows, shard_rows), None
    for t in blocks(anchors, "id", block_rows):
        n = len(t)
        everything = np.full((n, 1), LOWEST + 1), np.full((n, 1), HIGHEST)
        near = save(_search(trees, t, *everything, positives, True), "positives")
        p = near.toArrow()  # block_rows * positives at most
        score, pid, window = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64), np.zeros((n, positives), bool)
        at = p["list"].to_numpy(), p["rank"].to_numpy() - 1
        score[at], pid[at], window[at] = p["score"].to_numpy(), p["id"].to_numpy(), True
        # bounds rounded inwards, in whole hundreds and the rest, so that no product leaves a long; no positive: an empty window
        whole, rest = score // 100, score % 100
        low = np.where(window, least * whole - (-least * rest) // 100, 1)
        high = np.where(window, most * whole + most * rest // 100, 0)
        found = _search(trees, t, low, high, negatives, False).withColumn("anchor", F.expr(f"list div {positives}")).withColumn("place", F.expr(f"cast(list % {positives} + 1 as int)"))
        # the block's anchors and positives come back to Spark as one small table, bounded like the block
        named = spark.createDataFrame(
            pa.table({"list": np.flatnonzero(window.ravel()), "anchor_id": np.repeat(t["id"].to_numpy(), positives)[window.ravel()], "positive_id": pid[window], "positive_score": score[window]})
        )
        part = found.join(named, "list").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = save(part, "negatives")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


def op12_rtree_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of embeddings whose vec_id is divisible by 100; the label of every seventh id is moved on by one first."""
    df = read(spark, sf_dir, "embeddings")
    moved = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = save(taking_part(moved), "rows")
    return hard_negatives(rows, save(rows.where("id % 100 = 0"), "anchors"))


SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON b.vec_id <> a.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = anchor_label
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score WHERE p.place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
