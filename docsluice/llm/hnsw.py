"""Operator 11: nearest neighbours by cosine over hierarchical navigable small-world graphs, one a shard.

Equal vectors are one node, which carries the smallest ids that a query can need, so a vector that a third of all rows have
costs one node and ties are exact. Nodes are dealt to shards by hash. A task builds the graph of its shard by inserting
nodes in batches: a batch descends through the layers and searches the graph so far, all its nodes at once in numpy, and
compares itself with itself; neighbours are chosen by the diversity rule, and full lists are chosen anew. A graph is a row of a
saved table: vectors, ids and, for each layer, one flat array of neighbours. Nodes are numbered by falling layer, so each
layer is a prefix. Queries are taken in blocks of bounded size, which every task holds while it walks its graphs; each task
gives the best of all its graphs, and these are merged.

Nothing is quantised and every row is in a graph. Found rows are scored anew in double precision on the original vectors, so
the search is approximate only in what it finds: tests measure its recall against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import read, save
from .vectors import BLOCK_ROWS, blocks, matrix, shard_count, shards, usable

#: Nodes of a graph at most; neighbours of a node above the lowest layer (twice as many there); nodes that a search keeps, while
#: building and while asking; nodes inserted or queries asked at once.
SHARD_ROWS, LINKS, KEEP_BUILD, KEEP_ASK, AT_ONCE = 8192, 16, 64, 112, 256


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double, each times a power of two, so that no norm over- or underflows and no cosine changes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def walk(points: np.ndarray, links: np.ndarray, asked: np.ndarray, start: np.ndarray, keep: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), each (queries, keep), unordered, -1 where fewer: best-first search of one layer for many queries at once.

    A query expands its nearest open node until all the nodes that it keeps are expanded. n: nodes of the layer so far.
    """
    b = len(asked)
    seen = np.zeros((b, n + 1), bool)  # the last column is where no node is
    ids, sims, closed = np.full((b, keep), -1, np.int64), np.full((b, keep), -np.inf, np.float32), np.ones((b, keep), bool)
    s = min(keep, start.shape[1])
    ids[:, :s] = start[:, :s]
    there = ids[:, :s] >= 0
    sims[:, :s] = np.where(there, np.einsum("bsd,bd->bs", points[ids[:, :s]], asked), -np.inf)
    closed[:, :s] = ~there
    np.put_along_axis(seen, np.where(there, ids[:, :s], n), True, axis=1)
    live = np.arange(b)
    while True:
        waiting = np.where(closed[live], -np.inf, sims[live])
        j = waiting.argmax(axis=1)
        go = waiting[np.arange(len(live)), j] > -np.inf
        live, j = live[go], j[go]
        if not live.size:
            return ids, sims
        closed[live, j] = True
        near = links[ids[live, j]]
        cell = np.where(near >= 0, near, n)
        new = (near >= 0) & ~seen[live[:, None], cell]
        seen[live[:, None], cell] = True
        sim = np.where(new, np.einsum("bmd,bd->bm", points[near], asked[live]), np.float32(-np.inf))
        every = np.concatenate([sims[live], sim], axis=1)
        best = np.argpartition(-every, keep - 1, axis=1)[:, :keep]
        sims[live] = np.take_along_axis(every, best, axis=1)
        ids[live] = np.where(sims[live] > -np.inf, np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, axis=1), -1)
        closed[live] = np.take_along_axis(np.concatenate([closed[live], ~new], axis=1), best, axis=1)


def diverse(points: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """(rows, most) of the candidates (-1: none): those nearer to the row than to any that was chosen before, nearest first;
    free places go to the nearest of the others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
    v = points[near]
    pair = v @ v.transpose(0, 2, 1)
    taken, closest, count = np.zeros(near.shape, bool), np.full(near.shape, -np.inf, np.float32), np.zeros(len(near), int)
    for j in range(near.shape[1]):
        ok = (near[:, j] >= 0) & (count < most) & (sims[:, j] > closest[:, j])
        taken[:, j] = ok
        count += ok
        np.maximum(closest, pair[:, j], out=closest, where=ok[:, None])
    first = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(near, first, axis=1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def link_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Give the chosen nodes their new neighbours; a list that overflows is chosen anew from both."""
    most = links.shape[1]
    src = np.repeat(new, chosen.shape[1])[chosen.ravel() >= 0]
    dst = chosen.ravel()[chosen.ravel() >= 0]
    sim = np.einsum("nd,nd->n", points[src], points[dst])
    order = np.lexsort((-sim, dst))
    src, dst = src[order], dst[order]
    to, first, count = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(first, count)
    ok = place < most  # of more new neighbours than a list has places the nearest count
    more = np.full((len(to), min(most, count.max(initial=0))), -1, np.int64)
    more[np.repeat(np.arange(len(to)), count)[ok], place[ok]] = src[ok]
    every = np.sort(np.concatenate([links[to], more], axis=1), axis=1)[:, ::-1]
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1  # two nodes of a batch may have chosen each other
    every = np.sort(every, axis=1)[:, ::-1]
    full = (every >= 0).sum(axis=1) > most
    links[to[~full]] = every[~full, :most]
    if full.any():
        e, t = every[full], to[full]
        s = np.where(e >= 0, np.einsum("nmd,nd->nm", points[e], points[t]), np.float32(-np.inf))
        links[t] = diverse(points, e, s, most)


def reached(links: np.ndarray) -> np.ndarray:
    """The nodes that node 0 leads to."""
    out = np.zeros(len(links), bool)
    edge = np.array([0])
    while edge.size:
        out[edge] = True
        edge = np.unique(links[edge])
        edge = edge[edge >= 0]
        edge = edge[~out[edge]]
    return out


def connect(points: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The links, with one from the nearest node in reach to every node that was out of it."""
    while True:
        inside = reached(links)
        lost, base = np.flatnonzero(~inside), np.flatnonzero(inside)
        if not lost.size:
            return links
        to = np.concatenate([base[(points[lost[a : a + AT_ONCE]] @ points[base].T).argmax(axis=1)] for a in range(0, len(lost), AT_ONCE)])
        order = np.argsort(to, kind="stable")
        at, first, count = np.unique(to[order], return_index=True, return_counts=True)
        more = np.full((len(links), count.max()), -1, links.dtype)
        more[to[order], np.arange(len(to)) - np.repeat(first, count)] = lost[order]
        links = np.concatenate([links, more], axis=1)


def layers(n: int) -> np.ndarray:
    """The highest layer of each of n nodes, falling: the usual exponential draw, alike in every run."""
    u = np.random.default_rng(n).random(n)
    return np.sort((-np.log(1 - u) / np.log(LINKS)).astype(int))[::-1]


def build(points: np.ndarray) -> list[np.ndarray]:
    """The neighbours of each layer, lowest first: (nodes of the layer, places), -1 where none. Node 0 is the entry."""
    n, top = len(points), layers(len(points))
    sizes = [int((top >= k).sum()) for k in range(top[0] + 1)]
    links = [np.full((s, LINKS if k else 2 * LINKS), -1, np.int64) for k, s in enumerate(sizes)]
    at = 1
    while at < n:
        level = top[at]
        end = min(at + max(1, min(AT_ONCE, at // 2)), sizes[level])
        new, asked = np.arange(at, end), points[at:end]
        start = np.zeros((end - at, 1), np.int64)
        for k in range(top[0], level, -1):
            start, _ = walk(points, links[k], asked, start, 1, min(at, sizes[k]))
        among = asked @ asked.T
        np.fill_diagonal(among, -np.inf)
        for k in range(level, -1, -1):
            start, sims = walk(points, links[k], asked, start, KEEP_BUILD, at)
            near = np.concatenate([start, np.broadcast_to(new, among.shape)], axis=1)
            sims = np.concatenate([sims, among], axis=1)
            near = np.where(sims > -np.inf, near, -1)
            if near.shape[1] > KEEP_BUILD:
                best = np.argpartition(-sims, KEEP_BUILD - 1, axis=1)[:, :KEEP_BUILD]
                near, sims = np.take_along_axis(near, best, axis=1), np.take_along_axis(sims, best, axis=1)
            chosen = diverse(points, near, sims, LINKS)
            links[k][new, :LINKS] = chosen
            link_back(points, links[k], new, chosen)
        at = end
    links[0] = connect(points, links[0])
    return links


def search(points: np.ndarray, links: list[np.ndarray], asked: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of up to `keep` nodes near each query."""
    start = np.zeros((len(asked), 1), np.int64)
    for layer in links[:0:-1]:
        start, _ = walk(points, layer, asked, start, 1, len(layer))
    return walk(points, links[0], asked, start, keep, len(points))


GRAPH = "dim int, nodes int, vectors binary, kind string, ids array<long>, id_ends array<int>, links binary, layer_rows array<int>, layer_places array<int>"


def _graphs(rows: int):
    def run(batches):
        for dim, t in shards(batches, "v", rows):
            kind = np.float32 if pa.types.is_float32(t.schema.field("v").type.value_type) else np.float64
            v = matrix(t["v"], dim, kind)
            ids = t["ids"].combine_chunks()
            links = [x.astype(np.int32) for x in build(unit(scaled(v)))]
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()), "nodes": pa.array([len(v)], pa.int32()), "vectors": pa.array([v.tobytes()], pa.binary()), "kind": [np.dtype(kind).name],
                    "ids": pa.array([ids.flatten().to_numpy()], pa.list_(pa.int64())), "id_ends": pa.array([np.cumsum(np.diff(ids.offsets.to_numpy())).astype(np.int32)], pa.list_(pa.int32())),
                    "links": pa.array([b"".join(x.tobytes() for x in links)], pa.binary()), "layer_rows": pa.array([[x.shape[0] for x in links]], pa.list_(pa.int32())), "layer_places": pa.array([[x.shape[1] for x in links]], pa.list_(pa.int32())),
                }
            )

    return run


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of a table, a row each, saved in the shared folder; they answer searches for up to k neighbours.

    Rows without an id, without a vector, of zeros only or with components that are null or not finite are in none. Rows that repeat both id and vector count once. Ids are whole numbers.
    """
    v = F.col(vector_col)
    rows = df.where(usable(v) & F.exists(v, lambda x: x != 0)).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct()
    # the k + 1 smallest ids of a vector: one of them may be the query's own. Tasks keep no more of a vector before they shuffle
    least = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    nodes = save(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    n = shard_count(nodes.count(), shard_rows)
    return save(nodes.repartition(n, "v").mapInArrow(_graphs(shard_rows), GRAPH), "graphs")


def _merge(held: tuple, row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The first k pairs of each query row among those held and the new ones, by falling score, then id."""
    row, ids, score = (np.concatenate(x) for x in zip(held, (row, ids, score), strict=True))
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    first = np.searchsorted(row, row, side="left")
    ok = np.arange(len(row)) - first < k
    return row[ok], ids[ok], score[ok]


def _answers(asked, k: int, keep: int):
    """A task's best k of all its graphs for each query of a block."""

    def run(batches):
        qid, by_dim = asked.value
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            for g in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if g["dim"] not in by_dim:
                    continue
                row, q = by_dim[g["dim"]]
                v = scaled(np.frombuffer(g["vectors"], g["kind"]).reshape(g["nodes"], g["dim"]))
                points, norm = unit(v), np.linalg.norm(v, axis=1)
                ends, ids = np.array(g["id_ends"]), np.array(g["ids"], np.int64)
                starts, at, links = np.concatenate([[0], ends[:-1]]), 0, []
                for r, c in zip(g["layer_rows"], g["layer_places"], strict=True):
                    links.append(np.frombuffer(g["links"], np.int32, r * c, at).reshape(r, c))
                    at += r * c * 4
                for a in range(0, len(q), AT_ONCE):
                    near, _ = search(points, links, unit(q[a : a + AT_ONCE]), keep)
                    some = q[a : a + AT_ONCE]
                    score = np.einsum("bmd,bd->bm", v[near], some) / (norm[near] * np.linalg.norm(some, axis=1)[:, None])
                    score = np.where(near >= 0, score, -np.inf)
                    # k nodes besides the query's own, and all that are level with the last of them
                    least = np.partition(score, -min(k + 1, keep), axis=1)[:, -min(k + 1, keep)]
                    b, m = np.nonzero((near >= 0) & (score >= least[:, None]))
                    node = near[b, m]
                    many = ends[node] - starts[node]
                    r = np.repeat(row[a + b], many)
                    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[node], many)
                    other = ids[place] != qid[r]
                    held = _merge(held, r[other], ids[place][other], np.repeat(score[b, m], many)[other], k)
        row, ids, score = held
        for a in range(0, len(row), 8192):
            yield pa.RecordBatch.from_pydict({"row": row[a : a + 8192], "query_id": qid[row[a : a + 8192]], "vec_id": ids[a : a + 8192], "score": score[a : a + 8192]})

    return run


def neighbours(graphs: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, keep: int = KEEP_ASK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each query, a row's own id left out, ties to the smaller id.

    Queries take part like rows: those without an id or a usable vector have no result, repeated ones count once, and two
    different vectors under one id are two queries. Vectors of another length than the query's are not compared. An empty table or query set gives no rows.
    """
    v, spark = F.col(vector_col), queries.sparkSession
    asked = queries.where(usable(v) & F.exists(v, lambda x: x != 0)).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct()
    out = None
    for t in blocks(save(asked, "queries"), "id", block_rows):
        qid, dims = t["id"].to_numpy(), np.array(t["v"].combine_chunks().value_lengths())
        by_dim = {d: (np.flatnonzero(dims == d), scaled(matrix(t["v"].filter(pa.array(dims == d)), d, np.float64))) for d in np.unique(dims).tolist()}
        part = graphs.mapInArrow(_answers(spark.sparkContext.broadcast((qid, by_dim)), k, keep), "row long, query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
        part = save(part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "answers")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def op11_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other rows of every row of embeddings whose vec_id is divisible by 50."""
    df = read(spark, sf_dir, "embeddings")
    return neighbours(index(df), df.where(F.col("vec_id") % 50 == 0))
