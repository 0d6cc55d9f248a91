"""Near-duplicates by SimHash fingerprints, found with BK-trees.

A BK-tree hangs each fingerprint below its parent by their integer Hamming distance, so a search with
radius r at distance d follows only the edges d - r to d + r. All trees together have no proven size
bound, so they are not broadcast: fingerprints are dealt to shard trees by some of their bits, such that
any two within the radius meet in at least one shard (see masks), and each shard's tree answers for
its own members; a shard of too many fingerprints is dealt again by more of their bits. Identical fingerprints
are one node, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import among, read, row_key, same_key, save, utf8
from .components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: How often bits are cut into parts for a shard; a large shard is cut again, at most to MOST_LEVELS.
LEVELS, MOST_LEVELS = 2, 5
_PIECE = 1 << 14
#: Nodes whose trees are grown together, and the most fingerprints of a shard that is not dealt again.
_FOREST = 1 << 15


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in pieces. A-Z are lowered; words end at space and \\t to \\r.
    A text of fewer words is one shingle, a text of none has no shingle."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, _PIECE):
        part = words[a : min(n, a + _PIECE) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [part]
        yield np.fromiter((digest(b" ".join(g), SEED) for g in grams), dtype="<u8")


def vote(pieces: Iterable[np.ndarray]) -> int:
    """Fingerprint as a signed long: a bit is set if it is set in more than half of the hashes; of none it is zero."""
    n, counts = 0, np.zeros(64, dtype=np.int64)
    for hashes in pieces:
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    return vote(shingle_hashes(text, shingle))


def fingerprint(text_col: str = "text") -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([simhash(t) for t in s], dtype="int64")

    return prints(utf8(text_col))


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks with more bits than `mask` (signed longs), such that two fingerprints within the radius that agree under
    `mask` agree under at least one: the other bits are cut into radius + 1 parts, and differing bits cannot spoil all."""
    rest = [x for x in range(64) if not mask >> x & 1]
    out = [mask % (1 << 64) | sum(1 << x for x in rest[k :: radius + 1]) for k in range(radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def masks(radius: int = RADIUS, levels: int = LEVELS) -> list[int]:
    """(radius + 1) ** levels masks of which any two fingerprints within the radius agree under one. With two levels and
    radius 2 a mask has 22 + 14 bits, and a shard holds only fingerprints that agree in so many."""
    out = [0]
    for _ in range(levels):
        out = [y for x in out for y in finer(x, radius)]
    return out


def grow(prints: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Children by distance (row: node, column: distance, -1: none) of a forest; root: first node of each node's tree."""
    child = np.full((len(prints), 65), -1, dtype=np.int64)
    flat = child.reshape(-1)
    todo = np.flatnonzero(root != np.arange(len(prints)))
    node = root[todo]
    while len(todo):
        edge = node * 65 + np.bitwise_count(prints[todo] ^ prints[node])
        free = np.flatnonzero(flat[edge] < 0)
        new, first = np.unique(edge[free], return_index=True)
        flat[new] = todo[free[first]]
        below = flat[edge]
        down = below != todo
        todo, node = todo[down], below[down]
    return child


def near(prints: np.ndarray, root: np.ndarray, child: np.ndarray, radius: int, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within the radius, for queries a to z; follows only edges within the radius."""
    query = np.arange(a, z)
    node = root[a:z]
    found = []
    while len(query):
        d = np.bitwise_count(prints[query] ^ prints[node]).astype(np.int64)
        hit = (d <= radius) & (node < query)
        found.append((query[hit], node[hit]))
        nexts = []
        for k in range(-radius, radius + 1):
            ok = np.flatnonzero((d + k >= 1) & (d + k <= 64))
            c = child[node[ok], d[ok] + k]
            some = c >= 0
            nexts.append((query[ok[some]], c[some]))
        query, node = (np.concatenate(x) for x in zip(*nexts, strict=True))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (query, query)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; label[i] is the smallest member of the set of i."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(label, label[label]):
            label = label[label]


def links(prints: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its group) for the groups that links within the radius form in each shard.

    prints are distinct within a shard, shards contiguous.
    """
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    root = np.repeat(starts, np.diff(np.append(starts, len(shard))))
    child = grow(prints, root)
    label = np.arange(len(prints))
    for a in range(0, len(prints), 4096):
        label = _union(label, *near(prints, root, child, radius, a, min(a + 4096, len(prints))))
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def _link_shards(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Over rows (m, key, p) sorted by all three; a shard may run over several batches."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out(m: np.ndarray, key: np.ndarray, p: np.ndarray) -> Iterator[pd.DataFrame]:
        same = (m[1:] == m[:-1]) & (key[1:] == key[:-1])
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        begins = np.concatenate([[True], ~same])
        shard = np.cumsum(begins)[several]
        p = p[several]
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        at = 0
        while at < len(p):
            later = cuts[cuts >= at + _FOREST]
            to = int(later[0]) if len(later) else len(p)
            a, b = links(p[at:to], shard[at:to], radius)
            if len(a):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
            at = to

    for pdf in batches:
        m, key, p = pdf["m"].to_numpy(), pdf["key"].to_numpy(), pdf["p"].to_numpy().view(np.uint64)
        change = np.flatnonzero((m[1:] != m[:-1]) | (key[1:] != key[:-1]))
        whole = int(change[-1]) + 1 if len(change) else 0
        if held and (whole or m[0] != held[0][0][0] or key[0] != held[0][1][0]):
            if m[0] == held[0][0][0] and key[0] == held[0][1][0]:
                held.append((m[:whole], key[:whole], p[:whole]))
                yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))
            else:
                yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))
                if whole:
                    yield from out(m[:whole], key[:whole], p[:whole])
            held = [(m[whole:], key[whole:], p[whole:])]
        elif held:
            held.append((m, key, p))
        else:
            if whole:
                yield from out(m[:whole], key[:whole], p[:whole])
            held = [(m[whole:], key[whole:], p[whole:])]
    if held:
        yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _dealt(rows: DataFrame, under: list[int] | Column) -> DataFrame:
    """Rows (m, key, p) of fingerprints p, one for each mask."""
    many = F.array(*[F.lit(m) for m in under]) if isinstance(under, list) else under
    dealt = rows.select("p", F.explode(many).alias("m"))
    return dealt.select("m", F.col("p").bitwiseAND(F.col("m")).alias("key"), "p")


def shards(prints: DataFrame, column: str = "p", radius: int = RADIUS) -> DataFrame:
    """(m, key, p): the members p of each shard (m, key). A shard of more than _FOREST members is dealt again by finer
    masks. At radius 2, five levels leave 8 bits free, so no shard stays large, however alike the fingerprints are."""
    level, now, at = LEVELS, _dealt(prints.select(F.col(column).alias("p")), masks(radius)), masks(radius)
    done = None
    while True:
        large = save(now.groupBy("m", "key").count().where(F.col("count") > _FOREST).select("m", "key"), "large")
        settled = level >= MOST_LEVELS or large.isEmpty()
        part = now if settled else now.join(large, ["m", "key"], "left_anti").select("m", "key", "p")
        done = part if done is None else done.unionByName(part)
        if settled:
            return done
        below = F.create_map(*[x for m in at for x in (F.lit(m), F.array(*[F.lit(y) for y in finer(m, radius)]))])
        again = now.join(large, ["m", "key"], "left_semi").select("p", below[F.col("m")].alias("below"))
        now, level, at = save(_dealt(again, F.col("below")), "dealt"), level + 1, [y for m in at for y in finer(m, radius)]


def print_links(prints: DataFrame, column: str = "p", radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within the radius: a forest in each shard."""
    dealt = shards(prints, column, radius).repartition("m", "key").sortWithinPartitions("m", "key", "p")
    return dealt.mapInPandas(partial(_link_shards, radius=radius), "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as long, component_id) of every row of df.

    Rows are linked if their fingerprints differ in RADIUS bits or fewer; component_id is the smallest id
    reachable. Texts without words, null ones too, have fingerprint zero and are linked like any other.
    Null ids never name a component: their rows carry the smallest id of their component, null if it
    has none. Repeated rows give repeated results. Texts are read once; all else works on 16 bytes a row.
    """
    rows = save(df.select(F.col(id_col).alias("id"), fingerprint(text_col).alias("p")), "prints")
    groups = save(rows.groupBy("p").agg(F.min("id").alias("least"), F.count("*").alias("n")), "groups")
    linked = save(components(print_links(groups.select("p"))), "linked")
    roots = linked.join(groups, linked["node"] == groups["p"]).groupBy("root").agg(F.min("least").alias("c"))
    of_linked = linked.join(save(roots, "roots"), "root").select(F.col("node").alias("p"), "c")
    of_equal = groups.where("n > 1").join(linked, F.col("p") == F.col("node"), "left_anti").select("p", F.col("least").alias("c"))
    named = save(of_linked.unionByName(of_equal).withColumn("named", F.lit(True)), "named")
    out = rows.join(named, "p", "left")
    return out.select(F.col("id").alias(id_col), F.col("p").alias("fingerprint"), F.when(F.col("named"), F.col("c")).otherwise(F.col("id")).alias("component_id"))


def print_groups(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, x, y, g), g being the fingerprint, and (g, root) of the fingerprints that are linked to others."""
    rows = save(df.select(*row_key(id_col, text_col), fingerprint(text_col).alias("g")), "prints")
    linked = components(print_links(rows.select("g").distinct(), "g"))
    return rows, save(linked.select(F.col("node").alias("g"), "root"), "linked")


def surplus(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys (id, x, y) that are not the first of their component, keys of the first that several rows have).

    A component is all rows whose g has one root. Its first key is that of the smallest id, then of the smallest hash of
    the text; null ids come last. Works on 32 bytes a row, summed up by key before the shuffle."""
    keys = rows.groupBy("id", "x", "y", "g").agg(F.count("*").alias("n"))
    keys = save(keys.join(roots, "g", "left").select("id", "x", "y", "n", F.coalesce("root", "g").alias("c")), "keys")
    order = F.struct(F.col("id").isNull().alias("no"), "id", "x", "y")
    first = keys.groupBy("c").agg(F.min(order).alias("f"), F.count("*").alias("keys")).where("keys > 1").select("c", "f")
    later = keys.join(first, "c").where(~F.struct(F.col("id").isNull().alias("no"), "id", "x", "y").eqNullSafe(F.col("f"))).select("id", "x", "y")
    later = save(later, "later")
    again = keys.where("n > 1").join(later.toDF("later_id", "later_x", "later_y"), same_key("later_"), "left_anti").select("id", "x", "y")
    return later, save(again, "again")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., tuple[DataFrame, DataFrame]] = print_groups) -> DataFrame:
    """The rows of df without near-duplicates: of each component that `find` names, one row.

    It is the row of the smallest id, then of the smallest hash of the text; each row counts for itself, so of
    two rows of one id and different texts one may go and the other stay. Rows without an id come last: one stays only
    if its component has no id at all. Of rows of equal id and text the first by the hash of all columns stays.
    Columns stay as they are, whatever their names. Texts move only if more rows go than base.few allows for.
    """
    later, again = surplus(*find(df, id_col, text_col))
    kept = df if later.isEmpty() else among(df, later, id_col, text_col, "left_anti")
    if again.isEmpty():
        return kept
    several = among(kept, again, id_col, text_col, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = several.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(row_key(id_col, text_col))]).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return among(kept, again, id_col, text_col, "left_anti").unionByName(one)


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see near_duplicates for nulls, ties and empty texts."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
