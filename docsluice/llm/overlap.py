"""Near-duplicates by SimHash with BK-trees, made exact: rows whose sets of five-word shingles have a Jaccard
similarity of 4/5 or more are linked, and no such link is lost.

Fingerprints alone cannot say this: texts of similarity 4/5 differ in about ten of 64 bits, and BK-trees with a
radius that catches nearly all of them visit nearly all nodes. So the trees propose the closest texts
(fingerprints of the same shingles within simhash.RADIUS bits), prefix filtering proposes what the trees cannot see, and each
proposal is checked on the whole sets. Where many texts meet, only those that are not connected yet are compared further.

Prefix filtering: if two sets are that similar and both are listed in one common order, they share a shingle among
their first ones, and at the first that they share enough of both lists must still follow (see BOUND). Any order
will do for that; shingles that are frequent in a sample go last, so a passage that many texts share is looked up only by
texts that have little else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import discard, few, give_back, row_key, same_key, save, utf8
from .components import components
from .simhash import SEED, print_links, shingle_hashes, vote

SHINGLE = 5
#: Texts of the sample for the order, which has one text of RATE at least however many there are, and the most frequent shingles that it may name. With one of 32
#: a shingle of a hundred texts is seen twice, so what only chance brings together is no crowd, whatever the size of the table.
SAMPLE, RATE, MOST_FREQUENT = 4_000, 32, 100_000
#: Where sets meet at a shingle each is first compared with one of them: once, and again, up to ROUNDS times, while a set still meets
#: more than CROWD others on average and a turn leaves at most half of the places. Then all that are left are compared.
CROWD, ROUNDS = 64, 4
#: Of crowds then left, sets of up to SMALL hashes are compared inside tasks, TILE against TILE sets and there STRIP against STRIP; larger ones are as many words of text each.
#: Hashes that several sets of a tile have are columns of a matrix if they are WIDE or fewer, and products of it are exact.
SMALL, TILE, STRIP, WIDE = 2_048, 2_048, 1_024, 8_192
#: Hashes a part of the hashes' range, of which a set has a power of two: LEAST_PARTS to MOST_PARTS. The sum of the smaller
#: counts in all parts bounds what two sets share.
PART, LEAST_PARTS, MOST_PARTS = 2, 32, 1 << 14
#: Hashes that a worker sends at once.
SENT = 1 << 18
#: At the first shingle that x and y share, at most the shorter rest of the two lists is shared: J >= 4/5 needs 9 * shared >= 4 * (n + n).
BOUND = "9 * least(x.n - x.at, y.n - y.at) >= 4 * (x.n + y.n)"


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(np.concatenate([*shingle_hashes(text, shingle), np.zeros(0, "<u8")]).view("<i8"))


def _digest(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def counts(h: np.ndarray) -> np.ndarray:
    """How many hashes lie in each part of their range."""
    bits = int(np.clip(len(h) // PART, LEAST_PARTS, MOST_PARTS)).bit_length() - 1
    return np.bincount((h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int16)


def sets(df: DataFrame, text_col: str) -> DataFrame:
    """(s, n, hashes) of each row of df: the digest of its set, its size and its sorted hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for t in pdf["text"]:
                h = shingles(t)
                out.append((np.uint64(_digest(h)).astype(np.int64), len(h), h))
                size += len(h)
                if size >= SENT:
                    yield pd.DataFrame(out, columns=["s", "n", "hashes"])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["s", "n", "hashes"])
        give_back()

    return df.select(utf8(text_col).alias("text")).mapInPandas(run, "s long, n int, hashes array<long>")


def frequent(df: DataFrame, text_col: str) -> np.ndarray:
    """Shingles of several texts of the sample, rarer ones first. The sample goes by the texts, so it is the same on every run; what stands in some
    hundred texts is seen in it, whatever the size of the table."""
    every = min(RATE, max(1, df.count() // SAMPLE))
    some = df.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    listed = sets(some, "text").dropDuplicates(["s"]).select(F.explode("hashes").alias("h"))
    top = listed.groupBy("h").count().where("count >= 2").orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).collect()
    return np.array([r["h"] for r in reversed(top)], dtype=np.int64)


def lookups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x, y, s, n, p, counts, hashes) of every row: its key, the digest and the size of its set, the fingerprint of
    its shingles, how many hashes lie in each part of their range, and the first hashes in the common order, by which
    the set is looked up. The one scan of all texts."""
    last = frequent(df, text_col)
    by_value = np.argsort(last)

    def prefix(h: np.ndarray) -> np.ndarray:
        many = len(h) - (4 * len(h) + 4) // 5 + 1 if len(h) else 0
        if len(last):
            at = by_value[np.minimum(np.searchsorted(last, h, sorter=by_value), len(last) - 1)]
            known = last[at] == h
            h = np.concatenate([h[~known], last[np.sort(at[known])]])
        return h[:many]

    @F.pandas_udf("s long, n int, p long, counts array<smallint>, hashes array<long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                pieces = list(shingle_hashes(t, SHINGLE))
                h = np.unique(np.concatenate([*pieces, np.zeros(0, "<u8")]).view("<i8"))
                rows.append((np.uint64(_digest(h)).astype(np.int64), len(h), vote(pieces), counts(h), prefix(h)))
            yield pd.DataFrame(rows, columns=["s", "n", "p", "counts", "hashes"])
        give_back()

    f = df.select(*row_key(id_col, text_col), found(utf8(text_col)).alias("f"))
    return save(f.select("id", "x", "y", "f.s", "f.n", "f.p", "f.counts", "f.hashes"), "lookups")


def shared(rows: DataFrame) -> DataFrame:
    """(h, s, n, at): each distinct set's place at each shingle by which several sets are looked up. Copies are one set."""
    one = rows.groupBy("s").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    keys = one.select("s", "n", F.posexplode("hashes").alias("at", "h")).repartition("h")
    # of two sets the smaller one meets the bound only in the first ninth of its list
    first = F.when(9 * F.col("at") <= F.col("n"), F.col("s"))  # no filter, so both sides of the join have one exchange
    several = keys.groupBy("h").agg(F.min(first).alias("low"), F.max(first).alias("high"))
    return save(keys.join(several, "h").where("s <> low OR low <> high").select("h", "s", "n", "at"), "shared")


def _live(places: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """Places at shingles where sets of several components meet, each with its component c and one of the sets there, y."""
    places = places.select("h", "x.s", "x.n", "x.at") if "x" in places.columns else places
    x = places.withColumn("c", F.col("s")) if roots is None else places.join(roots, "s", "left").select("h", "s", "n", "at", F.coalesce("root", "s").alias("c"))
    some = F.struct(F.xxhash64("s", F.lit(turn)).alias("rank"), "s", "n", "at", "c")
    met = x.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.when(F.col("at") * 9 <= F.col("n"), some)).alias("y"), F.count("*").alias("k")).where("low <> high AND y IS NOT NULL")
    return save(x.join(met, "h").select("h", F.struct("s", "n", "at", "c").alias("x"), "y", "k"), "live")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct()


def labels(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(s, root): smaller labels for linked sets, two steps along the links from those that they have; not yet the components, but never
    the same for sets that are not connected."""
    known = links.select(F.col("a").alias("s"), F.col("a").alias("root")).limit(0) if roots is None else roots
    one, two = known.toDF("a", "ra"), known.toDF("b", "rb")
    e = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v")).where("u <> v")
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = e.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
    far = e.join(near.toDF("v", "mv"), "v").groupBy("u").agg(F.min("mv").alias("m")).unionByName(near).groupBy("u").agg(F.min("m").alias("m"))
    named = links.select(F.col("a").alias("s")).unionByName(links.select(F.col("b").alias("s"))).unionByName(known.select("s")).distinct().join(known, "s", "left")
    return save(named.withColumn("u", F.coalesce("root", "s")).join(far, "u", "left").select("s", F.coalesce("m", "u").alias("root")), "labels")


def with_one(live: DataFrame) -> DataFrame:
    """Candidates (a, b): each set with the one that its shingle names. Rows grow with the places, not with their pairs."""
    return _ordered(live.where(f"x.c <> y.c AND {BOUND}"))


def with_all(live: DataFrame, where: str = "true") -> DataFrame:
    """Candidates (a, b): all sets of different components that meet at a shingle within the bound."""
    x, y = live.select("h", "x", "k"), live.select("h", F.col("x").alias("y")).where("9 * y.at <= y.n")
    return _ordered(x.join(y, "h").where(f"x.c <> y.c AND {BOUND}").where(where))


def _columns(hashes: list[np.ndarray]) -> tuple[list[np.ndarray], int, bool]:
    """(columns of each set, their number, whether products of them are exact): a column for each hash that several sets have; if these are too many, one for
    each remainder of the hashes."""
    values, at, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    several = times > 1
    if exact := int(several.sum()) <= WIDE:
        width, at, kept = max(1, int(several.sum())), (np.cumsum(several) - 1)[at], several[at]
    else:
        width = 1 << int(np.clip(16 * max(map(len, hashes)), 1_024, WIDE)).bit_length() - 1
        at, kept = (values.view(np.uint64) % np.uint64(width)).astype(np.int64)[at], np.ones(len(at), bool)
    ends = np.cumsum([len(h) for h in hashes])
    return [at[b - len(h) : b][kept[b - len(h) : b]] for b, h in zip(ends.tolist(), hashes, strict=True)], width, exact


def _bits(columns: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(columns), width), np.float32)
    for i, c in enumerate(columns):
        out[i, c] = 1
    return out


def linked(s: np.ndarray, n: np.ndarray, c: np.ndarray, block: np.ndarray, hashes: list[np.ndarray], i: int, j: int) -> list[tuple[int, int]]:
    """Similar pairs of block i with block j, so many as connect what is similar: sets of one component, or connected already, are not compared.

    Products of bit rows, a strip at a time, are what two sets share. If there are too many hashes for that they bound it, with what collides inside a set added;
    only pairs that the bound leaves are intersected.
    """
    own = {v: v for v in c.tolist()}

    def root(v: int) -> int:
        while own[v] != v:
            own[v] = own[own[v]]
            v = own[v]
        return v

    columns, width, exact = _columns(hashes)
    lost = np.zeros(len(s), np.int64) if exact else n - np.array([len(np.unique(x)) for x in columns])
    out = []

    def strip(one: np.ndarray, two: np.ndarray, bits: np.ndarray, same: bool) -> None:
        now = np.array([root(v) for v in c.tolist()])
        other = bits if same else _bits([columns[k] for k in two], width)
        most = bits @ other.T + np.minimum(lost[one][:, None], lost[two][None, :])
        may = (9 * most >= 4 * (n[one][:, None] + n[two][None, :])) & (now[one][:, None] != now[two][None, :])
        if same:
            may &= np.arange(len(one))[:, None] < np.arange(len(two))[None, :]
        for x, y in zip(*(v[k].tolist() for v, k in zip((one, two), np.nonzero(may), strict=True)), strict=True):
            a, b = root(int(c[x])), root(int(c[y]))
            if a != b and (exact or 9 * len(np.intersect1d(hashes[x], hashes[y], assume_unique=True)) >= 4 * (n[x] + n[y])):
                own[max(a, b)] = min(a, b)
                out.append((int(s[x]), int(s[y])))

    first, second = ([v[k : k + STRIP] for k in range(0, len(v), STRIP)] for v in (np.flatnonzero(block == i), np.flatnonzero(block == j)))
    for x, one in enumerate(first):
        bits = _bits([columns[k] for k in one], width)
        for y, two in enumerate(second):
            if i != j or x <= y:
                strip(one, two, bits, i == j and x == y)
    return out


def _hashes(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t) for t in texts], dtype=object)

    return run(text)


def in_tiles(live: DataFrame, df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between the small sets of crowds, k sets that meet at one shingle. A crowd's sets are dealt to blocks, and each pair of blocks is one
    task's work with the sets whole, so no pair becomes a row unless it is a link. A set is made where its text is and moves once for each of its places."""
    crowd = live.where((F.col("k") > CROWD) & (F.col("x.n") <= SMALL) & F.expr("5 * (x.n - x.at) >= 4 * x.n")).select("h", "x.s", "x.n", "x.c", F.ceil(F.col("k") / TILE).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct("h", F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), "block", "n", "c"))
    placed = save(crowd.withColumn("block", mine).groupBy("s").agg(F.flatten(F.collect_list(cells)).alias("cells")), "placed")
    made = _texts(placed, df, rows, id_col, text_col).select("s", "cells", _hashes(utf8("text")).alias("hashes"))

    def tile(key, t):
        h = t["hashes"].combine_chunks()
        flat, ends = h.flatten().to_numpy(), h.offsets.to_numpy() - h.offsets[0].as_py()
        sets_ = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        pairs = linked(*(t[x].to_numpy() for x in ("s", "n", "c", "block")), sets_, key[1].as_py(), key[2].as_py())
        return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})

    each = made.select("s", F.explode("cells").alias("cell"), "hashes").select("s", "cell.*", "hashes")
    out = save(each.groupBy("h", "i", "j").applyInArrow(tile, "a long, b long").distinct(), "tiles")
    discard(placed)
    return out


def _counts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(s, n, k) of the sets of a pair."""
    named = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    return save(rows.select("s", "n", "counts").join(named, "s", "left_semi").groupBy("s").agg(F.first("n").alias("n"), F.first("counts").alias("k")), "counts")


def possible(pairs: DataFrame, counted: DataFrame) -> DataFrame:
    """The pairs that their sets' counts leave possible; no similar pair is lost. Similar sets have equal numbers of parts, or
    one has twice those of the other. Moves a small number for every few shingles."""

    def folded(k: Column, to: Column) -> Column:
        return F.when(F.size(k) == to, k).otherwise(F.transform(F.sequence(F.lit(0), to - 1), lambda i: (F.get(k, 2 * i) + F.get(k, 2 * i + 1)).cast("smallint")))

    one, two = (counted.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}")) for x in "ab")
    near = 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")
    parts = F.least(F.size("ka"), F.size("kb"))
    most = F.aggregate(F.zip_with(folded(F.col("ka"), parts), folded(F.col("kb"), parts), lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return pairs.join(one, "a").join(two, "b").where(near).where(9 * most >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _texts(named: DataFrame, df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The named sets' rows (s and whatever else) with the text of one row of each. Texts stay where they are if the sets are few; only if one of
    those rows is repeated as it is are texts shuffled to drop the others."""
    each = rows.join(named, "s", "left_semi").groupBy("s", "id", "x", "y").agg(F.count("*").alias("times"))
    first = each.groupBy("s").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "x", "y", "times")).alias("k"))
    keys = save(named.join(first.select("s", F.col("k.id").alias("key_id"), F.col("k.x").alias("key_x"), F.col("k.y").alias("key_y"), "k.times"), "s"), "candidates")
    more = F.sum(6 * F.size("cells")) if "cells" in named.columns else F.lit(0)
    n, values, times = keys.agg(F.count("*"), 4 * F.count("*") + F.coalesce(more, F.lit(0)), F.max("times")).first()
    texts = df.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(keys) if few(values) else keys, same_key("key_"), "inner").select(*named.columns, "text")
    return found.dropDuplicates(["s"]) if n and times > 1 else found


def _whole(named: DataFrame, df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(s, n, hashes) of the named sets, made of one text of each, saved."""
    return save(sets(_texts(named, df, rows, id_col, text_col), "text"), "whole")


def checked(pairs: DataFrame, df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose whole sets have the similarity. Only the sets of texts in a possible pair are made and moved."""
    proposed = save(pairs, "pairs")
    counted = _counts(proposed, rows)
    pairs = save(possible(proposed, counted), "possible")
    discard(proposed, counted)
    named = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    whole = _whole(named, df, rows, id_col, text_col)
    one, two = whole.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha")), whole.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    out = save(pairs.join(one, "a").join(two, "b").where(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), "similar")
    discard(pairs, whole)
    return out


def similar_pairs(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All pairs (a, b) of distinct sets of rows with a Jaccard similarity of 4/5 or more; in a group of near copies these are many."""
    return checked(with_all(_live(shared(rows), None, 0)), df, rows, id_col, text_col)


def proposals(rows: DataFrame) -> DataFrame:
    """Candidates (a, b) of the BK-trees: sets of one fingerprint with the first of it, and firsts of linked fingerprints."""
    firsts = save(rows.groupBy("p").agg(F.min("s").alias("f")), "firsts")
    same = rows.select("s", "p").distinct().join(firsts, "p").where("s <> f").select(F.col("f").alias("a"), F.col("s").alias("b"))
    links = save(print_links(firsts.select("p")), "links")
    a, b = firsts.select(F.col("p").alias("a"), F.col("f").alias("fa")), firsts.select(F.col("p").alias("b"), F.col("f").alias("fb"))
    near = links.join(a, "a").join(b, "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    return same.unionByName(near).distinct()


def groups(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, x, y, g), g being the digest of the row's set, and (g, root) of the sets that are linked to others.

    Sets are linked over similar pairs. First those that the trees propose are compared, and each set with one of those that it
    meets at a shingle; where components still differ and many meet, again; then all that still meet are compared. A group of near copies is connected by then, so it never gives all its pairs. Texts without words, null ones too, have equal
    sets.
    """
    rows = lookups(df, id_col, text_col)
    places, roots, links, left = shared(rows), None, None, 0
    for turn in range(ROUNDS + 1):
        before, live = places, _live(places, roots, turn)
        discard(before)
        n, crowd, largest = live.agg(F.count("*"), F.avg("k"), F.max("k")).first()
        if turn and not n:
            break
        final = turn and (turn == ROUNDS or crowd <= CROWD or 2 * n > left)
        left = n
        # of a crowd no pair becomes a row: its small sets are compared in tiles
        pairs = with_all(live.where(f"k <= {CROWD} OR 5 * x.n >= 4 * {SMALL}"), f"k <= {CROWD} OR greatest(x.n, y.n) > {SMALL}") if final else with_one(live)
        found = checked(pairs if turn else proposals(rows).unionByName(pairs).distinct(), df, rows, id_col, text_col)
        if final and largest > CROWD:
            found = found.unionByName(in_tiles(live, df, rows, id_col, text_col))
        links = found if links is None else links.unionByName(found)
        if final:
            break
        roots = labels(found, roots)
        places = live
    roots = components(links).select(F.col("node").alias("s"), "root")
    small = save(rows.select("id", "x", "y", F.col("s").alias("g")), "rows")
    discard(live, rows)
    return small, roots.select(F.col("s").alias("g"), "root")
