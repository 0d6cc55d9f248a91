"""Benchmark decontamination by winnowing.

Of each run of WINDOW_HASHES consecutive hashes of GRAM words the smallest (the rightmost of equals) is a
fingerprint. Two texts that share GRAM + WINDOW_HASHES - 1 = SPAN words in a row share a fingerprint at the
same place of that span. Fingerprints of documents are joined with those of the test items; around each hit the runs of
SPAN words are then joined with those of the items, so every shared span is found and nothing else. Items of fewer
words are one window of their own length, and their own fingerprint.

Both joins are equi joins on 64-bit hashes of words, so Spark broadcasts a small benchmark and shuffles a large one; a frequent
fingerprint costs its places once, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .base import KEY, among, few, read, row_key, same_key, save, utf8

SPAN, GRAM = 10, 5
WINDOW_HASHES = SPAN - GRAM + 1
#: Fingerprints of a benchmark (8 bytes each) that tasks may hold, to drop others before the join. It saves time only.
MOST_KNOWN = 1 << 20


def winnow(b: W.Batch) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the fingerprints of all texts of a batch."""
    at, h = W.grams(b, GRAM)
    m = len(at) - WINDOW_HASHES + 1
    if m <= 0:
        return at[:0], h[:0]
    least, where = h[:m].copy(), np.arange(m)
    for k in range(1, WINDOW_HASHES):
        lower = h[k : k + m] <= least
        least[lower], where[lower] = h[k : k + m][lower], np.arange(k, k + m)[lower]
    whole = b.doc[at[:m]] == b.doc[at[WINDOW_HASHES - 1 :]]
    chosen = np.unique(where[whole])
    return at[chosen], h[chosen]


def windows(b: W.Batch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of each run of n words; hashes of different lengths differ."""
    at, h = W.grams(b, n)
    return at, W.mix(h + np.uint64(n))


def _by_text(b: W.Batch, at: np.ndarray, *values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The values of each text of a batch, given the ascending word indexes that they belong to."""
    cuts = np.searchsorted(b.doc[at], np.arange(b.n + 1)) if len(at) else np.zeros(b.n + 1, np.int64)
    return (tuple(v[a:z] for v in values) for a, z in zip(cuts[:-1], cuts[1:], strict=True))


def _packed(texts: list[bytes]) -> Iterator[tuple[W.Batch, int, int]]:
    for a, z in W.slices(texts):
        yield W.pack([t.lower() for t in texts[a:z]], W.ALNUM), a, z


def items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, length, prints, windows) of each test item with a word: the length of its windows, its fingerprints and windows.

    Items without words are left out; a null id reads as 'null'."""

    @F.pandas_udf("length int, prints array<long>, windows array<long>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for b, _, _ in _packed(list(s)):
                n = b.words_in()
                at, h = winnow(b)
                prints = [x[0] for x in _by_text(b, at, h)]
                whole = {k: [x[0] for x in _by_text(b, *windows(b, k))] for k in sorted({min(int(x), SPAN) for x in n if x})}
                for i, k in enumerate(min(int(x), SPAN) for x in n):
                    own = np.unique(whole[k][i]) if k else h[:0]
                    out.append((k, (np.unique(prints[i]) if k == SPAN else own).view(np.int64), own.view(np.int64)))
            yield pd.DataFrame(out, columns=["length", "prints", "windows"])

    f = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), cut(utf8(text_col)).alias("f"))
    return save(f.select("item", "f.length", "f.prints", "f.windows").where("length > 0"), "items")


def _prints(lengths: list[int], known) -> Callable[[Column], Column]:
    """Words of a text and the distinct fingerprints by which it is looked up; with `known` only those that are in it."""

    @F.pandas_udf("n_words long, prints array<long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keep = None if known is None else known.value
        for s in batches:
            n_words, prints = [], []
            for b, _, _ in _packed(list(s)):
                n_words.append(b.words_in())
                own = [[] for _ in range(b.n)]
                for at, h in [winnow(b), *(windows(b, k) for k in lengths)]:
                    h = h.view(np.int64)
                    if keep is not None and len(h):
                        ok = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h if len(keep) else np.zeros(len(h), bool)
                        at, h = at[ok], h[ok]
                    if len(h):
                        for i, (x,) in enumerate(_by_text(b, at, h)):
                            if len(x):
                                own[i].append(x)
                prints += [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in own]
            yield pd.DataFrame({"n_words": np.concatenate([*n_words, np.zeros(0, np.int64)]), "prints": prints})

    return found


def _near(lengths: list[int]) -> Callable[[Column, Column], Column]:
    """The windows of a text around its fingerprints `prints`: array<struct<w, first, until>>."""

    @F.pandas_udf("array<struct<w: long, first: long, until: long>>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, prints in batches:
            out = []
            for b, a, _ in _packed(list(texts)):
                at, h = winnow(b)
                start, whole = windows(b, SPAN)
                parts = zip(_by_text(b, at, at, h.view(np.int64)), _by_text(b, start, start, whole.view(np.int64)), strict=True)
                first = np.searchsorted(b.doc, np.arange(b.n))
                rows = []
                for i, ((p, x), (q, w)) in enumerate(parts):
                    hit = p[np.isin(x, prints.iloc[a + i])]
                    ok = np.isin(q, (hit[:, None] - np.arange(WINDOW_HASHES)).ravel())
                    rows.append([(w[ok], q[ok] - first[i], q[ok] - first[i] + SPAN)])
                for k in lengths:
                    start, whole = windows(b, k)
                    for i, (q, w) in enumerate(_by_text(b, start, start, whole.view(np.int64))):
                        ok = np.isin(w, prints.iloc[a + i])
                        rows[i].append((w[ok], q[ok] - first[i], q[ok] - first[i] + k))
                out += [[{"w": int(w), "first": int(p), "until": int(e)} for part in r for w, p, e in zip(*part, strict=True)] for r in rows]
            yield pd.Series(out)

    return found


def hits(documents: DataFrame, tests: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, x, y, n_words) of every row, (id, x, y, w, first, until) of the windows of rows that are windows of an item)."""
    sc = documents.sparkSession.sparkContext
    lengths = sorted(r[0] for r in tests.where(F.col("length") < SPAN).select("length").distinct().collect())
    listed = tests.select(F.explode("prints").alias("h")).distinct()
    known = None
    if listed.count() <= MOST_KNOWN:
        known = sc.broadcast(np.sort(np.array([r[0] for r in listed.collect()], dtype=np.int64)))
    f = documents.select(*row_key(id_col, text_col), _prints(lengths, known)(utf8(text_col)).alias("f"))
    rows = save(f.select(*KEY, "f.n_words", "f.prints"), "scanned")
    looked = rows.select(*KEY, F.explode("prints").alias("h")).distinct().join(listed, "h")
    near = save(looked.groupBy(*KEY).agg(F.collect_set("h").alias("prints")), "candidates")
    size = near.agg(F.sum(F.size("prints") + 4)).first()[0] or 0
    named = near.toDF(*[f"near_{c}" for c in near.columns])
    texts = documents.select(*row_key(id_col, text_col), utf8(text_col).alias("text")).join(F.broadcast(named) if few(size) else named, same_key("near_"))
    found = texts.select(*KEY, F.explode(_near(lengths)(F.col("text"), F.col("near_prints"))).alias("v")).select(*KEY, "v.*").distinct()
    known_windows = tests.select(F.explode("windows").alias("w")).distinct()
    return rows.select(*KEY, "n_words"), save(found.join(known_windows, "w", "left_semi").select(*KEY, "w", "first", "until"), "hits")


def stretches(hit: DataFrame) -> DataFrame:
    """(id, x, y, n_hit, spans): the words inside hits, and the stretches (first, until) that they form."""
    order = Window.partitionBy(*KEY).orderBy("first", "until")
    placed = hit.select(*KEY, "first", "until").distinct().withColumn("before", F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.withColumn("run", F.sum(F.when(F.col("first") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = placed.groupBy(*KEY, "run").agg(F.min("first").alias("first"), F.max("until").alias("until"))
    return runs.groupBy(*KEY).agg(F.sum(F.col("until") - F.col("first")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "until"))).alias("spans"))


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of documents: words, words inside shared windows, items, their digest, stretches of hit words.

    Null and empty texts have no words; items without words hit nothing. Repeated rows get the same result each, rows without
    an id theirs. Other columns of documents are not looked at. Texts are not shuffled unless very many rows are hit.
    """
    tests = items(benchmark, item_col, item_text_col)
    rows, hit = hits(documents, tests, id_col, text_col)
    owners = hit.select(*KEY, "w").distinct().join(tests.select("item", F.explode("windows").alias("w")).distinct(), "w").select(*KEY, "item").distinct()
    named = owners.groupBy(*KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    spans = stretches(hit)
    found = spans.join(named.toDF(*[f"own_{c}" for c in named.columns]), same_key("own_"))
    found = save(found.select(*[F.col(k).alias(f"hit_{k}") for k in KEY], "n_hit", "spans", F.col("own_items").alias("items")), "found")
    out = rows.join(found, same_key("hit_"), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("spans", F.array().cast("array<struct<first:bigint,until:bigint>>")).alias("spans"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents whose text shares no window with the benchmark; columns stay as they are.

    Null and empty texts stay, repeated rows stay or go together, rows without an id are judged like any other.
    """
    _, hit = hits(documents, items(benchmark), id_col, text_col)
    gone = save(hit.select(*KEY).distinct(), "gone")
    return documents if gone.isEmpty() else among(documents, gone, id_col, text_col, "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items in every document; see contamination for nulls, empty texts and repeated rows."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


#: The same rows in SQL: every window of ten words, compared as text.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
