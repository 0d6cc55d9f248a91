"""Lexical search over a stored inverted index.

A posting is (term, document, how often, length of the document, tenant). Documents are dealt to ranges by the hash of their id, and the postings of
a term in a range are one block with its maxima. Blocks lie in folders by the hash of the term, sorted by term, so
that a query reads the folders of its own terms only, and in them, by the statistics of the files, little more than its terms' blocks.

A query first reads its terms' maxima. Summed over its terms they bound what a document of a range can score. A few ranges of the highest bounds are
scored whole; their k-th score is what others must reach, so the blocks of ranges bounded below it are not read. The result is that of a
scan: no document is lost, and ties go by id.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import query_terms

#: Documents of a range on average, and folders of terms.
RANGE_DOCS, BUCKETS = 2048, 32
#: Bytes of the texts of a range on average: a task holds one range.
RANGE_BYTES = 1 << 23
#: Ranges whose blocks of a folder are sorted and written by one task.
FILE_RANGES = 32


@dataclass(frozen=True)
class Postings:
    """An opened index: its blocks, and the number and mean length of all documents."""

    blocks: DataFrame
    docs: int
    mean: float
    ranges: int
    buckets: int


def bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


#: What a range gives to a folder: its terms, set apart by spaces, the postings of each (how many, which of the row's documents, how often), and those documents.
PACKED = "bucket int, part long, range int, terms string, size array<int>, doc array<int>, n array<int>, id array<long>, len array<int>, tenant array<string>"
POSTINGS = "array<struct<id:long,n:int,len:int,tenant:string>>"


def _packed(buckets: int):
    """The postings of one range, a row for each folder, from its documents (range, id, tenant, words; words: set apart by single spaces)."""

    def run(table: pa.Table) -> pa.Table:
        own, out = table["range"][0].as_py(), []
        table = table.filter(pc.not_equal(table["words"], "")).combine_chunks().sort_by("id")
        words = pc.split_pattern(table["words"].combine_chunks(), " ")
        length = pc.list_value_length(words).to_numpy()
        terms, docs = pc.dictionary_encode(words.flatten()), len(table)
        names = np.array(terms.dictionary.to_pylist(), object)
        folder = np.array([zlib.crc32(t.encode()) % buckets for t in names], np.int64)
        # terms are numbered by folder and then as they sort
        order = np.lexsort((np.argsort(pc.sort_indices(terms.dictionary).to_numpy()), folder))
        names, folder, place = names[order], folder[order], np.argsort(order)
        # a word of a document is one number, term before document: equal ones are counted, those of a term lie together
        key, n = np.unique(place[terms.indices.to_numpy()] * docs + np.repeat(np.arange(docs), length), return_counts=True)
        term, doc = np.divmod(key, docs)
        size = np.bincount(term, minlength=len(names))
        ends, columns = np.append(0, np.cumsum(size)), {c: table[c].combine_chunks() for c in ("id", "tenant")}
        for k in np.unique(folder):
            i, j = np.searchsorted(folder, [k, k + 1])
            some, mine = np.unique(doc[ends[i] : ends[j]], return_inverse=True)
            values = {"size": size[i:j], "doc": mine, "n": n[ends[i] : ends[j]], "len": length[some]}
            out.append({"bucket": k, "part": own // FILE_RANGES, "range": own, "terms": " ".join(names[i:j])} | {c: v.astype(np.int32) for c, v in values.items()} | {c: v.take(pa.array(some)).to_pylist() for c, v in columns.items()})
        i32, kinds = pa.list_(pa.int32()), {"bucket": pa.int32(), "part": pa.int64(), "range": pa.int32(), "terms": pa.string()}
        kinds |= {"size": i32, "doc": i32, "n": i32, "id": pa.list_(pa.int64()), "len": i32, "tenant": pa.list_(pa.string())}
        return pa.table({c: pa.array([r[c] for r in out], t) for c, t in kinds.items()})

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """The blocks of one folder and some ranges, by term and range, from their packed rows."""
    table = table.combine_chunks()
    flat = {c: table[c].combine_chunks().flatten() for c in ("size", "doc", "n", "id", "len", "tenant")}
    each = [t.split(" ") for t in table["terms"].to_pylist()]
    of_row = [pc.list_value_length(table[c]).to_numpy() for c in ("doc", "id")]
    found = pa.table({"term": pa.array([t for x in each for t in x], pa.string()), "range": pa.array(np.repeat(table["range"].to_numpy(), [len(x) for x in each]).astype(np.int32))})
    order = pc.sort_indices(found, sort_keys=[("term", "ascending"), ("range", "ascending")]).to_numpy()
    size = flat["size"].to_numpy().astype(np.int64)
    first = (np.cumsum(size) - size)[order]
    size = size[order]
    start = np.cumsum(size) - size
    at = np.repeat(first - start, size) + np.arange(size.sum())
    doc = pa.array((flat["doc"].to_numpy() + np.repeat(np.cumsum(of_row[1]) - of_row[1], of_row[0]))[at])
    n, length = flat["n"].to_numpy()[at], flat["len"].take(doc).to_numpy()
    p = pa.StructArray.from_arrays([flat["id"].take(doc), pa.array(n), pa.array(length), flat["tenant"].take(doc)], names=["id", "n", "len", "tenant"])
    return pa.table({
        "bucket": pa.array(np.full(len(size), table["bucket"][0].as_py(), np.int32)), "term": found["term"].take(pa.array(order)), "range": found["range"].take(pa.array(order)), "size": pa.array(size.astype(np.int32)),
        "most": pa.array(np.maximum.reduceat(n, start)), "shortest": pa.array(np.minimum.reduceat(length, start)), "densest": pa.array(np.maximum.reduceat(n / length, start)), "words": pa.array(np.add.reduceat(n, start, dtype=np.int64)),
        "postings": pa.ListArray.from_arrays(pa.array(np.append(start, len(at)), pa.int32()), p),
    })


def build(docs: DataFrame, id_col: str, text_col: str, path: str, tenant_col: str | None = None, range_docs: int = RANGE_DOCS, buckets: int = BUCKETS, range_bytes: int = RANGE_BYTES) -> Postings:
    """Write the index of a table under `path` and open it. Ids are keys; null and empty texts are documents without terms, of which only the empty ones have a length.

    Texts move once, as words, to their range, whose words are counted in arrays; the postings of a range move once more, a row for each folder, where blocks are made. What moves is
    so a small multiple of the texts, however large they are, and a task holds a range, which has neither many documents nor long texts.
    """
    spark = docs.sparkSession
    tenant = F.col(tenant_col).cast("string") if tenant_col else F.lit(None).cast("string")
    text = F.col(text_col)
    stats = docs.agg(F.count("*").alias("docs"), F.count(text).alias("texts"), F.sum(F.octet_length(text)).alias("bytes")).first()
    ranges = max(1, math.ceil(stats["docs"] / range_docs), math.ceil((stats["bytes"] or 0) / range_bytes))
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    rows = docs.select(F.pmod(F.xxhash64(id_col), F.lit(ranges)).cast("int").alias("range"), F.col(id_col).cast("long").alias("id"), tenant.alias("tenant"), words.alias("words"))
    # documents without words are left out by the function: a filter would be pushed below the exchange and clean every text twice
    packed = rows.repartition(min(ranges, 1 << 14), "range").groupBy("range").applyInArrow(_packed(buckets), PACKED)
    moved = packed.repartition(min(buckets * math.ceil(ranges / FILE_RANGES), 1 << 14), "bucket", "part").groupBy("bucket", "part")
    out = moved.applyInArrow(_blocks, f"bucket int, term string, range int, size int, most int, shortest int, densest double, words long, postings {POSTINGS}").sortWithinPartitions("bucket", "term", "range")
    out.write.partitionBy("bucket").option("parquet.block.size", 1 << 22).parquet(f"{path}/blocks")
    # words are counted in the blocks, so texts are split once
    total = spark.read.schema("words long").parquet(f"{path}/blocks").agg(F.sum("words").alias("words")).first()["words"] if stats["bytes"] else None
    mean = (total or 0) / (stats["texts"] or 1)
    spark.createDataFrame([(stats["docs"], mean, ranges, buckets)], "docs long, mean double, ranges int, buckets int").coalesce(1).write.parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Postings:
    s = spark.read.parquet(f"{path}/stats").first()
    kind = f"term string, range int, size int, most int, shortest int, densest double, postings {POSTINGS}, bucket int"
    return Postings(spark.read.schema(kind).parquet(f"{path}/blocks") if s["docs"] and s["mean"] else spark.createDataFrame([], kind), s["docs"], s["mean"], s["ranges"], s["buckets"])


def _weight(mode: str, n: Column, length: Column, idf: Column, mean: float, k1: float, b: float) -> Column:
    """What a term adds to a document's score."""
    if mode == "tf":
        return n.cast("double")
    n = n.cast("double")
    return idf * n * (k1 + 1) / (n + k1 * (1 - b + b * length / F.lit(mean or 1.0)))


def _of_terms(ix: Postings, terms: list[str], columns: list[str]) -> DataFrame:
    """Blocks of the terms: folders and row groups of other terms are not read."""
    return ix.blocks.where(F.col("bucket").isin(*[bucket(F.lit(t), ix.buckets) for t in terms])).where(F.col("term").isin(*terms)).select(*columns)


def bounds(ix: Postings, terms: list[str], mode: str = "tf", every: bool = False, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, dict[str, float]]:
    """(range, bound) of the ranges that hold a term (every: all terms), and the idf of each term. Reads maxima, no postings.

    A weight grows with n and falls with the length. No posting has more than `most`, a shorter document than `shortest` or a
    larger share than `densest`, so none weighs more than `most` in a document of the length that these two allow.
    """
    top = _of_terms(ix, terms, ["term", "range", "size", "most", "shortest", "densest"])
    found = {r["term"]: r["df"] for r in top.groupBy("term").agg(F.sum("size").alias("df")).collect()} if mode != "tf" else {}
    idf = {t: math.log(1 + (ix.docs - found.get(t, 0) + 0.5) / (found.get(t, 0) + 0.5)) for t in terms}
    length = F.greatest(F.col("shortest").cast("double"), F.col("most") / F.col("densest"))
    mine = F.create_map(*[F.lit(x) for t, w in idf.items() for x in (t, w)])[F.col("term")]
    out = top.groupBy("range").agg(F.sum(_weight(mode, F.col("most"), length, mine, ix.mean, k1, b)).alias("bound"), F.count("*").alias("terms"))
    return (out.where(F.col("terms") == len(terms)) if every else out), idf


def lexical(ix: Postings, q: str, limit: int, mode: str = "tf", every: bool = False, k1: float = 1.2, b: float = 0.75, tenant: str | None = None, first: int = 4) -> DataFrame:
    """(id, score, lexical_rank) of the best `limit` documents, of one tenant if given: retrieval.lexical over the index.

    first: ranges that are scored whole before others are left out. BM25's statistics are those of all documents.
    """
    spark, terms = ix.blocks.sparkSession, query_terms(q)
    empty = spark.createDataFrame([], "id long, score double, lexical_rank int")
    if not terms:
        return empty
    by_range, idf = bounds(ix, terms, mode, every, k1, b)
    ranked = by_range.orderBy(F.desc("bound"), "range").limit(first).collect()
    if not ranked:
        return empty

    def scored(ranges: DataFrame | list[int]) -> DataFrame:
        some = _of_terms(ix, terms, ["term", "range", "postings"])
        some = some.where(F.col("range").isin(*ranges)) if isinstance(ranges, list) else some.join(ranges, "range", "left_semi")
        p = some.select("term", F.explode("postings").alias("p"))
        p = p.where(F.col("p.tenant") == tenant) if tenant is not None else p
        # the terms of a document are added in the order of the query, so equal documents have equal sums
        each = p.groupBy(F.col("p.id").alias("id")).agg(*[F.sum(F.when(F.col("term") == t, _weight(mode, F.col("p.n"), F.col("p.len"), F.lit(idf[t]), ix.mean, k1, b))).alias(f"w{i}") for i, t in enumerate(terms)])
        s = sum((F.coalesce(F.col(f"w{i}"), F.lit(0.0)) for i in range(len(terms))), F.lit(0.0))
        for i in range(len(terms) if every else 0):
            each = each.where(F.col(f"w{i}").isNotNull())
        return each.select("id", s.alias("score")).orderBy(F.desc("score"), "id").limit(limit)

    best = scored([r["range"] for r in ranked]).collect()
    least = best[-1]["score"] if len(best) == limit else 0.0
    rest = by_range.where(F.col("bound") >= least - 1e-9).select("range")
    few = ranked[-1]["bound"] < least - 1e-9 or len(ranked) < first  # no other range can reach it
    top = spark.createDataFrame(best, "id long, score double") if few else scored(rest)
    return top.withColumn("lexical_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # at most `limit` rows


def term_counts(ix: Postings, q: str) -> DataFrame:
    """(tenant, id, score) of every document that has a term of the query; score: how often the terms occur."""
    terms = query_terms(q)
    p = _of_terms(ix, terms, ["postings"]).select(F.explode("postings").alias("p")) if terms else ix.blocks.select(F.explode("postings").alias("p")).limit(0)
    return p.groupBy("p.tenant", "p.id").agg(F.sum("p.n").cast("long").alias("score")).select("tenant", "id", "score")
