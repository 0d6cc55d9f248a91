"""Linking chunks of a document to the boxes (lines) that they came from."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docsluice.functions.alignment import Text, places
from docsluice.operators.pairs import spread

#: Lines of a page; the indel ratio from which a stretch is a chunk's; words that a box and a chunk must share.
PAGE_LINES, LEAST_RATIO, LEAST_WORDS = 5, 0.65, 3
#: Chunks, of several documents, that are looked for at once.
JOBS = 8192


def line_boxes(docs: DataFrame) -> DataFrame:
    """A box for each line: place in the document, page of PAGE_LINES lines, text."""
    b = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "box"))
    return b.select("doc_id", "place", F.floor(F.col("place") / PAGE_LINES).alias("page"), "box")


def line_chunks(docs: DataFrame, chars: int = 400) -> DataFrame:
    """Chunks of at most `chars` characters, in order; cut by one pattern, so in time linear in the text."""
    t = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    cut = F.when(t == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))
    return docs.select("doc_id", F.posexplode(cut).alias("chunk", "chunk_text"))


def normal(text: str | None) -> list[str]:
    """The words of a text, case aside."""
    return (text or "").lower().split()


def _linked(mine: set, at: tuple[int, int], starts: list[int], ends: list[int], words: list[set]) -> list[int]:
    """Boxes in the stretch that share LEAST_WORDS words with a chunk, or all their words."""
    some = range(bisect_right(ends, at[0]), bisect_left(starts, at[1]))
    return [i for i in some if words[i] and len(words[i] & mine) >= min(LEAST_WORDS, len(words[i]))]


def _candidates(mine: set, words: dict[int, set], most: int) -> list[int]:
    """The pages that share most words with a chunk, the lower of equals, in the order of pages; none that shares nothing."""
    if len(words) <= most:
        return sorted(p for p, w in words.items() if not mine.isdisjoint(w))
    shared = sorted([(-len(mine & w), p) for p, w in words.items()])
    return sorted(p for n, p in shared[:most] if n)


LINKS = "chunk int, ratio double, places array<int>, page long"


def link_boxes(chunks: DataFrame, boxes: DataFrame, least: float = LEAST_RATIO, pages: int | None = None) -> DataFrame:
    """(doc_id, chunk, ratio, places, page): the boxes of each chunk's text, and the page that most of them are on, the lower of equals.

    A chunk is looked for in the text of its document's boxes, case and white space aside: as it is, else by the stretch of its length that is most like it, from an
    indel ratio of `least` on. Of the boxes that this stretch touches, those that share LEAST_WORDS words with the chunk, or all their own, are its boxes. Stretch and
    chunk are compared whole, so a chunk over many short boxes has them all. Chunks without a place have none: no boxes, null ratio and page.

    pages: look in the boxes of that many pages only, those that share most words with the chunk. (doc_id, chunk) and
    (doc_id, place) are keys; a document's chunks and boxes are one task's work.
    """

    kinds = dict(chunks.dtypes) | dict(boxes.dtypes)
    c, b = [F.col(x).alias(x) for x in ("chunk", "chunk_text")], [F.col(x).alias(x) for x in ("place", "page", "box")]
    sides = [(chunks, F.struct(*c), F.lit(None)), (boxes, F.lit(None), F.struct(*b))]
    kind = f"struct<chunk:{kinds['chunk']},chunk_text:string>", f"struct<place:{kinds['place']},page:{kinds['page']},box:string>"
    rows = [df.select("doc_id", x.cast(kind[0]).alias("c"), y.cast(kind[1]).alias("b")) for df, x, y in sides]
    docs = spread(rows[0].unionByName(rows[1]), "doc_id").groupBy("doc_id").agg(F.collect_list("c").alias("c"), F.sort_array(F.collect_list("b")).alias("b")).where(F.size("c") > 0)

    def prepared(c: tuple[list, list], page: list, box: list) -> tuple[list, list]:
        """What the links need of a document, and its jobs (text, chunk); jobs of the same pages share a text."""
        split = [normal(x) for x in box]
        text, words = [" ".join(x) for x in split], [set(x) for x in split]
        by_page: dict[int, set] = {}
        on_page: dict[int, list[int]] = {}
        for i, (p, w) in enumerate(zip(page, words, strict=True)):
            by_page.setdefault(p, set()).update(w)
            on_page.setdefault(p, []).append(i)
        made: dict[tuple, tuple] = {}
        kept, jobs = [], []
        for number, chunk in zip(*c, strict=True):
            said = normal(chunk)
            own = set(said)
            some = tuple(_candidates(own, by_page, pages)) if pages else ()
            if some not in made:
                mine = sorted(i for p in some for i in on_page[p]) if pages else range(len(text))
                starts = [0, *accumulate(len(text[i]) + 1 for i in mine)]
                made[some] = mine, starts[:-1], [x - 1 for x in starts[1:]], [words[i] for i in mine], Text(" ".join([text[i] for i in mine]))
            kept.append((number, own, made[some]))
            jobs.append((made[some][4], " ".join(said)))
        return kept, jobs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, jobs = [], []
            for k in range(batch.num_rows):
                c, b = batch["c"][k].values, batch["b"][k].values
                page, place = b.field("page").to_pylist(), b.field("place").to_pylist()
                kept, mine = prepared((c.field("chunk").to_pylist(), c.field("chunk_text").to_pylist()), page, b.field("box").to_pylist())
                held += [(batch["doc_id"][k].as_py(), page, place, *x) for x in kept]
                jobs += mine
                if len(jobs) >= JOBS or k == batch.num_rows - 1:
                    yield linked(held, places(jobs, least))
                    held, jobs = [], []

    def linked(held: list, found: list) -> pa.RecordBatch:
        out = []
        for (doc, page, place, k, own, (rows, starts, ends, words, _)), at in zip(held, found, strict=True):
            mine = [rows[i] for i in _linked(own, at[:2], starts, ends, words)] if at else []
            on = Counter([page[i] for i in mine])
            out.append((doc, k, round(at[2], 6) if at else None, [place[i] for i in mine], min(on, key=lambda p: (-on[p], p)) if on else None))
        columns = zip(*out, strict=True) if out else ([],) * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    out = f"doc_id {kinds['doc_id']}, {LINKS}"
    schema = to_arrow_schema(StructType.fromDDL(out))
    return docs.mapInArrow(run, out)


def candidate_pages(chunks: DataFrame, boxes: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, chunk, page, shared): the pages of a document that share most words with a chunk, the lower of equals first.

    Chunks and boxes are moved as sets of words, not word by word; their words meet inside the task that has their document. Words that are the same on every page cost
    their pages and chunks. A document's chunks and boxes are one task's work.
    """

    def words(df: DataFrame, keys: list[str], text: str) -> DataFrame:
        low = F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")), " ")
        return df.where("doc_id IS NOT NULL").select(*keys, F.array_join(F.filter(F.array_distinct(low), lambda w: w != ""), " ").alias("w"))

    c, b = words(chunks, ["doc_id", "chunk"], "chunk_text"), words(boxes, ["doc_id", "page"], "box")

    def one(_key, c: pa.Table, b: pa.Table) -> pa.Table:
        pages: dict[str, set] = {}
        for p, w in zip(b["page"].to_pylist(), b["w"].to_pylist(), strict=True):
            for x in w.split(" ") if w else ():
                pages.setdefault(x, set()).add(p)
        mine: dict[object, set] = {}
        for k, w in zip(c["chunk"].to_pylist(), c["w"].to_pylist(), strict=True):
            mine.setdefault(k, set()).update(w.split(" ") if w else ())
        out = []
        for k, w in mine.items():
            shared = Counter(p for x in w for p in pages.get(x, ()))
            out += [(k, p, n) for p, n in sorted(shared.items(), key=lambda s: (-s[1], s[0]))[:most]]
        k, p, n = zip(*out, strict=True) if out else ((), (), ())
        doc = (c if len(c) else b)["doc_id"]
        return pa.table({"doc_id": pa.array([doc[0].as_py()] * len(out), doc.type), "chunk": pa.array(k, c["chunk"].type), "page": pa.array(p, b["page"].type), "shared": pa.array(n, pa.int64())})

    kinds = dict(c.dtypes) | dict(b.dtypes)
    return c.groupBy("doc_id").cogroup(b.groupBy("doc_id")).applyInArrow(one, f"doc_id {kinds['doc_id']}, chunk {kinds['chunk']}, page {kinds['page']}, shared long")


def _tiers(box: Column, phrase: str, patterns: list[str], least: int) -> tuple[Column, Column]:
    """(tier, words in common) of a box: 0 holds the whole phrase, 1 a part of it that a pattern picks out, 2 shares `least` words or
    more; else null. Case does not matter."""
    low, said = F.lower(F.coalesce(box, F.lit(""))), phrase.lower().strip()
    parts = [m[0] for p in patterns if (m := re.search(p, said))]
    words = list(dict.fromkeys(said.split()))
    common = F.size(F.array_intersect(F.array_distinct(F.split(low, r"\s+")), F.array(*map(F.lit, words))))
    part = F.lit(False)
    for p in parts:
        part = part | F.contains(low, F.lit(p))
    overlap = common >= least if len(words) >= least else F.lit(False)
    return F.when(F.contains(low, F.lit(said)), 0).when(part, 1).when(overlap, 2), common


def search_boxes(boxes: DataFrame, keys: list[str], text: str, order: list[str], phrase: str, patterns: list[str] | None = None, least: int = 3, most: int | None = None) -> DataFrame:
    """The boxes of each group `keys` that a phrase is found in, with tier and words in common: those of the first tier that
    finds any, whole and part in order, overlaps by words in common; the first `most` of them. An empty phrase finds none."""
    if not phrase.strip():
        return boxes.limit(0).withColumns({"tier": F.lit(None).cast("int"), "common": F.lit(None).cast("int")})
    tier, common = _tiers(F.col(text), phrase, patterns or [], least)
    hit = boxes.withColumns({"tier": tier, "common": common}).where("tier IS NOT NULL")
    best = hit.groupBy(*keys).agg(F.min("tier").alias("best"))
    hit = hit.join(best, keys).where("tier = best").drop("best")
    if most is None:
        return hit
    rank = Window.partitionBy(*keys).orderBy(F.when(F.col("tier") == 2, -F.col("common")).otherwise(0), *order)
    return hit.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= most).drop("place")


def phrase_page(boxes: DataFrame, keys: list[str], text: str, page: str, order: list[str], phrase: str, patterns: list[str] | None = None, least: int = 3) -> DataFrame:
    """(keys, page) of every group of boxes: the page of the first box of the best tier; null if none is found, or if the page
    is no positive number."""
    found = search_boxes(boxes, keys, text, order, phrase, patterns, least)
    rank = F.struct(F.when(F.col("tier") == 2, -F.col("common")).otherwise(0).alias("c"), *order)
    first = found.groupBy(*keys).agg(F.min_by(F.col(page), rank).alias("page"))
    every = boxes.select(*keys).distinct().join(first, keys, "left")
    return every.select(*keys, F.when(F.col("page") > 0, F.col("page")).alias("page"))
