"""Splitting texts into chunks. The recursive splitter is stateful, so texts go through Arrow batches; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.functions.fixed import CITATION_BACK, CITATION_OVERLAP, CITATION_WINDOW, SENTENCE_ENDS

#: Where to split, the coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")

#: Characters of windows that a task holds before it hands them on.
HELD = 1 << 20


def words(text: str) -> int:
    """The default measure of a chunk; a tokenizer's count may be passed instead."""
    return len(text.split())


def pieces(text: str, most: int, size: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most `most`, cut at the coarsest separator that does; the parts together are the text."""
    if size(text) <= most:
        return [text] if text else []
    sep, rest = separators[0], separators[1:]
    if not sep:
        step = max(1, len(text) // (size(text) // most + 1))
        return [text[i : i + step] for i in range(0, len(text), step)]
    parts = text.split(sep)
    parts = [p + sep for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    return [x for p in parts for x in pieces(p, most, size, rest)]


def split(text: str, most: int, overlap: int, size: Callable[[str], int] = words) -> list[str]:
    """Pieces joined again up to `most`; a chunk begins with the last pieces of the one before, up to `overlap`."""
    out, held, total, fresh = [], [], 0, False
    for p in pieces(text, most, size):
        n = size(p)
        if held and total + n > most:
            out.append("".join(x for x, _ in held).strip())
            while held and (total > overlap or total + n > most):
                total -= held.pop(0)[1]
            fresh = False
        held.append((p, n))
        total, fresh = total + n, True
    if fresh:
        out.append("".join(x for x, _ in held).strip())
    return [x for x in out if x]


def chunks(df: DataFrame, id_col: str, text_col: str, most: int, overlap: int) -> DataFrame:
    """(id, chunk_index, chunk); null and blank texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, c in enumerate(split(t or "", most, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "chunk"])

    part = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return part.mapInPandas(run, "id long, chunk_index int, chunk string").withColumnRenamed("id", id_col)


def parent_child(df: DataFrame, id_col: str, text_col: str, parent: tuple[int, int] = (1750, 100), child: tuple[int, int] = (550, 75), least: int = 100) -> DataFrame:
    """(id, chunk_type, parent_index, child_index, chunk): parents, and children cut from each parent.

    Chunks below `least` are dropped, unless they are all of the text; child_index counts over the whole text,
    parent_index keeps the gaps of dropped parents.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                big, n = split(t or "", *parent), 0
                for k, p in enumerate(big):
                    if words(p) < least and len(big) > 1:
                        continue
                    rows.append((i, "parent", k, -1, p))
                    small = split(p, *child)
                    for c in small:
                        if words(c) >= least or len(small) == 1:
                            rows.append((i, "child", k, n, c))
                            n += 1
            yield pd.DataFrame(rows, columns=["id", "chunk_type", "parent_index", "child_index", "chunk"])

    part = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return part.mapInPandas(run, "id long, chunk_type string, parent_index int, child_index int, chunk string").withColumnRenamed("id", id_col)


def windows(text: str, size: int = 5000, overlap: int = 500, back: int = 1000) -> list[str]:
    """Windows that end at a paragraph or sentence within their last `back` characters if there is one."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = max(text.rfind(s, end - back, end) + len(s) if text.rfind(s, end - back, end) >= 0 else -1 for s in ("\n\n", ". ", "\n"))
            end = cut if cut > at else end
        out.append(text[at:end])
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def citation_windows(text: str, size: int = CITATION_WINDOW, overlap: int = CITATION_OVERLAP, back: int = CITATION_BACK) -> list[str]:
    """Windows of `size` characters that overlap by `overlap`. One ends at the last of the first kind of SENTENCE_ENDS that its last `back` characters have, if
    that is behind its middle."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at + size < len(text):
        end, low = at + size, max(at, at + size - back)
        cut = next((k + len(s) for s in SENTENCE_ENDS if (k := text.rfind(s, low, end)) >= 0), 0)
        end = cut if cut > at + size // 2 else end
        out.append(text[at:end])
        at = end - overlap
    return [*out, text[at:]]


def cut_batches(cut: Callable[[str], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) batches to (id, place, piece) batches of about HELD characters."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        i, k, w = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int32()), pa.array(w, pa.string())], ["id", "place", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for i, t in zip(b.column(0), b.column(1), strict=True):  # one text at a time is a Python object
                for k, w in enumerate(cut(t.as_py() or "")):
                    rows.append((i.as_py(), k, w))
                    held += len(w)
                    if held >= HELD:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    return run


def sentence_windows(df: DataFrame, id_col: str, text_col: str, cut: Callable[[str], list[str]] = windows) -> DataFrame:
    """(id, place, piece) of the windows of each text; null texts are empty."""

    part = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return part.mapInArrow(cut_batches(cut), "id long, place int, piece string").withColumnRenamed("id", id_col)
