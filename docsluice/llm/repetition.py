"""Quality rules by repetition coverage.

For several window lengths, the share of a text's word characters that lie inside windows of words
found twice or more in the same text, and the share in repeated lines, each against its own limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .base import carried, read, utf8

#: Window length -> largest share of word characters inside repeated windows. Long windows repeat less by
#: chance, so their limits are lower; a short text in which one line stands twice stays below all of them.
COVERAGE = {3: 0.5, 5: 0.25, 8: 0.22, 10: 0.2}
#: Largest share of word characters in lines that repeat an earlier line.
LINE_COVERAGE = 0.3
#: The fixed base rules.
LEAST_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + ", ".join(f"cover_{n} double" for n in COVERAGE)
    + ", cover_lines double, base_failed boolean, kept boolean"
)


def _measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    b = W.pack(texts, W.SPACED)
    chars_before = np.concatenate([[0], np.cumsum(W.FIRST[b.buf])])
    chars = chars_before[b.ends] - chars_before[b.starts]
    n_words = b.words_in()
    word_chars = np.bincount(b.doc, weights=chars, minlength=b.n).astype(np.int64)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": b.per_doc(_SYMBOL[b.buf])}

    start, end, line_doc, line_hash = W.lines(b)
    _, before = W.repeated(line_doc, line_hash)
    out["n_dup_lines"] = np.bincount(line_doc[before], minlength=b.n).astype(np.int64)
    word_chars_before = np.concatenate([[0], np.cumsum(chars)])
    in_line = word_chars_before[np.searchsorted(b.starts, end)] - word_chars_before[np.searchsorted(b.starts, start)]
    in_dup_lines = np.bincount(line_doc[before], weights=in_line[before], minlength=b.n)

    whole = np.maximum(word_chars, 1)
    for n in COVERAGE:
        at, h = W.grams(b, n)
        twice, _ = W.repeated(b.doc[at], h)
        edge = np.zeros(len(b.starts) + 1, dtype=np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + n, -1)
        inside = np.cumsum(edge[:-1]) > 0
        out[f"cover_{n}"] = np.bincount(b.doc[inside], weights=chars[inside], minlength=b.n) / whole
        if n == BASE_WINDOW:
            out["n_repeat_words"] = np.bincount(b.doc[inside], minlength=b.n).astype(np.int64)
    out["cover_lines"] = in_dup_lines / whole
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * n_words)
    fine = out["cover_lines"] <= LINE_COVERAGE
    for n, limit in COVERAGE.items():
        fine &= out[f"cover_{n}"] <= limit
    out["kept"] = fine & ~out["base_failed"]
    return out


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id and the measures, no shuffle.

    Null and empty texts have no words: zero everywhere, base_failed. Null ids stay null, repeated
    rows give repeated results; texts of any length are measured whole.
    """
    key, way, kind = carried(df, id_col)
    columns = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["text"])
            for a, z in W.slices(texts):
                found = _measure(texts[a:z])
                yield pd.DataFrame({"id": pdf["id"].iloc[a:z].reset_index(drop=True)} | {c: found[c] for c in columns})

    part = df.select(key.alias("id"), utf8(text_col).alias("text"))
    return part.mapInPandas(run, f"id {way}, {SCHEMA}").select(F.col("id").cast(kind).alias(id_col), *columns)


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; null and empty texts have no words and fail the base rule."""
    return repetition(read(spark, sf_dir, "documents"))
