"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its text features. The weights minimise the logistic
loss on feature differences of (better, worse) pairs of labelled documents; two more numbers map the
strength to a probability. Documents are then kept above a quantile of all scores: the one that cuts off as many
documents as the calibrated scores expect to be bad.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .base import KEY, among, read, row_key, save, utf8

#: Bounds of the fit: labelled documents of each label, and partners that each of them is paired with.
SAMPLE_PER_LABEL, PARTNERS = 10_000, 8
#: Scores from this on are predicted to be good.
CUT = 0.3
#: Scores are counted in so many equal bins to find an exact quantile of the bins.
BINS = 10_000


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "upper": _class(bytes(range(65, 91))), "lower": _class(bytes(range(97, 123))), "digit": _class(b"0123456789"), "mark": _class(b"#*$%&<>@^~_=+\\/{}[]"),
    "bar": _class(b"|"), "bang": _class(b"!?"), "stop": _class(b"."), "comma": _class(b",;:"), "line": _class(b"\n"), "quote": _class(b"\"'`()-"), "wide": ~W.FIRST,
}
FEATURES = (*_CLASSES, "marks_a_word", "words", "variety", "growth", "word_length", "long_words", "stutter", "pairs_again", "lines_again")


def features(texts: list[bytes]) -> np.ndarray:
    """Matrix of one row a text; every value is finite, also for empty texts."""
    b = W.pack(texts, W.SPACED)
    size = np.maximum(np.diff(b.doc_at) - 1, 1)
    n = b.words_in()
    words = np.maximum(n, 1)
    count = {k: b.per_doc(m[b.buf]) - (k == "line") for k, m in _CLASSES.items()}
    _, before = W.repeated(b.doc, b.hashes)
    distinct = n - np.bincount(b.doc[before], minlength=b.n)
    length = b.ends - b.starts
    again = (b.hashes[1:] == b.hashes[:-1]) & (b.doc[1:] == b.doc[:-1])
    at, h = W.grams(b, 2)
    _, pair_before = W.repeated(b.doc[at], h)
    _, _, line_doc, line_hash = W.lines(b)
    _, line_before = W.repeated(line_doc, line_hash)
    per = lambda d, **k: np.bincount(d, minlength=b.n, **k)
    cols = [np.sqrt(count[k] / size) for k in _CLASSES]
    cols += [
        np.log1p((count["mark"] + count["bar"] + count["bang"]) / words), np.log1p(n), distinct / words, np.log1p(distinct) / np.log1p(words),
        np.log1p(per(b.doc, weights=length) / words), per(b.doc[length > 14]) / words, np.sqrt(per(b.doc[:-1][again]) / words),
        np.sqrt(per(b.doc[at[pair_before]]) / words), per(line_doc[line_before]) / np.maximum(per(line_doc), 1),
    ]
    return np.stack(cols, axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method with halved steps."""
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ w**2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w, last, now = w - size * step, now, loss(w - size * step)
        if last - now < 1e-9 * max(1.0, abs(last)):
            break
    return w


def fit_pairs(good: np.ndarray, bad: np.ndarray, share_good: float) -> Model:
    """Bradley-Terry weights from pairs of a good and a bad row, then a calibration at the labels' own shares.

    Without rows of both labels there are no pairs: the score is then the same for all.
    """
    k = good.shape[1]
    if not len(good) or not len(bad):
        n = len(good) + len(bad)
        p = (len(good) + 1) / (n + 2)
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 1.0, float(np.log(p / (1 - p))))
    both = np.concatenate([good, bad])
    weight = np.concatenate([np.full(len(good), share_good / len(good)), np.full(len(bad), (1 - share_good) / len(bad))])
    mean = weight @ both
    scale = np.sqrt(weight @ (both - mean) ** 2) + 1e-3
    a, b = (np.clip((x - mean) / scale, -8, 8) for x in (good, bad))
    n = max(len(a), len(b))
    i = np.arange(n)
    diff = np.concatenate([a[i % len(a)] - b[(i * 7 + 13 * j + i // len(b)) % len(b)] for j in range(PARTNERS)])
    half = np.arange(len(diff)) % 2  # every other pair the other way round, so no intercept is learnt
    signed = np.where(half[:, None] == 1, diff, -diff)
    w = _logistic(signed, half.astype(float), np.full(len(diff), 1.0 / PARTNERS), np.full(k, 1.0))
    z = np.concatenate([a @ w, b @ w])
    n_good, n_bad = len(good), len(bad)
    y = np.concatenate([np.full(n_good, (n_good + 1) / (n_good + 2)), np.full(n_bad, 1 / (n_bad + 2))])
    slope, offset = _logistic(np.stack([z, np.ones(len(z))], axis=1), y, weight * len(z), np.array([1e-3, 1e-3]))
    return Model(mean, scale, w, max(float(slope), 1e-6), float(offset))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is a multiple of 5. Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(i, y): the labels that may be learnt from, one for each id."""
    return (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out("i"))
        .groupBy("i").agg(F.min("y").alias("y"))
    )


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most SAMPLE_PER_LABEL labelled documents of each label, those of the smallest id hashes.

    A document with several labels counts as its lowest; null ids and labels are left out. The chosen
    ids are at most 2 * SAMPLE_PER_LABEL and so may be broadcast; only their features reach the driver.
    """
    given = learnable(labels, id_col, label_col)
    counts = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    order = [F.xxhash64("i", F.lit(3)), F.col("i")]
    chosen = given.where("y = 1").orderBy(*order).limit(SAMPLE_PER_LABEL).unionByName(given.where("y = 0").orderBy(*order).limit(SAMPLE_PER_LABEL))
    texts = documents.select(F.col(id_col).alias("i"), utf8(text_col).alias("text")).join(F.broadcast(chosen), "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(pdf["text"])
            for a, z in W.slices(rows):
                yield pd.DataFrame({"i": pdf["i"].iloc[a:z].to_numpy(), "y": pdf["y"].iloc[a:z].to_numpy(), "x": list(features(rows[a:z]))})

    kind = texts.schema["i"].dataType.simpleString()
    # repeated documents: the first by value, so at most one row for each chosen id reaches the driver
    got = texts.mapInPandas(run, f"i {kind}, y int, x array<double>").groupBy("i").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas()
    got = got.sort_values("i")  # a fixed order makes the fit the same on every run
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    y = got["y"].to_numpy()
    return fit_pairs(x[y == 1], x[y == 0], share)


def score(model: Model, text_col: str = "text") -> Column:
    """The probability (0 to 1) that a text is good, as a column; null texts score as empty ones."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = list(s)
            yield pd.Series(np.concatenate([model.score(features(texts[a:z])) for a, z in W.slices(texts)] or [np.zeros(0)]))

    return scored(utf8(text_col))


def _cut(counts: list, level: float) -> float:
    """Lower edge of the bin that holds the quantile: at most `level` of the scores are below it, ties in a bin stay together."""
    total, below = sum(r["count"] for r in counts), 0
    for r in sorted(counts):
        below += r["count"]
        if below > level * total:
            return r["bin"] / BINS
    return 1.0


def _bins(scores: DataFrame, column: str) -> DataFrame:
    return scores.groupBy(F.floor(F.col(column) * BINS).alias("bin")).agg(F.count("*").alias("count"), F.sum(1 - F.col(column)).alias("bad")).where("bin is not null")


def quantile(scores: DataFrame, column: str, level: float) -> float:
    """Lower edge of the bin below which at most `level` of the scores are; counts go to BINS + 1 bins at most."""
    return _cut(_bins(scores, column).select("bin", "count").collect(), level)


def threshold(scores: DataFrame, column: str, level: float | None = None) -> float:
    """The quantile of the scores from which on documents are kept.

    level: the largest share of documents to cut off. Without one it is the share that the scores, which are calibrated
    probabilities, expect to be bad; it is taken over all documents. So at least 1 - level of them are kept, and all of scores that are alike. No
    scores: 0.
    """
    counts = _bins(scores, column).collect()
    total = sum(r["count"] for r in counts)
    if not total:
        return 0.0
    expected = round(sum(r["bad"] for r in sorted(counts)) / total, 9)
    return _cut(counts, expected if level is None else level)


def keep_by_quantile(documents: DataFrame, model: Model, level: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that score at or above threshold(), columns as they are.

    Null and empty texts score like any other text without words; equal texts stay or go together; all rows that share the quantile's bin
    go together too. Texts are scored once; rows that go are named by id and hash, rows without an id by the hash.
    """
    scored = save(documents.select(*row_key(id_col, text_col), score(model, text_col).alias("score")), "scored")
    gone = save(scored.where(F.col("score") < threshold(scored, "score", level)).select(*KEY).distinct(), "gone")
    return documents if gone.isEmpty() else among(documents, gone, id_col, text_col, "left_anti")


def keep_predicted(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of documents that are predicted to be good: those that score CUT or more, whatever their share. Null and
    empty texts score like any text without words; repeated rows stay or go together; columns stay as they are."""
    return documents.where(score(model, text_col) >= F.lit(CUT))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, whether each is predicted to be good, and whether it is above the quantile (kept).

    Null and empty texts have a score like any other, rows without an id are never held out, repeated rows score alike.
    No shuffle of texts.
    """
    documents = read(spark, sf_dir, "documents")
    model = train(documents, read(spark, sf_dir, "labels"))
    scored = save(documents.select("doc_id", held_out().alias("held_out"), score(model).alias("score")), "scored")
    return scored.withColumns({"predicted": (F.col("score") >= CUT).cast("int"), "kept": F.col("score") >= threshold(scored, "score")})
