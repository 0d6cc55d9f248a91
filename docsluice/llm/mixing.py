"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells of (source, language, topic); the sums are raked until their marginals meet the
targets; each document is then sampled with the fitted probability of its cell. The draw is a hash of the document's id, so it is the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import read, save

OTHER = "(other)"
AXES = ("source", "lang", "topic")
#: Production targets: shares of tokens. What an axis leaves unnamed goes to its other values together; if it leaves
#: nothing, they keep the share that they have (see shares).
TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13},
    "topic": {"legal": 0.04, "contact": 0.05, "data": 0.05, "general": 0.86},
}
#: Share of all tokens that a sample is expected to have.
SHARE = 0.5
SEED = "mix-1"


def topic_of(text: Column) -> Column:
    """Coarse topic by content, the first that fits: licence terms, addresses, symbols or tables, else general."""
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("licen")) | F.contains(low, F.lit("copyright")), "legal")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("+")), "contact")
        .when(text.rlike(r" \| |[#*$%&<>|]{3}"), "data")
        .otherwise("general")
    )


def token_count(text: Column) -> Column:
    """Words between white space."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return F.when(F.trim(text) == "", 0).otherwise(F.size(words)).cast("long")


def level(value: Column, named: dict[str, float]) -> Column:
    """The value if it has a target of its own, else OTHER; null too."""
    return F.when(value.isin(*named), value).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def axes(df: DataFrame, targets: dict[str, dict[str, float]], columns: dict[str, str], text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = {a: F.col(columns[a]).cast("string") if a in columns else topic_of(text) for a in AXES}
    return {a: level(raw[a], targets[a]) for a in AXES}


@dataclass
class Fit:
    cells: list[tuple]  #: source, lang, topic, probability
    rounds: int
    error: float  #: largest distance of an expected marginal share from its target


def shares(named: dict[str, float], levels: list[str], mass: np.ndarray) -> np.ndarray:
    """Target shares of the levels: what is left of one goes to OTHER, absent levels get nothing, the rest is scaled to one.

    Where the named values leave nothing, OTHER keeps the share of the tokens that it has, and the named ones share the rest.
    """
    left = max(0.0, 1.0 - sum(named.values()))
    t = np.array([named.get(x, left if x == OTHER else 0.0) for x in levels]) * (mass > 0)
    if OTHER not in named and left < 1e-9 and mass.sum():
        k = levels.index(OTHER)
        own = mass[k] / mass.sum()
        t[k] = 0.0
        t = t / t.sum() * (1 - own) if t.sum() else t
        t[k] = own
    return t / t.sum() if t.sum() else np.where(mass > 0, 1.0 / max(1, (mass > 0).sum()), 0.0)


def rake(tokens: dict[tuple, float], targets: dict[str, dict[str, float]], share: float, most_rounds: int = 3000, tolerance: float = 1e-9) -> Fit:
    """Keep-probabilities of the cells, whose expected tokens are `share` of all with marginals at the targets.

    A probability is the product of one factor of each axis, at most 1; each step scales the factors of one
    axis so that its expected sums meet the targets. Levels without tokens leave the targets, which are then
    scaled to one. Where some level has too few tokens for its target, all of them are kept, the others
    keep to their targets as well as they can, and the error says how far off the result is. A cell without
    tokens weighs on no target and gets `share`, unless a target of zero names one of its levels.
    """
    levels = [sorted({*targets[a], OTHER}) for a in AXES]
    at = [{x: i for i, x in enumerate(v)} for v in levels]
    place = {key: tuple(at[k][x] for k, x in enumerate(key)) for key in tokens}
    mass = np.zeros([len(v) for v in levels])
    for key, n in tokens.items():
        mass[place[key]] += n
    if not mass.sum():
        return Fit([(*key, 0.0) for key in sorted(tokens)], 0, 0.0)
    mass /= mass.sum()
    sums = [tuple(j for j in range(3) if j != k) for k in range(3)]
    want = [share * shares(targets[a], levels[k], mass.sum(axis=sums[k])) for k, a in enumerate(AXES)]
    factor = [np.where(w > 0, share ** (1 / 3), 0.0) for w in want]
    kept = lambda: np.minimum(1.0, factor[0][:, None, None] * factor[1][None, :, None] * factor[2][None, None, :])
    error, rounds = np.inf, 0
    while rounds < most_rounds and error > tolerance:
        for k in range(3):
            now = (kept() * mass).sum(axis=sums[k])
            ratio = np.divide(want[k], now, out=np.ones_like(now), where=now > 0)
            factor[k] = np.clip(factor[k] * ratio, 0, 1e9)
        p = kept()
        error = max(np.abs((p * mass).sum(axis=sums[k]) - want[k]).max() for k in range(3))
        rounds += 1
    unwanted = lambda key: any(targets[a].get(x) == 0 for a, x in zip(AXES, key, strict=True))
    return Fit([(*key, share if not mass[place[key]] and not unwanted(key) else float(p[place[key]])) for key in sorted(tokens)], rounds, float(error))


def draw(id_col: str, text_col: str = "text", seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone: 52 bits of a hash. Rows without an id draw by their text, so only equal texts draw alike."""
    own = F.col(id_col).cast("string")
    by_text = F.when(own.isNull(), F.md5(F.col(text_col).cast("string").cast("binary")))  # null of a null text, and then left out
    hexed = F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(own, F.lit("null")), by_text).cast("binary")), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 52))


def fit(measured: DataFrame, targets: dict[str, dict[str, float]], share: float) -> Fit:
    """The raked cells of a measured table. Cells reach the driver already summed; there are at most the product of
    the targets' named levels, each plus one, whatever the data."""
    rows = measured.groupBy(*AXES).agg(F.sum("n_tokens").alias("n")).collect()
    tokens = {tuple(r[a] for a in AXES): float(r["n"]) for r in rows}
    # a table without any token has nothing to rake: its rows are sampled at the base share
    return rake(tokens, targets, share) if any(tokens.values()) else Fit([(*key, share) for key in sorted(tokens)], 0, 0.0)


def probabilities(spark: SparkSession, fitted: Fit) -> DataFrame:
    """(source, lang, topic, probability) of each cell. From an Arrow table: a list of rows would go through Python workers of a kind of
    its own, which executors then keep beside those of the UDFs."""
    kinds = [*[(a, pa.string()) for a in AXES], ("probability", pa.float64())]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([c[k] for c in fitted.cells], kind) for k, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict[str, float]] = TARGETS, columns: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """One row per row of df: id, cell, tokens, weight (probability over share), probability, sampled or not, and error:
    how far the expected share of some level stays from its target, the same in every row; 0 if all targets are met.

    Null texts have no tokens; null and unnamed values of an axis are OTHER; a text without
    tokens is sampled like its cell. Repeated rows draw alike. columns: the columns of the axes; an axis without one is derived.
    """
    on = {"source": "source", "lang": "lang"} if columns is None else columns
    cell = axes(df, targets, on, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = save(df.select(F.col(id_col).alias("id"), *[cell[a].alias(a) for a in AXES], token_count(text).alias("n_tokens"), draw(id_col, text_col).alias("draw")), "measured")
    fitted = fit(measured, targets, share)
    p = probabilities(df.sparkSession, fitted)
    out = measured.join(F.broadcast(p), list(AXES)).select(F.col("id").alias(id_col), *AXES, "n_tokens", (F.col("probability") / share).alias("weight"), "probability", "draw")
    return out.select("*", (F.col("draw") < F.col("probability")).alias("sampled"), F.lit(round(fitted.error, 9)).alias("error")).drop("draw")


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict[str, float]] = TARGETS, columns: dict[str, str] | None = None, share: float = SHARE, most_error: float | None = None) -> DataFrame:
    """The sampled rows of df, columns as they are; nulls, empty texts and repeated rows as in mix. Texts are read twice and never shuffled.

    most_error: raise an error if some level's expected share stays further from its target than this, instead of
    sampling as well as can be.
    """
    on = {"source": "source", "lang": "lang"} if columns is None else columns
    cell = axes(df, targets, on, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = df.select(*[cell[a].alias(a) for a in AXES], token_count(text).alias("n_tokens"))
    fitted = fit(measured, targets, share)
    if most_error is not None and fitted.error > most_error:
        raise ValueError(f"a target is missed by {fitted.error:.4f} of all tokens, more than {most_error}")
    p = probabilities(df.sparkSession, fitted)
    own = {c.lower() for c in df.columns}
    k = 0
    while any(x.startswith(f"mix{k}_") for x in own):
        k += 1
    p = p.select(*[F.col(c).alias(f"mix{k}_{c}") for c in (*AXES, "probability")])
    cond = [cell[a] == p[f"mix{k}_{a}"] for a in AXES]
    return df.join(F.broadcast(p), cond, "inner").where(draw(id_col, text_col) < F.col(f"mix{k}_probability")).select(*[df[c] for c in df.columns])


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, probability and draw of every document, with the fit's error; see mix for nulls, empty texts and repeated rows."""
    return mix(read(spark, sf_dir, "documents"))
