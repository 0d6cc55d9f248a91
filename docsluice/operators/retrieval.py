"""Lexical, vector and fused ranking.

One tokenizer on both sides (lower case, split at what is no letter or digit, no stemming). Ties are broken by
id, thresholds are inclusive, the fusion is one function. Searches end in orderBy + limit, so Spark keeps
k rows a task and merges those; queries are parameters, never a second big table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Words of a text, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(q: str) -> list[str]:
    out, word = [], ""
    for c in q.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return list(dict.fromkeys(out))


def dot(column: str, q: list[float]) -> Column:
    """Inner product with a fixed vector, in double."""
    parts = F.zip_with(F.col(column).cast("array<double>"), F.array(*[F.lit(float(x)) for x in q]), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def cosine(column: str, q: list[float]) -> Column:
    norm = F.sqrt(F.aggregate(F.transform(F.col(column).cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    own = sum(x * x for x in q) ** 0.5
    return F.when((norm == 0) | (own == 0), F.lit(0.0)).otherwise(dot(column, q) / (norm * F.lit(own)))


def lexical(df: DataFrame, id_col: str, text_col: str, q: str, limit: int, mode: str = "tf", every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, lexical_rank) of the best `limit` rows.

    mode "tf": how often the terms occur; "bm25": with the inverse document frequency and the length
    normalisation, whose corpus statistics are one aggregate row. every: all terms must occur.
    """
    terms = query_terms(q)
    low = F.lower(F.col(text_col))
    # a text that has no term as a string has none as a word: it is not split at all
    found = df.where(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))) if terms else df.where(F.lit(False))
    hit = found.select(F.col(id_col).alias("id"), tokens(text_col).alias("w"))
    hit = hit.select("id", F.size("w").alias("n"), *[_count(F.col("w"), t).alias(f"f{i}") for i, t in enumerate(terms)])
    some = [F.col(f"f{i}") > 0 for i in range(len(terms))]
    if not terms:
        hit = hit.withColumn("score", F.lit(0.0))
    elif mode == "tf":
        hit = hit.withColumn("score", sum((F.col(f"f{i}") for i in range(len(terms))), F.lit(0)).cast("double"))
    else:
        # lengths are counted without splitting the texts
        every_text = df.agg(F.count("*").alias("docs"), F.avg(F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+"))).alias("mean")).first()
        stats = hit.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
        score = F.lit(0.0)
        for i in range(len(terms)):
            idf = math.log(1 + (every_text["docs"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5))
            f = F.col(f"f{i}").cast("double")
            score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("n") / F.lit(float(every_text["mean"] or 1.0))))
        hit = hit.withColumn("score", score)
    for cond in some if every else []:
        hit = hit.withColumn("score", F.when(cond, F.col("score")).otherwise(0.0))
    # the filter comes after the limit: pushed below it, it would split every text twice
    top = hit.select("id", "score").orderBy(F.desc("score"), "id").limit(limit).where("score > 0")
    return top.withColumn("lexical_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # at most `limit` rows


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def vector(df: DataFrame, id_col: str, column: str, q: list[float], limit: int, least: float | None = None, digits: int = 9) -> DataFrame:
    """(id, similarity, vector_rank) of the nearest rows by cosine; least is inclusive. Scores are rounded, so rows
    that differ in the last bits tie and the id decides."""
    s = df.select(F.col(id_col).alias("id"), F.round(cosine(column, q), digits).alias("similarity"))
    if least is not None:
        s = s.where(F.col("similarity") >= least)
    top = s.orderBy(F.desc("similarity"), "id").limit(limit)
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))


def fuse(lex: DataFrame, vec: DataFrame, limit: int, k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: a missing side adds nothing."""
    for w in weights:
        if not 0 <= w <= 2:
            raise ValueError("a weight must be between 0 and 2")
    j = lex.select("id", "lexical_rank").join(vec.select("id", "vector_rank"), "id", "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(r)), F.lit(0.0))
    j = j.withColumn("rrf_score", F.round(part(weights[0], "lexical_rank") + part(weights[1], "vector_rank"), 9))
    return j.orderBy(F.desc("rrf_score"), "id").limit(limit)


def candidates(limit: int) -> int:
    """Rows that each side offers to the fusion."""
    return 2 * min(limit, 30)


def hybrid(docs: DataFrame, vectors: DataFrame, q: str, qv: list[float] | None, limit: int, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), per_side: int | None = None, mode: str = "tf") -> DataFrame:
    """Lexical and vector search fused; without a query vector lexical only, with the same columns."""
    n = per_side or candidates(limit)
    lex = lexical(docs, "doc_id", "text", q, n, mode)
    vec = vector(vectors, "vec_id", "embedding", qv, n) if qv is not None else lex.select("id", F.lit(0.0).alias("similarity"), F.lit(None).cast("int").alias("vector_rank")).limit(0)
    return fuse(lex, vec, limit, k, weights)


def rerank(found: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """(id, rrf_score, relevance, place) of the first rows of a fused result by the relevance that a model gave (scores: id, relevance), best first; rows
    that it did not score come behind those, in the order of the fusion and with a null relevance. A model that failed has scored nothing, so the fusion's order stays."""
    best = scores.where("relevance IS NOT NULL").groupBy("id").agg(F.max("relevance").alias("relevance"))
    order = [F.desc_nulls_last("relevance"), F.desc("rrf_score"), F.col("id")]
    top = found.select("id", "rrf_score").join(best, "id", "left").orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most `limit` rows


def rank_in_tenants(df: DataFrame, tenant: str, id_col: str, score: str, k: int = 60, per_tenant: int = 10) -> DataFrame:
    """The best of every tenant with their reciprocal ranks, in one window over all tenants."""
    w = Window.partitionBy(tenant).orderBy(F.desc(score), id_col)
    r = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_tenant)
    return r.withColumn("rrf_score", F.round(F.lit(1.0) / (k + F.col("place")), 9))


def snippet(text: Column, q: str, width: int = 100) -> Column:
    """At most `width` characters around the first place of the query, else of its first word of three letters or more (words end at white
    space) that occurs, moved back near the end of the text; three characters give way to dots where text is cut. The beginning, without dots, if nothing occurs; null
    texts are empty."""
    c = F.coalesce(text, F.lit(""))
    asked = q.lower()
    found = F.coalesce(*[F.nullif(F.locate(w, F.lower(c)), F.lit(0)) for w in [asked, *[w for w in asked.split() if len(w) >= 3]] if w])
    n = F.length(c)
    end = F.least(n, F.greatest(F.lit(0), found - 1 - width // 2) + width)
    start = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), found - 1 - width // 2), end - width))
    cut = F.substr(c, start + 1, end - start)
    cut = F.when(start > 0, F.concat(F.lit("..."), F.substr(cut, F.lit(4)))).otherwise(cut)
    cut = F.when(end < n, F.concat(F.substr(cut, F.lit(1), F.greatest(F.lit(0), F.length(cut) - 3)), F.lit("..."))).otherwise(cut)
    return F.when(found.isNull(), F.substr(c, F.lit(1), F.lit(width))).otherwise(cut)
