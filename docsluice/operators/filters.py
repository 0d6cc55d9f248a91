"""Predicates, checks and small text filters, all as columns that Spark can push down or generate code for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import fixed as V
from docsluice.functions import text as X

from .retrieval import query_terms, tokens


def check_search(dimension: int, want: int, threshold: float, limit: int) -> None:
    if dimension != want:
        raise ValueError(f"a vector has {dimension} numbers, {want} are needed")
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be between 0 and 1")
    if not 1 <= limit <= 100:
        raise ValueError("the limit must be between 1 and 100")


def members_only(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key a membership table has."""
    return df.join(members, key, "left_semi")


def assert_tenant(df: DataFrame, column: str, tenant: object) -> DataFrame:
    """Only rows of the tenant; how many others there were is observed as `foreign_rows` when the query runs."""
    if tenant is None:
        raise ValueError("a tenant is required")
    mine = F.col(column).eqNullSafe(F.lit(tenant))
    return df.observe("tenant", F.count_if(~mine).alias("foreign_rows")).where(mine)


def all_terms(text: Column, q: str) -> Column:
    """Every term of the query occurs; a query without terms fits nothing."""
    terms = query_terms(q)
    if not terms:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, terms)), tokens(text))) == 0


def web_query(text: Column, q: str) -> Column:
    """Web search syntax: all words, "quoted phrases" in a row, or between alternatives, - before what must not occur."""
    words = tokens(text)
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    pieces = q.split('"')
    parts = [x for k, p in enumerate(pieces) for x in ([(p, True)] if k % 2 else [(w, False) for w in p.split()])]
    groups, negate, either = [], False, False
    for part, phrase in parts:
        if not phrase and part.lower() == "or":
            either = True
            continue
        if not phrase and part == "-":
            negate = True
            continue
        if not phrase and part.startswith("-"):
            negate, part = True, part[1:]
        terms = query_terms(part)
        if not terms:
            continue
        cond = F.contains(joined, F.lit(f" {' '.join(terms)} "))
        cond = ~cond if negate else cond
        if either and groups:
            groups[-1] = groups[-1] | cond
        else:
            groups.append(cond)
        negate = either = False
    out = F.lit(bool(groups))
    for g in groups:
        out = out & g
    return out


def sanitise(text: Column, most: int = 500) -> Column:
    """Letters, digits, white space and - . , ' only; spaces collapsed; cut."""
    kept = F.regexp_replace(text, r"[^\p{L}\p{N}_\s\-.,']", "")
    return F.substring(F.trim(F.regexp_replace(kept, r"\s+", " ")), 1, most)


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def sort_keys(asked: str, allowed: set[str], default: str, descending: bool) -> list[Column]:
    """The asked sort key if it is one of the allowed, else the default."""
    key = F.col(asked if asked in allowed else default)
    return [key.desc() if descending else key.asc()]


def confidence_route(c: Column, text: Column) -> Column:
    """Below 0.50 human review, below 0.85 a model check, else none; blank text is skipped."""
    return F.when(F.trim(text) == "", F.lit(None).cast("string")).when(c < 0.5, "human").when(c < 0.85, "model")


def contents_pages(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, first_page, last_page) of each document's table of contents: from the first to the last page with a
    keyword among the first twenty; 1 to 10 where none has one."""
    hit = F.when((F.col(page) <= V.TOC_PAGES) & X.has_contents_keyword(F.col(text)), F.col(page))
    return pages.groupBy(document).agg(F.coalesce(F.min(hit), F.lit(V.TOC_DEFAULT[0])).cast("long").alias("first_page"), F.coalesce(F.max(hit), F.lit(V.TOC_DEFAULT[1])).cast("long").alias("last_page"))


def quotes_found(quotes: DataFrame, documents: DataFrame, quote_id: str, quote: str, doc_id: str, text: str, words: int = 5) -> DataFrame:
    """(quote_id, doc_id) where the normalised quote stands word for word in the normalised text. Quotes without a word are left out.

    Both sides meet by the hash of a run of words: of `words` words, or of all words of a shorter quote, by its length. Only runs that some
    quote begins with are kept (a Bloom filter drops most others before the shuffle, at no loss where Spark thinks it pays), only texts of candidates are compared.
    """
    def run(w: Column, i: Column, n: Column) -> Column:
        return F.xxhash64(n, F.slice(w, i, n))

    q = quotes.select(F.col(quote_id).alias("q_id"), X.normalise(F.col(quote)).alias("q")).where("q <> ''").withColumn("w", F.split("q", " "))
    q = q.withColumn("n", F.least(F.size("w"), F.lit(words))).select("q_id", "q", "n", run(F.col("w"), F.lit(1), F.col("n")).alias("k"))
    lengths = sorted(r[0] for r in q.select("n").distinct().collect())  # `words` values at most
    t = documents.select(F.col(doc_id).alias("d_id"), X.normalise(F.col(text)).alias("t"))

    def of(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: run(w, i, F.lit(n)))

    def runs(w: Column) -> Column:
        return F.array_distinct(F.flatten(F.array(*[of(w, n) for n in lengths]))) if lengths else F.array().cast("array<bigint>")

    # a one-element array binds the words once; else each run would split the text again
    looked = t.select("d_id", F.explode(F.get(F.transform(F.array(F.split("t", " ")), runs), F.lit(0))).alias("k"))
    pairs = looked.join(q.select("q_id", "k"), "k").select("q_id", "d_id").distinct()
    found = pairs.join(q.select("q_id", "q"), "q_id").join(t, "d_id").where(F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "q", F.lit(" "))))
    return found.select(F.col("q_id").alias(quote_id), F.col("d_id").alias(doc_id))
