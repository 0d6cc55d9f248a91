"""Registered searches, sorts and top-k (section 6). documents are chunks with source as tenant; embeddings meet them by id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsluice.catalog import query
from docsluice.operators import centroids as C
from docsluice.operators import postings as P
from docsluice.operators import retrieval as R
from docsluice.operators import timeline as T
from docsluice.sources.tables import stored, table

Q = "the license version"
_W = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_TF = f"len(list_filter({_W}, lambda x: x IN ('the', 'license', 'version')))"
_VEC = "SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[])), 9) AS s FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def words_index(spark, d):
    """The stored postings of documents; the first search of a version of the table builds them."""
    return P.open_index(spark, stored(spark, d, "documents", "blocks", lambda df, path: P.build(df, "doc_id", "text", path, "source")))


def vector_index(spark, d):
    return C.open_index(spark, stored(spark, d, "embeddings", "lists", lambda df, path: C.build(df, "embedding", path)), table(spark, d, "embeddings").schema)


def lexical_side(spark, d, n, mode="tf", tenant=None):
    return P.lexical(words_index(spark, d), Q, n, mode, tenant=tenant)


def vector_side(spark, d, n, least=None, where=None):
    return C.search(vector_index(spark, d), "vec_id", "embedding", query_vector(spark, d), n, least, where=where)


def fused(spark, d, n, weights=(1.0, 1.0), tenant=None, where=None):
    """Both sides from their stored indexes, fused."""
    side = R.candidates(n)
    return R.fuse(lexical_side(spark, d, side, tenant=tenant), vector_side(spark, d, side, where=where), n, weights=weights)


def _lex(n: int, where: str = "true") -> str:
    return f"SELECT doc_id AS id, {_TF}::DOUBLE AS score, row_number() OVER (ORDER BY {_TF} DESC, doc_id) AS lexical_rank FROM documents WHERE {where} AND {_TF} > 0 QUALIFY lexical_rank <= {n}"


def _vec(n: int, where: str = "true") -> str:
    return f"SELECT vec_id AS id, s AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS vector_rank FROM ({_VEC}) WHERE {where} QUALIFY vector_rank <= {n}"


def _rrf(lex: str, vec: str, n: int, k: int = 60, a: float = 1.0, b: float = 1.0) -> str:
    return f"SELECT coalesce(l.id, v.id) AS id, lexical_rank, vector_rank, round(coalesce({a}::DOUBLE / ({k} + lexical_rank), 0) + coalesce({b}::DOUBLE / ({k} + vector_rank), 0), 9) AS rrf_score FROM ({lex}) l FULL OUTER JOIN ({vec}) v ON l.id = v.id ORDER BY rrf_score DESC, id LIMIT {n}"


def long_ranks(df):
    return df.withColumns({c: F.col(c).cast("long") for c in ("lexical_rank", "vector_rank") if c in df.columns})


@query("hybrid_search", _rrf(_lex(20), _vec(20), 10))
def hybrid_search(spark, d):
    """The flagship: lexical and vector ranks fused."""
    return long_ranks(fused(spark, d, 10))


@query("r6_01_vector_topk", f"SELECT vec_id AS id, s AS similarity FROM ({_VEC}) WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return vector_side(spark, d, 10, 0.1).select("id", "similarity")


@query("r6_02_filtered_vector_topk", f"SELECT vec_id AS id, s AS similarity FROM ({_VEC}) WHERE s >= 0.0 AND label IN (1, 2, 3) ORDER BY s DESC, vec_id LIMIT 15")
def filtered_vector_topk(spark, d):
    return vector_side(spark, d, 15, 0.0, "label IN (1, 2, 3)").select("id", "similarity")


@query("r6_03_lexical_topk", _lex(30))
def lexical_topk(spark, d):
    return long_ranks(lexical_side(spark, d, 30))


@query("r6_04_rrf_topk", _rrf(_lex(60), _vec(60), 30, 60, 0.5, 1.5))
def rrf_topk(spark, d):
    return long_ranks(fused(spark, d, 30, (0.5, 1.5)))


@query("r6_05_tenant_hybrid", _rrf(_lex(20, "source = 'src1'"), _vec(20, "label = 1"), 10))
def tenant_hybrid(spark, d):
    return long_ranks(fused(spark, d, 10, tenant="src1", where="label = 1"))


@query("r6_06_bm25_search", f"""WITH t AS (SELECT doc_id, len({_W}) AS n, {', '.join(f"len(list_filter({_W}, lambda x: x = '{t}'))::DOUBLE AS f{i}" for i, t in enumerate(Q.split()))} FROM documents),
 g AS (SELECT count(*) AS docs, avg(n) AS mean, {', '.join(f'count(*) FILTER (f{i} > 0) AS d{i}' for i in range(3))} FROM t),
 s AS (SELECT doc_id AS id, round({' + '.join(f'ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))' for i in range(3))}, 6) AS score FROM t, g)
 SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 30""")
def bm25_search(spark, d):
    return lexical_side(spark, d, 30, "bm25").select("id", F.round("score", 6).alias("score"))


@query("r6_07_semantic_search", f"SELECT vec_id AS id, label, s AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS place FROM ({_VEC}) ORDER BY place LIMIT 20")
def semantic_search(spark, d):
    """With the tenant and the rank in the result."""
    e = table(spark, d, "embeddings")
    top = vector_side(spark, d, 20)
    return top.join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("id", "label", "similarity", F.col("vector_rank").cast("long").alias("place"))


@query("r6_08_rerank", f"WITH h AS ({_rrf(_lex(20), _vec(20), 10)}), s AS (SELECT id, rrf_score, CASE WHEN lang <> 'en' THEN round(1.0 / n_chars, 9) END AS relevance FROM h LEFT JOIN documents ON doc_id = id) SELECT id, rrf_score, relevance, row_number() OVER (ORDER BY relevance DESC NULLS LAST, rrf_score DESC, id) AS place FROM s QUALIFY place <= 7")
def rerank(spark, d):
    """Candidates by a given relevance (of texts that are not English; shorter is better), then the others as the fusion has them."""
    scores = table(spark, d, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("id"), F.round(1.0 / F.col("n_chars"), 9).alias("relevance"))
    return R.rerank(fused(spark, d, 10), scores, 7).withColumn("place", F.col("place").cast("long"))


@query("r6_09_rerank_fallback", f"SELECT id, round(1.0 - 0.1 * (row_number() OVER (ORDER BY rrf_score DESC, id) - 1), 4)::DOUBLE AS score FROM ({_rrf(_lex(20), _vec(20), 10)})")
def rerank_fallback(spark, d):
    h = fused(spark, d, 10)
    return h.select("id", F.round(1.0 - 0.1 * (F.row_number().over(Window.orderBy(F.desc("rrf_score"), "id")) - 1), 4).alias("score"))


@query("r6_10_search_with_library", f"SELECT * FROM (SELECT 'matter' AS origin, id, rrf_score FROM ({_rrf(_lex(20), _vec(20), 10)}) UNION ALL SELECT 'library', id, round(1.0::DOUBLE / (60 + vector_rank), 9) FROM ({_vec(10, 'label = 5')})) ORDER BY rrf_score DESC, origin, id LIMIT 12")
def search_with_library(spark, d):
    m = fused(spark, d, 10).select(F.lit("matter").alias("origin"), "id", "rrf_score")
    lib = vector_side(spark, d, 10, where="label = 5")
    both = m.unionByName(lib.select(F.lit("library").alias("origin"), "id", F.round(F.lit(1.0) / (60 + F.col("vector_rank")), 9).alias("rrf_score")))
    return both.orderBy(F.desc("rrf_score"), "origin", "id").limit(12)


@query("r6_11_cross_tenant_rrf", f"WITH s AS (SELECT source, doc_id, {_TF} AS score FROM documents WHERE {_TF} > 0), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM s QUALIFY place <= 10) SELECT source, doc_id, place, round(1.0::DOUBLE / (60 + place), 9) AS rrf_score FROM r")
def cross_tenant_rrf(spark, d):
    """The best ten of every tenant in one window, no loop over tenants."""
    s = P.term_counts(words_index(spark, d), Q).toDF("source", "doc_id", "score")
    return R.rank_in_tenants(s, "source", "doc_id", "score").select("source", "doc_id", F.col("place").cast("long").alias("place"), "rrf_score")


@query("r6_12_global_search", f"WITH s AS (SELECT source, doc_id, {_TF} AS score FROM documents WHERE {_TF} > 0), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM s QUALIFY place <= 10) SELECT source, doc_id, round(1.0::DOUBLE / (60 + place), 9) AS rrf_score FROM r ORDER BY rrf_score DESC, source, doc_id LIMIT 50")
def global_search(spark, d):
    return cross_tenant_rrf(spark, d).select("source", "doc_id", "rrf_score").orderBy(F.desc("rrf_score"), "source", "doc_id").limit(50)


@query("r6_13_alias_expansion", "SELECT doc_id FROM documents WHERE list_contains(" + _W + ", 'license') OR list_contains(" + _W + ", 'rights')")
def alias_expansion(spark, d):
    """The first name of the query that has aliases is replaced by all of them, on the lexical side only."""
    from docsluice.operators.filters import web_query

    aliases = {"license": ["license", "rights"]}
    expanded = " or ".join(next(v for k, v in aliases.items() if k in "license".split()))
    return table(spark, d, "documents").where(web_query(F.col("text"), expanded)).select("doc_id")


@query("r6_14_suspicious_pairs", """WITH p AS (SELECT a.user_id, a.event_id AS a, b.event_id AS b, round(CASE WHEN CAST(a.ts AS DATE) <> CAST(b.ts AS DATE) THEN 0.4 ELSE 0 END + CASE WHEN a.value <> b.value THEN 0.5 ELSE 0 END + 0.1, 2)::DOUBLE AS score FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type = b.event_type WHERE a.event_type = 'purchase')
 SELECT user_id, a, b, score FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, a, b) <= 5""")
def suspicious_pairs(spark, d):
    from docsluice.operators.pairs import top_suspicious

    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.array(F.to_date("ts")).alias("days"), F.array("value").alias("values"))
    return top_suspicious(e, "user_id", "event_id", "days", "values", 5)


@query("r6_15_merge_suggestions", """WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, round(jaccard(a.p_name, b.p_name), 2) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey) SELECT * FROM p WHERE similarity >= 0.6 ORDER BY similarity DESC, a, b LIMIT 100""")
def merge_suggestions(spark, d):
    """Pairs of one block (brand and size) by the overlap of their names' characters."""
    from docsluice.operators.pairs import top_similar

    p = table(spark, d, "part").where("p_brand IS NOT NULL AND p_size IS NOT NULL").select("p_partkey", F.struct("p_brand", "p_size").alias("block"), F.array_distinct(F.filter(F.split("p_name", ""), lambda c: c != "")).alias("c"))
    return top_similar(p, "block", "p_partkey", "c", 0.6, 100)


@query("r6_16_source_merge", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity) = 1")
def source_merge(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return T.best_per_group(li, ["l_orderkey", "l_partkey"], [F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity")]).select("l_orderkey", "l_partkey", "l_suppkey")


@query("r6_17_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 100")
def page(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(25).select("o_orderkey")


@query("r6_18_section_lookup", "WITH x AS (SELECT p_brand, p_partkey, p_size, 0 AS pri FROM part WHERE p_type = 'SMALL' UNION ALL SELECT p_brand, p_partkey, p_size, 1 FROM part WHERE p_size > 10 AND p_name ILIKE '%ring%') SELECT p_brand, p_partkey FROM x QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY pri, p_size DESC, p_partkey) = 1")
def section_lookup(spark, d):
    """The index if it has the section, else the last page of a text search that skips the first ten."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_type", "p_name")
    x = p.where("p_type = 'SMALL'").withColumn("pri", F.lit(0)).unionByName(p.where((F.col("p_size") > 10) & F.col("p_name").ilike("%ring%")).withColumn("pri", F.lit(1)))
    return T.best_per_group(x, ["p_brand"], [F.col("pri"), F.desc("p_size"), F.col("p_partkey")]).select("p_brand", "p_partkey")


@query("r6_19_newest_items", "SELECT item_id FROM benchmark ORDER BY item_id DESC LIMIT 10")
def newest_items(spark, d):
    return table(spark, d, "benchmark").orderBy(F.desc("item_id")).limit(10).select("item_id")


@query("r6_20_document_samples", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def document_samples(spark, d):
    return T.last_n(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], [F.col("turn")], 2)


@query("r6_21_recent_events", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY ts DESC, event_id LIMIT 40")
def recent_events(spark, d):
    active = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(active, "user_id", "left_semi").orderBy(F.desc("ts"), "event_id").limit(40).select("event_id")


@query("r6_22_search_inspector", f"SELECT coalesce(l.id, v.id) AS id, lexical_rank, vector_rank FROM ({_lex(20)}) l FULL OUTER JOIN ({_vec(20)}) v ON l.id = v.id")
def search_inspector(spark, d):
    """Both branches with their ranks; the same functions as the search itself."""
    lex, vec = lexical_side(spark, d, 20), vector_side(spark, d, 20)
    return long_ranks(lex.select("id", "lexical_rank").join(vec.select("id", "vector_rank"), "id", "full_outer"))


@query("r6_23_fusion_counts", f"SELECT count(*) FILTER (lexical_rank IS NOT NULL AND vector_rank IS NOT NULL) AS n_both, count(*) FILTER (vector_rank IS NULL) AS n_lexical, count(*) FILTER (lexical_rank IS NULL) AS n_vector FROM (SELECT lexical_rank, vector_rank FROM ({_lex(60)}) l FULL OUTER JOIN ({_vec(60)}) v ON l.id = v.id)")
def fusion_counts(spark, d):
    h = R.fuse(lexical_side(spark, d, 60), vector_side(spark, d, 60), 1000)
    both = F.col("lexical_rank").isNotNull() & F.col("vector_rank").isNotNull()
    return h.agg(F.count_if(both).alias("n_both"), F.count_if(F.col("vector_rank").isNull()).alias("n_lexical"), F.count_if(F.col("lexical_rank").isNull()).alias("n_vector"))
