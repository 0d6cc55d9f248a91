"""Registered projections and filters (section 2) and scans, sources and sinks (section 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsluice.catalog import query
from docsluice.operators import filters as P
from docsluice.sources import sinks, tables
from docsluice.sources.tables import table


@query("r1_01_tenant_scan", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def tenant_scan(spark, d):
    return tables.for_tenant(table(spark, d, "documents"), "source", "src3").select("doc_id", "lang", "n_chars")


@query("r1_02_chunk_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200 AND l_linestatus = 'O'")
def chunk_scan(spark, d):
    return table(spark, d, "lineitem").where("l_orderkey BETWEEN 100 AND 200 AND l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber")


@query("r1_03_full_entity_scan", "SELECT c_custkey, c_name FROM customer")
def full_entity_scan(spark, d):
    """The whole table; partitions take the place of a loop over pages."""
    return table(spark, d, "customer").select("c_custkey", "c_name")


@query("r1_05_split_plan", "SELECT p_partkey, s AS page_start, least(s + 14, p_size * 7) AS page_end FROM (SELECT p_partkey, p_size, unnest(range(1, p_size * 7 + 1, 15)) AS s FROM part WHERE p_size > 0)")
def split_plan(spark, d):
    """Ranges of 15 pages; the last one is the remainder. Stand-in page counts."""
    return sinks.split_plan(table(spark, d, "part").where("p_size > 0").select("p_partkey", (F.col("p_size") * 7).cast("long").alias("pages")), "pages", 15).drop("pages")


@query("r1_08_nested_words", "SELECT conv_id, turn, i - 1 AS place, w AS word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations)")
def nested_words(spark, d):
    """Nested pages of blocks of words flattened to one row a word."""
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.split("text", " ").alias("words"))).alias("pages"))
    pages = nested.select("conv_id", F.explode("pages").alias("p"))
    return pages.select("conv_id", "p.turn", F.posexplode("p.words").alias("place", "word")).withColumn("place", F.col("place").cast("long"))


@query(
    "r1_11_html_tables",
    r"""
WITH p AS (SELECT page_id, html || '<TABLE class="x"><tr><th>url</th><td >' || url || '</td></tr>' || chr(10) || '<tr><td><b>' || length(html) || '</b>&amp;' || page_id || '</td></tr></TABLE>' AS html FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<table[^>]*>.*?</table>')) AS t, generate_subscripts(regexp_extract_all(html, '(?is)<table[^>]*>.*?</table>'), 1) - 1 AS no FROM p),
r AS (SELECT page_id, no, unnest(regexp_extract_all(t, '(?is)<tr[^>]*>.*?</tr>')) AS r, generate_subscripts(regexp_extract_all(t, '(?is)<tr[^>]*>.*?</tr>'), 1) - 1 AS row_no FROM t),
c AS (SELECT page_id, no, row_no, unnest(regexp_extract_all(r, '(?is)<t[dh](?:\s[^>]*)?>.*?</t[dh]>')) AS c, generate_subscripts(regexp_extract_all(r, '(?is)<t[dh](?:\s[^>]*)?>.*?</t[dh]>'), 1) - 1 AS col_no FROM r)
SELECT page_id, no::INTEGER AS table_no, row_no::INTEGER AS row_no, col_no::INTEGER AS col_no, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS cell FROM c
""",
)
def html_tables(spark, d):
    """Every cell of every table of the pages, with its place in the grid. The pages given have none, so one stands behind each."""
    own = F.concat(F.lit('<TABLE class="x"><tr><th>url</th><td >'), "url", F.lit("</td></tr>\n<tr><td><b>"), F.length("html").cast("string"), F.lit("</b>&amp;"), F.col("page_id").cast("string"), F.lit("</td></tr></TABLE>"))
    return tables.html_cells(table(spark, d, "pages").withColumn("html", F.concat("html", own)), "page_id", "html")


@query("r1_12_batch_insert", "SELECT doc_id, source, n_chars FROM documents")
def batch_insert(spark, d):
    """Appended by partition of the tenant and read back."""
    path = tables.own_folder(spark)
    sinks.append(table(spark, d, "documents").select("doc_id", "source", "n_chars"), path, ["source"])
    return spark.read.parquet(path).select("doc_id", "source", "n_chars")


@query("r1_13_parallel_insert", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def parallel_insert(spark, d):
    path = tables.own_folder(spark)
    sinks.append(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), path)
    return spark.read.parquet(path).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("r1_14_counting_upsert", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def counting_upsert(spark, d):
    """Old counts (orders before 1998) merged with new ones."""
    o = table(spark, d, "orders")
    old = o.where("o_orderdate < '1998-01-01'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return sinks.merge_counts(old, o.where("o_orderdate >= '1998-01-01'"), "o_custkey", "n")


@query("r1_15_last_writer_wins", "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_writer_wins(spark, d):
    return sinks.latest(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("r1_16_get_or_create", "SELECT c_custkey AS key, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def get_or_create(spark, d):
    have = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("old").alias("origin"))
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return sinks.get_or_create(have, asked, "key", F.lit("new").alias("origin"))


@query("r1_17_coalescing_update", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 9) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def coalescing_update(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(9).alias("toxic"))
    return sinks.coalescing_update(old, table(spark, d, "labels"), "doc_id", ["quality", "toxic"])


@query("r1_18_export_sections", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def export_sections(spark, d):
    """A report section written as CSV and read back."""
    path = tables.own_folder(spark)
    table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).write.option("header", True).csv(path)
    return spark.read.schema("lang string, n long, chars long").option("header", True).csv(path)


@query("r2_01_projection", "SELECT event_id, user_id, value FROM events")
def projection(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "value")


@query("r2_02_mandatory_tenant", "SELECT event_id FROM events WHERE user_id = 7")
def mandatory_tenant(spark, d):
    return tables.for_tenant(table(spark, d, "events"), "user_id", 7).select("event_id")


@query("r2_03_namespace_filter", "SELECT doc_id FROM documents WHERE source = 'src1' AND doc_id IN (1, 21, 41, 42) AND lang = 'en'")
def namespace_filter(spark, d):
    return table(spark, d, "documents").where(tables.namespace_filter("source", "src1", "doc_id", [1, 21, 41, 42], "lang", "en")).select("doc_id")


@query(
    "r2_04_checked_vector_search",
    """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * e[i]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS similarity FROM embeddings, q)
SELECT vec_id, similarity FROM s WHERE similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 10
""",
)
def checked_vector_search(spark, d):
    """Parameters are validated before anything runs; then the nearest vectors of the first one, above a threshold."""
    from docsluice.operators import retrieval

    e = table(spark, d, "embeddings")
    q = list(e.orderBy("vec_id").select("embedding").first()[0])
    P.check_search(len(q), 64, 0.1, 10)
    return retrieval.vector(e, "vec_id", "embedding", q, 10, least=0.1, digits=6).select(F.col("id").alias("vec_id"), "similarity")


@query("r2_05_row_policy", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def row_policy(spark, d):
    return P.members_only(table(spark, d, "customer"), table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey").select("c_custkey")


@query("r2_06_tenant_assertion", "SELECT doc_id, source FROM documents WHERE source = 'src4'")
def tenant_assertion(spark, d):
    return P.assert_tenant(table(spark, d, "documents").where("doc_id % 2 = 0 OR doc_id % 2 = 1").select("doc_id", "source"), "source", "src4")


@query("r2_07_array_contains", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING list_contains(list(l_suppkey), 5)")
def array_contains(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s")).where(F.array_contains("s", F.lit(5).cast("long"))).select("l_orderkey")


@query("r2_08_arrays_overlap", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING list_has_any(list(l_suppkey), [5, 9])")
def arrays_overlap(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s")).where(F.arrays_overlap("s", F.array(F.lit(5).cast("long"), F.lit(9).cast("long")))).select("l_orderkey")


@query("r2_09_ilike", "SELECT doc_id FROM documents WHERE text ILIKE '%license%'")
def ilike(spark, d):
    return table(spark, d, "documents").where(F.col("text").ilike("%license%")).select("doc_id")


_SPLIT = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query("r2_10_all_terms", f"SELECT doc_id FROM documents WHERE list_has_all({_SPLIT}, ['the', 'and', 'ing'])")
def all_terms(spark, d):
    return table(spark, d, "documents").where(P.all_terms(F.col("text"), "the and ING")).select("doc_id")


@query("r2_11_web_query", f"""SELECT doc_id FROM documents WHERE (list_contains({_SPLIT}, 'the') AND NOT list_contains({_SPLIT}, 'idiot') AND (list_contains({_SPLIT}, 'mit') OR list_contains({_SPLIT}, 'ing')))
 OR (' ' || array_to_string({_SPLIT}, ' ') || ' ') LIKE '% apache license %'""")
def web_query(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where((P.web_query(t, "the -idiot") & P.web_query(t, "mit or ing")) | P.web_query(t, '"apache license"')).select("doc_id")


@query("r2_12_sanitised", "SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s\\-.,'']', '', 'g'), '\\s+', ' ', 'g')), 500) AS text FROM conversations")
def sanitised(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", P.sanitise(F.col("text")).alias("text"))


@query("r2_13_classified_events", "SELECT event_id FROM events WHERE event_type <> 'view' AND value >= 50 ORDER BY ts, event_id LIMIT 100 OFFSET 50")
def classified_events(spark, d):
    return table(spark, d, "events").where("event_type <> 'view' AND value >= 50").orderBy("ts", "event_id").offset(50).limit(100).select("event_id")


@query("r2_14_unclassified_events", "SELECT event_id FROM events WHERE event_type = 'view' OR value < 7 ORDER BY ts, event_id LIMIT 100")
def unclassified_events(spark, d):
    return table(spark, d, "events").where("event_type = 'view' OR value < 7").orderBy("ts", "event_id").limit(100).select("event_id")


@query("r2_15_contradiction_list", "SELECT event_id, CASE WHEN value >= 80 THEN 'high' WHEN value >= 60 THEN 'medium' ELSE 'low' END AS severity FROM events WHERE event_type = 'error' ORDER BY CASE WHEN value >= 80 THEN 3 WHEN value >= 60 THEN 2 ELSE 1 END DESC, event_id LIMIT 200")
def contradiction_list(spark, d):
    """Sorted by the rank of the severity, not by its name."""
    s = F.when(F.col("value") >= 80, "high").when(F.col("value") >= 60, "medium").otherwise("low")
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", s.alias("severity")).orderBy(P.severity_rank(F.col("severity")).desc(), "event_id").limit(200)


@query("r2_16_anomaly_filter", "SELECT event_id FROM events WHERE event_type = 'error' AND value >= 80 AND props IS NOT NULL")
def anomaly_filter(spark, d):
    return table(spark, d, "events").where("event_type = 'error' AND value >= 80 AND props IS NOT NULL").select("event_id")


@query("r2_17_tag_filter", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red'])")
def tag_filter(spark, d):
    return table(spark, d, "part").where(F.size(F.array_except(F.array(F.lit("red")), F.split("p_name", " "))) == 0).select("p_partkey")


@query("r2_18_library_list", "SELECT p_partkey, p_name, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 3) AS linked FROM part WHERE p_type = 'ECONOMY' AND p_name ILIKE '%ring%' ORDER BY p_retailprice DESC, p_partkey LIMIT 60")
def library_list(spark, d):
    """A page of the library with a flag for linked items; unknown sort keys fall back to the default."""
    linked = table(spark, d, "lineitem").where("l_suppkey = 3").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("linked", F.lit(True))
    p = table(spark, d, "part").where((F.col("p_type") == "ECONOMY") & F.col("p_name").ilike("%ring%"))
    top = p.orderBy(*P.sort_keys("p_retailprice", {"p_retailprice", "p_name"}, "p_name", True), "p_partkey").limit(60)
    return top.join(linked, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("r2_19_confidence_routing", "SELECT event_id, CASE WHEN value < 50 THEN 'human' WHEN value < 85 THEN 'model' END AS route FROM events WHERE value < 85 AND trim(event_type) <> ''")
def confidence_routing(spark, d):
    c = F.col("value") / 100
    return table(spark, d, "events").select("event_id", P.confidence_route(c, F.col("event_type")).alias("route")).where("route IS NOT NULL")


@query("r2_20_document_list", "SELECT doc_id FROM documents WHERE lang = 'de' AND source IN ('src1', 'src2') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5")
def document_list(spark, d):
    return table(spark, d, "documents").where("lang = 'de' AND source IN ('src1', 'src2')").orderBy(F.desc("n_chars"), "doc_id").offset(5).limit(20).select("doc_id")


@query("r2_21_raw_dates", "SELECT event_id FROM events WHERE user_id = 12 AND event_type = 'view' ORDER BY ts, event_id LIMIT 25")
def raw_dates(spark, d):
    return table(spark, d, "events").where("user_id = 12 AND event_type = 'view'").orderBy("ts", "event_id").limit(25).select("event_id")


@query("r2_22_not_deleted", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
def not_deleted(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").where(F.col("toxic").isNull()).select("doc_id")
