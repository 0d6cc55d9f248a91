"""Registered aggregates (section 4). Stand-ins: orders for jobs and verifications, lineitem for costs and citations, events for the timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsluice.catalog import query
from docsluice.operators import reports as R
from docsluice.sources.tables import table

DEC = "CAST(coalesce(sum(CAST({0} AS DECIMAL(18,2))), 0) AS DOUBLE)"


@query("r4_01_job_counts", """SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS n_queued, count(*) FILTER (o_orderstatus = 'P') AS n_processing, count(*) FILTER (o_orderstatus = 'F') AS n_completed,
 round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) FILTER (o_orderstatus = 'F'), 4) AS mean_duration FROM orders GROUP BY 1""")
def job_counts(spark, d):
    return R.status_counts(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", {"queued": "O", "processing": "P", "completed": "F"}, "o_totalprice", "F")


@query("r4_02_correction_stats", "SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS n_add, count(*) FILTER (event_type = 'error') AS n_remove, count(DISTINCT user_id) AS n_entities, count(DISTINCT event_type) AS n_kinds FROM events")
def correction_stats(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "click").alias("n_add"), F.count_if(F.col("event_type") == "error").alias("n_remove"), F.count_distinct("user_id").alias("n_entities"), F.count_distinct("event_type").alias("n_kinds"))


@query("r4_03_issue_counts", "SELECT l_suppkey, count(*) AS total, count(*) FILTER (l_linestatus = 'O') AS n_open, count(*) FILTER (l_returnflag = 'A') AS n_warning, count(*) FILTER (l_returnflag = 'R') AS n_error FROM lineitem GROUP BY 1")
def issue_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_returnflag") == "A").alias("n_warning"), F.count_if(F.col("l_returnflag") == "R").alias("n_error"))


@query("r4_04_monthly_cost_by_group", f"""SELECT coalesce(CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END, 'Unassigned') AS practice_group, count(DISTINCT c_custkey) AS n_matters, count(DISTINCT o_orderkey) AS n_documents, {DEC.format('o_totalprice')} AS total
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01' GROUP BY 1""")
def monthly_cost_by_group(spark, d):
    """The date range is part of the join condition: groups without costs in the month stay."""
    o = table(spark, d, "orders").where("o_orderdate >= '1998-03-01' AND o_orderdate < '1998-04-01'")
    j = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    group = F.coalesce(F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")), F.lit("Unassigned"))
    return j.groupBy(group.alias("practice_group")).agg(F.count_distinct("c_custkey").alias("n_matters"), F.count_distinct("o_orderkey").alias("n_documents"), R.money("o_totalprice").alias("total"))


@query("r4_05_group_by_month", f"SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS n_matters, count(*) AS n_costs, {DEC.format('o_totalprice')} AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def group_by_month(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_distinct("o_custkey").alias("n_matters"), F.count("*").alias("n_costs"), R.money("o_totalprice").alias("total"))


@query("r4_06_daily_costs", f"SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_returnflag, l_linestatus, {DEC.format('l_extendedprice')} AS total, {DEC.format('l_quantity')} AS tokens, count(*) AS n FROM lineitem GROUP BY ALL")
def daily_costs(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag", "l_linestatus").agg(R.money("l_extendedprice").alias("total"), R.money("l_quantity").alias("tokens"), F.count("*").alias("n"))


@query("r4_07_monthly_costs", f"SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, {DEC.format('l_extendedprice')} AS total FROM lineitem GROUP BY ALL")
def monthly_costs(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag").agg(R.money("l_extendedprice").alias("total"))


@query("r4_08_null_rates", "SELECT source, count(*) AS total, count(*) FILTER (quality IS NULL) AS missing, round(count(*) FILTER (quality IS NULL) / count(*), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING round(count(*) FILTER (quality IS NULL) / count(*), 6) > 0.3")
def null_rates(spark, d):
    return R.null_rates(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "source", F.col("quality"), 0.3)


@query("r4_09_matter_cost_summary", f"""SELECT l_suppkey, {DEC.format('l_extendedprice')} AS total, {DEC.format("CASE WHEN l_returnflag = 'A' THEN l_extendedprice END")} AS total_a, {DEC.format("CASE WHEN l_shipdate >= TIMESTAMP '2001-10-01' - INTERVAL 6 DAY AND l_shipdate < TIMESTAMP '2001-10-02' THEN l_extendedprice END")} AS last_week, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days FROM lineitem GROUP BY 1""")
def matter_cost_summary(spark, d):
    """Totals of a matter, of one provider, and of the seven days up to the as-of day (2001-10-01)."""
    week = (F.col("l_shipdate") >= "2001-09-25") & (F.col("l_shipdate") < "2001-10-02")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(R.money("l_extendedprice").alias("total"), R.money(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("total_a"), R.money(F.when(week, F.col("l_extendedprice"))).alias("last_week"), F.count_distinct(F.to_date("l_shipdate")).alias("n_days"))


@query("r4_10_operation_names", """WITH o AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'embed_chunks' WHEN 1 THEN 'paragraph_scan' WHEN 2 THEN 'general_check' WHEN 3 THEN 'ocr_page' WHEN 4 THEN 'date_extraction' ELSE 'file_export' END AS op FROM part)
 SELECT op, CASE WHEN contains(op, 'embed') THEN 'Embedding' WHEN contains(op, 'rag') THEN 'Q&A' WHEN contains(op, 'ner') THEN 'Entities' WHEN contains(op, 'date') THEN 'Timeline' WHEN contains(op, 'ocr') THEN 'OCR' ELSE 'File Export' END AS name, count(*) AS n FROM o GROUP BY ALL""")
def operation_names(spark, d):
    names = ["embed_chunks", "paragraph_scan", "general_check", "ocr_page", "date_extraction", "file_export"]
    op = F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select(op.alias("op")).groupBy("op", R.operation_name(F.col("op")).alias("name")).agg(F.count("*").alias("n"))


@query("r4_11_citation_counts", "SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS verified, count(*) FILTER (l_returnflag IN ('N', 'R')) AS pending FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type <> 'SMALL' GROUP BY 1")
def citation_counts(spark, d):
    """Citations of an act; those of invalid acts (stand-in: small parts) are dropped."""
    valid = table(spark, d, "part").where("p_type <> 'SMALL'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(valid, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("verified"), F.count_if(F.col("l_returnflag").isin("N", "R")).alias("pending"))


@query("r4_12_resolution_stats", "SELECT 'total' AS item, count(*) FILTER (p_type <> 'SMALL') AS n FROM part UNION ALL SELECT 'missing', count(*) FILTER (p_type = 'ECONOMY') FROM part UNION ALL SELECT 'invalid', count(*) FILTER (p_type = 'SMALL') FROM part UNION ALL SELECT 'inconsistent', p_partkey FROM part WHERE p_size = 1 AND p_type = 'ECONOMY'")
def resolution_stats(spark, d):
    """Counts of acts by resolution, and a row for each act whose resolution contradicts itself."""
    p = table(spark, d, "part")
    counts = p.agg(F.count_if(F.col("p_type") != "SMALL").alias("total"), F.count_if(F.col("p_type") == "ECONOMY").alias("missing"), F.count_if(F.col("p_type") == "SMALL").alias("invalid"))
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).alias("n")) for k in ("total", "missing", "invalid")])))
    return rows.unionByName(p.where("p_size = 1 AND p_type = 'ECONOMY'").select(F.lit("inconsistent").alias("item"), F.col("p_partkey").alias("n")))


@query("r4_13_timeline_stats", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_entities, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(*) FILTER (value > 100) AS n_verified FROM events WHERE year(ts) <= 2031 GROUP BY 1")
def timeline_stats(spark, d):
    return table(spark, d, "events").where(F.year("ts") <= 2031).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_entities"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"), F.count_if(F.col("value") > 100).alias("n_verified"))


@query("r4_14_segments", "SELECT o_custkey, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR AS segment, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1, 2")
def segments(spark, d):
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",")
    name = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    return table(spark, d, "orders").groupBy("o_custkey", name.alias("segment")).agg(F.count("*").alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), listed.alias("orders"))


@query("r4_15_entity_views", "SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1")
def entity_views(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("r4_16_ocr_confidence", """WITH w AS (SELECT l_orderkey, l_linenumber, CAST(1 - l_discount AS DECIMAL(18,4)) AS c FROM lineitem)
 SELECT l_orderkey, n, round(CAST(s AS DOUBLE) / n, 6) AS mean_confidence, CASE WHEN round(CAST(s AS DOUBLE) / n, 6) >= 0.97 THEN 'good' WHEN round(CAST(s AS DOUBLE) / n, 6) >= 0.94 THEN 'fair' ELSE 'poor' END AS quality FROM (SELECT l_orderkey, count(*) AS n, sum(c) AS s FROM w GROUP BY 1)""")
def ocr_confidence(spark, d):
    """Mean of words for each document; the stand-in's values lie higher, so its limits do."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum((1 - F.col("l_discount")).cast("decimal(18,4)")).cast("double").alias("s"))
    m = F.round(F.col("s") / F.col("n"), 6)
    return g.select("l_orderkey", "n", m.alias("mean_confidence"), F.when(m >= 0.97, "good").when(m >= 0.94, "fair").otherwise("poor").alias("quality"))


@query("r4_17_weighted_confidence", "SELECT l_orderkey, round(coalesce(CAST(sum(CAST(l_discount AS DECIMAL(9,4)) * CAST(l_quantity AS DECIMAL(9,2))) AS DOUBLE) / nullif(CAST(sum(CAST(l_quantity AS DECIMAL(9,2))) AS DOUBLE), 0), 0), 10) AS confidence FROM lineitem GROUP BY 1")
def weighted_confidence(spark, d):
    w = F.col("l_quantity").cast("decimal(9,2)")
    top, low = F.sum(F.col("l_discount").cast("decimal(9,4)") * w).cast("double"), F.sum(w).cast("double")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.coalesce(top / F.when(low != 0, low), F.lit(0.0)), 10).alias("confidence"))


@query("r4_18_engine_confidence", """WITH e AS (SELECT user_id, CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 100 WHEN 'purchase' THEN 120 ELSE 80 END AS w, CASE WHEN value > 300 THEN 70 ELSE least(100, CAST(floor(value) AS INTEGER)) END AS c FROM events)
 SELECT user_id, round(greatest(0, least(1, CAST(sum(w * c) AS DOUBLE) / sum(w) / 100)), 8) AS confidence FROM e GROUP BY 1""")
def engine_confidence(spark, d):
    """Weights of the engines 1, 1, 1.2, 0.8; a missing confidence (stand-in: above 300) counts as 0.7."""
    w = F.when(F.col("event_type").isin("click", "view"), 100).when(F.col("event_type") == "purchase", 120).otherwise(80)
    c = F.when(F.col("value") > 300, 70).otherwise(F.least(F.lit(100), F.floor("value")))
    m = F.sum(w * c).cast("double") / F.sum(w) / 100
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), m)), 8).alias("confidence"))


_TIER = "CASE WHEN value > 90 THEN 'optional' WHEN value > 70 THEN 'suggested' ELSE 'required' END"


@query("r4_19_verification_stats", f"SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS n_approved, count(*) FILTER (event_type <> 'purchase' AND {_TIER} = 'required') AS n_required, count(*) FILTER (event_type <> 'purchase' AND {_TIER} = 'suggested') AS n_suggested, count(*) FILTER (event_type <> 'purchase' AND {_TIER} = 'optional') AS n_optional FROM events GROUP BY 1")
def verification_stats(spark, d):
    tier, pending = R.verification_tier(F.col("value")), F.col("event_type") != "purchase"
    cols = [F.count_if(pending & (tier == t)).alias(f"n_{t}") for t in ("required", "suggested", "optional")]
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~pending).alias("n_approved"), *cols)


@query("r4_20_verification_tier", f"SELECT event_id, {_TIER} AS tier FROM events")
def verification_tiers(spark, d):
    return table(spark, d, "events").select("event_id", R.verification_tier(F.col("value")).alias("tier"))


@query("r4_21_aggregated_verification", "WITH e AS (SELECT event_type, CASE WHEN value <= 1 THEN value * 100 ELSE value END AS value FROM events) SELECT event_type, " + ", ".join(f"count(*) FILTER ({_TIER} = '{t}') AS n_{t}" for t in ("required", "suggested", "optional")) + " FROM e GROUP BY 1")
def aggregated_verification(spark, d):
    """Confidences up to one are shares and count as percent."""
    c = F.when(F.col("value") <= 1, F.col("value") * 100).otherwise(F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(R.verification_tier(c) == t).alias(f"n_{t}") for t in ("required", "suggested", "optional")])


@query("r4_22_export_eligibility", "SELECT user_id, count(*) FILTER (value <= 70) AS n_blocking, count(*) FILTER (value > 70 AND value <= 90) AS n_warning, count(*) FILTER (value <= 70) = 0 AS eligible FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def export_eligibility(spark, d):
    g = table(spark, d, "events").where("event_type <> 'purchase'").groupBy("user_id").agg(F.count_if(F.col("value") <= 70).alias("n_blocking"), F.count_if((F.col("value") > 70) & (F.col("value") <= 90)).alias("n_warning"))
    return g.withColumn("eligible", F.col("n_blocking") == 0)


@query("r4_23_tab_stats", "SELECT 'documents' AS tab, count(*) AS n, count(*) FILTER (n_chars < 100) AS issues FROM documents UNION ALL SELECT 'timeline', count(*), count(*) FILTER (event_type = 'error') FROM events UNION ALL SELECT 'entities', count(*), count(*) FILTER (c_acctbal < 0) FROM customer UNION ALL SELECT 'citations', count(*), count(*) FILTER (l_returnflag = 'R') FROM lineitem UNION ALL SELECT 'verification', count(*), count(*) FILTER (o_orderstatus = 'P') FROM orders UNION ALL SELECT 'summary', count(*), 0 FROM pages")
def tab_stats(spark, d):
    tabs = [("documents", "documents", F.col("n_chars") < 100), ("timeline", "events", F.col("event_type") == "error"), ("entities", "customer", F.col("c_acctbal") < 0), ("citations", "lineitem", F.col("l_returnflag") == "R"), ("verification", "orders", F.col("o_orderstatus") == "P"), ("summary", "pages", F.lit(False))]
    out = None
    for tab, name, issue in tabs:
        part = table(spark, d, name).agg(F.count("*").alias("n"), F.count_if(issue).alias("issues")).select(F.lit(tab).alias("tab"), "n", "issues")
        out = part if out is None else out.unionByName(part)
    return out


@query("r4_24_dashboard_stats", "SELECT c_nationkey, count(DISTINCT c_custkey) AS n_matters, count(*) FILTER (o_orderstatus = 'F') AS n_approved, count(*) FILTER (o_orderstatus = 'P') AS n_pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment <> 'HOUSEHOLD' AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey) GROUP BY 1")
def dashboard_stats(spark, d):
    """Counts over the matters of a member (semi join) that are not archived."""
    c = table(spark, d, "customer").where("c_mktsegment <> 'HOUSEHOLD'").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("c_nationkey"), "left_semi")
    j = c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n_matters"), F.count_if(F.col("o_orderstatus") == "F").alias("n_approved"), F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"))


@query("r4_25_severity_pivot", "SELECT user_id, count(*) FILTER (value >= 80) AS high, count(*) FILTER (value >= 60 AND value < 80) AS medium, count(*) FILTER (value < 60) AS low FROM events GROUP BY 1")
def severity_pivot(spark, d):
    s = F.when(F.col("value") >= 80, "high").when(F.col("value") >= 60, "medium").otherwise("low")
    return table(spark, d, "events").select("user_id", s.alias("severity")).groupBy("user_id").pivot("severity", ["high", "medium", "low"]).count().na.fill(0)


@query("r4_26_nest_by_entity", "SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS items FROM events WHERE event_type = 'error' GROUP BY 1")
def nest_by_entity(spark, d):
    items = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), items.alias("items"))


@query("r4_27_nest_by_document", "SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS statements FROM lineitem GROUP BY 1")
def nest_by_document(spark, d):
    s = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(s, ",").alias("statements"))


@query("r4_28_entity_sets", "SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS entities FROM lineitem GROUP BY 1")
def entity_sets(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("entities"))


@query("r4_29_array_union_on_merge", "SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS aliases, count(*) AS mentions FROM supplier GROUP BY 1")
def array_union_on_merge(spark, d):
    one = table(spark, d, "supplier").select("s_nationkey", F.struct("s_suppkey", F.array("s_name").alias("names")).alias("a"))
    names = F.flatten(F.transform(F.sort_array(F.collect_list("a")), lambda x: x["names"]))
    return one.groupBy("s_nationkey").agg(F.array_join(names, ",").alias("aliases"), F.count("*").alias("mentions"))


@query("r4_30_metric_mean", "SELECT doc_id, round(coalesce((coalesce(quality, 0) + coalesce(toxic, 0)) / nullif((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT, 0), 0), 6) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def metric_mean(spark, d):
    """Mean of the metrics that there are, zero without any."""
    there = F.filter(F.array("quality", "toxic"), lambda x: x.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(there) > 0, F.size(there))
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("score"))


@query("r4_31_usage_of_day", f"SELECT lower(event_type) AS provider, count(*) AS n, {DEC.format('value')} AS cost FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1")
def usage_of_day(spark, d):
    return table(spark, d, "events").where("ts >= '2024-01-15' AND ts < '2024-01-16'").groupBy(F.lower("event_type").alias("provider")).agg(F.count("*").alias("n"), R.money("value").alias("cost"))


@query("r4_32_usage_last_week", f"SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, {DEC.format('value')} AS cost FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2")
def usage_last_week(spark, d):
    return table(spark, d, "events").where("ts >= '2024-01-09' AND ts < '2024-01-16'").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), R.money("value").alias("cost"))


@query("r4_33_projection_and_trend", """WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS x FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20' GROUP BY 1, 2), t AS (SELECT user_id, count(*) AS used FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20' GROUP BY 1),
 d AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM g),
 a AS (SELECT user_id, max(n) AS n_days, avg(x) FILTER (i <= n // 2) AS a, avg(x) FILTER (i > n // 2) AS b, avg(x) AS mean FROM d GROUP BY 1), l AS (SELECT a.*, 5 - coalesce(used, 0) AS rest FROM a LEFT JOIN t USING (user_id))
 SELECT user_id, n_days, CASE WHEN n_days < 4 THEN 'stable' WHEN b > a * 1.1 THEN 'increasing' WHEN b < a * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend,
 strftime(CASE WHEN rest <= 0 THEN DATE '2024-01-20' WHEN rest / mean <= 365 THEN CAST(TIMESTAMP '2024-01-20 12:00:00' + to_microseconds(CAST(round(rest / mean * 86400000000) AS BIGINT)) AS DATE) END, '%Y-%m-%d') AS exhausted FROM l""")
def projection_and_trend(spark, d):
    """Days before the 20th are the history, that day's events the current usage; five a day is the limit, which some have used up."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = e.where("day < DATE '2024-01-20'").groupBy("user_id", "day").agg(F.count("*").alias("x"))
    today = e.where("day = DATE '2024-01-20'").groupBy("user_id").agg(F.count("*").alias("used"))
    out = R.usage_trend(daily, "user_id", "day", "x", 5, today, "2024-01-20 12:00:00")
    return out.withColumn("exhausted", F.date_format("exhausted", "yyyy-MM-dd"))


@query("r4_34_threshold_breach", "SELECT l_suppkey, round(CAST(sum(CAST(l_quantity AS DECIMAL(9,2))) AS DOUBLE) / 20000 * 100, 4) AS percent, CAST(sum(CAST(l_quantity AS DECIMAL(9,2))) AS DOUBLE) / 20000 * 100 >= 80 AS breached FROM lineitem GROUP BY 1")
def threshold_breach(spark, d):
    used = F.sum(F.col("l_quantity").cast("decimal(9,2)")).cast("double") / 20000 * 100
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(used, 4).alias("percent"), (used >= 80).alias("breached"))


@query("r4_35_batch_cost_rollup", f"SELECT l_orderkey, {DEC.format('l_quantity')} AS tokens, {DEC.format('l_extendedprice')} AS cost, count(*) AS calls FROM lineitem GROUP BY 1")
def batch_cost_rollup(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(R.money("l_quantity").alias("tokens"), R.money("l_extendedprice").alias("cost"), F.count("*").alias("calls"))


@query("r4_36_seconds_a_page", """WITH r AS (SELECT user_id, value, event_id % 20 + 1 AS pages, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
 SELECT user_id, count(*) AS samples, round(CASE WHEN count(*) >= 3 THEN CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 1000 / sum(pages) ELSE 3.0 END, 8) AS seconds FROM r WHERE i <= 100 GROUP BY 1""")
def seconds_a_page(spark, d):
    """Page-weighted seconds of the last 100 samples; with fewer than three, the default of 3 seconds."""
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("i <= 100")
    s = F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / 1000 / F.sum(F.col("event_id") % 20 + 1)
    return e.groupBy("user_id").agg(F.count("*").alias("samples"), F.round(F.when(F.count("*") >= 3, s).otherwise(3.0), 8).alias("seconds"))


@query("r4_37_eta_range", """WITH x AS (SELECT p_partkey, p_size * 3.0 / greatest(1, p_partkey % 4) AS best, CASE WHEN p_partkey % 15 >= 10 THEN 1.3 WHEN p_partkey % 15 >= 5 THEN 1.5 ELSE 2.0 END::DOUBLE AS w FROM part)
 SELECT p_partkey, greatest(30, CAST(floor(CAST(best AS DOUBLE)) AS BIGINT)) AS best, greatest(30, CAST(floor(CAST(best AS DOUBLE) / w) AS BIGINT)) AS least, greatest(30, CAST(floor(CAST(best AS DOUBLE) * w) AS BIGINT)) AS most FROM x""")
def eta_ranges(spark, d):
    return table(spark, d, "part").select("p_partkey", *R.eta_range(F.col("p_size").cast("double"), F.lit(3.0), F.col("p_partkey") % 4, F.col("p_partkey") % 15))


@query("r4_38_embedding_completeness", "SELECT d.source, count(*) AS total, count(e.vec_id) AS embedded, round(100.0 * count(e.vec_id) / count(*), 4)::DOUBLE AS percent FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1")
def embedding_completeness(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "embeddings").select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left")
    return j.groupBy("source").agg(F.count("*").alias("total"), F.count("vec_id").alias("embedded"), F.round(100.0 * F.count("vec_id") / F.count("*"), 4).alias("percent"))


@query("r4_39_anomaly_summary", "SELECT event_type, count(*) AS total, count(*) FILTER (value >= 80) AS high, count(*) FILTER (value < 80) AS low, count(*) FILTER (user_id % 3 = 0) AS verified, count(*) FILTER (user_id % 3 <> 0 AND user_id % 2 = 0) AS dismissed, count(*) FILTER (user_id % 3 <> 0 AND user_id % 2 <> 0) AS unreviewed FROM events GROUP BY 1")
def anomaly_summary(spark, d):
    """Verified wins over dismissed."""
    v, x, s = F.col("user_id") % 3 == 0, F.col("user_id") % 2 == 0, F.col("value") >= 80
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(s).alias("high"), F.count_if(~s).alias("low"), F.count_if(v).alias("verified"), F.count_if(~v & x).alias("dismissed"), F.count_if(~v & ~x).alias("unreviewed"))


@query("r4_40_attention_items", "SELECT * FROM (SELECT 'contradiction' AS item, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'citation', count(*) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'never', count(*) FROM orders WHERE o_totalprice < 0) WHERE n > 0")
def attention_items(spark, d):
    parts = [("contradiction", "events", "event_type = 'error'"), ("citation", "lineitem", "l_returnflag = 'R'"), ("never", "orders", "o_totalprice < 0")]
    out = [table(spark, d, t).where(c).agg(F.count("*").alias("n")).select(F.lit(k).alias("item"), "n") for k, t, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).where("n > 0")


@query("r4_41_table_stats", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_documents, round(coalesce(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 0), 6) AS mean_rows, count(*) FILTER (l_discount < 0.03) AS n_low FROM lineitem")
def table_stats(spark, d):
    """Extracted tables (lines for tables); over none at all the answer is zeros."""
    m = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.when(F.count("*") > 0, F.count("*"))
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_documents"), F.round(F.coalesce(m, F.lit(0.0)), 6).alias("mean_rows"), F.count_if(F.col("l_discount") < 0.03).alias("n_low"))


@query("r4_42_coverage_report", "SELECT source, round(count(quality) / count(*), 3) AS labelled, round(count(*) FILTER (n_chars > 500) / count(*), 3) AS long FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage_report(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.round(F.count("quality") / F.count("*"), 3).alias("labelled"), F.round(F.count_if(F.col("n_chars") > 500) / F.count("*"), 3).alias("long"))


@query("r4_43_citation_grouping", """SELECT l_partkey, l_linenumber, count(*) AS n, CASE min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) WHEN 0 THEN 'mismatch' WHEN 1 THEN 'pending' ELSE 'verified' END AS worst, count(DISTINCT l_orderkey) AS n_documents,
 round(CAST(sum(CAST(l_discount AS DECIMAL(9,4))) AS DOUBLE) / count(*), 6) AS confidence FROM lineitem GROUP BY 1, 2""")
def citation_grouping(spark, d):
    p = F.min(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count("*").alias("n"), p.alias("p"), F.count_distinct("l_orderkey").alias("n_documents"), F.round(F.sum(F.col("l_discount").cast("decimal(9,4)")).cast("double") / F.count("*"), 6).alias("confidence"))
    return g.withColumn("worst", F.when(F.col("p") == 0, "mismatch").when(F.col("p") == 1, "pending").otherwise("verified")).drop("p")


@query("r4_44_chunk_progress", "SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS done, CAST(floor(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*)) AS BIGINT) AS percent FROM lineitem GROUP BY 1")
def chunk_progress(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    return g.withColumn("percent", F.floor(F.col("done") * 100 / F.col("total")))


@query("r4_45_ready_to_merge", "SELECT l_orderkey, count(*) AS n_chunks FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F')")
def ready_to_merge(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_chunks"), F.bool_and(F.col("l_linestatus") == "F").alias("ok")).where("ok").drop("ok")


@query("r4_46_pair_estimate", "SELECT user_id, count(*) * (count(*) - 1) // 2 AS n_pairs FROM events GROUP BY 1")
def pair_estimate(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("n_pairs"))


@query("r4_47_unread_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS n_unread FROM events GROUP BY 1")
def unread_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n_unread"))
