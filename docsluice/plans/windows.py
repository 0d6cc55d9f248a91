"""Registered windows and sequences (section 5) and set operations (section 7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsluice.catalog import query
from docsluice.functions import fixed as V
from docsluice.operators import timeline as T
from docsluice.sources.tables import table

ORDER = {"signup": 1, "view": 2, "click": 3, "purchase": 4}
_RANK = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END"


@query("r5_01_rank_by_length", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents")
def rank_by_length(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).cast("long").alias("place"))


@query("r5_02_rank_by_distance", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT label, vec_id, list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) AS s FROM embeddings, q)
 SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS place FROM s""")
def rank_by_distance(spark, d):
    from docsluice.operators.retrieval import dot

    e = table(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    w = Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")
    return e.select("label", "vec_id", F.round(dot("embedding", q), 9).alias("s")).select("label", "vec_id", F.row_number().over(w).cast("long").alias("place"))


@query("r5_03_sequence_violations", f"""WITH e AS (SELECT user_id, event_id, event_type, {_RANK} AS r, ts FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase')),
 n AS (SELECT *, lead(r) OVER w AS nr, lead(event_type) OVER w AS nk, lead(event_id) OVER w AS ni FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id, event_id AS first_id, ni AS next_id, event_type AS first_kind, nk AS next_kind, CASE WHEN (event_type, nk) IN (('click', 'view'), ('purchase', 'view'), ('purchase', 'click')) THEN 'high' ELSE 'medium' END AS severity FROM n WHERE r > nr""")
def sequence_violations(spark, d):
    """Sign-ups, views, clicks and purchases stand for notices, filings, hearings and orders."""
    said = dict(zip(("notice", "filing", "hearing", "order"), ("signup", "view", "click", "purchase"), strict=True))
    return T.sequence_violations(table(spark, d, "events"), "user_id", "ts", "event_type", ORDER, "event_id", [(said[a], said[b]) for a, b in V.CRITICAL_SEQUENCES])


def gap_limits(spark):
    """Limits of the pairs of kinds that have their own (hours stand in for half years: days here)."""
    rows = [("signup", "view", 0, 1), ("view", "click", 1, 2), ("click", "purchase", 0, 2)]
    return spark.createDataFrame(rows, "first_kind string, next_kind string, days int, critical int")


@query("r5_04_gaps", """WITH l(first_kind, next_kind, days, critical) AS (VALUES ('signup', 'view', 0, 1), ('view', 'click', 1, 2), ('click', 'purchase', 0, 2)),
 e AS (SELECT user_id, event_id AS first_id, event_type AS first_kind, lead(event_type) OVER w AS next_kind, date_diff('day', CAST(ts AS DATE), CAST(lead(ts) OVER w AS DATE)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id, first_id, e.first_kind, e.next_kind, CAST(gap AS INTEGER) AS gap, CASE WHEN gap > coalesce(critical, 2) THEN 'high' ELSE 'medium' END AS severity FROM e LEFT JOIN l ON l.first_kind = e.first_kind AND l.next_kind = e.next_kind WHERE gap > coalesce(days, 1)""")
def gaps(spark, d):
    return T.gaps(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id", gap_limits(spark), (1, 2))


@query("r5_05_threshold_lookup", "SELECT event_type, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 ELSE 180 END AS days, count(*) AS n FROM events GROUP BY 1, 2")
def threshold_lookup(spark, d):
    """An explicit limit where there is one, else the default."""
    limits = spark.createDataFrame([("view", 1), ("click", 0)], "event_type string, days int")
    j = table(spark, d, "events").join(F.broadcast(limits), "event_type", "left")
    return j.groupBy("event_type", F.coalesce("days", F.lit(180)).alias("days")).agg(F.count("*").alias("n"))


@query("r5_06_date_outliers", """WITH e AS (SELECT o_custkey, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 q AS (SELECT *, max(day) FILTER (i = CASE WHEN n >= 3 THEN n // 4 ELSE 0 END) OVER (PARTITION BY o_custkey) - day AS early, day - DATE '2000-01-01' AS later FROM e)
 SELECT o_custkey, o_orderkey, CASE WHEN later > 0 THEN 'future' ELSE 'past' END AS rule, CAST(CASE WHEN later > 0 THEN later ELSE early END AS INTEGER) AS days,
 CASE WHEN (later > 0 AND later / 365.25 > 1) OR (later <= 0 AND early / 365.25 > 2) THEN 'high' ELSE 'medium' END AS severity FROM q
 WHERE (later > 0 AND NOT (o_orderpriority IN ('1-URGENT', '2-HIGH') AND later <= 365)) OR (later <= 0 AND early / 365.25 > 1)""")
def date_outliers(spark, d):
    """Dates of orders after the first day of 2000, urgent ones of that year aside, and dates a year or two before the middle of a customer's."""
    return T.date_outliers(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderpriority", "o_orderkey", "2000-01-01", 1, (1, 2), ["1-URGENT", "2-HIGH"])


@query("r5_07_all_anomalies", "SELECT user_id, 'sequence' AS kind, count(*) AS n FROM (" + """SELECT user_id, r, lead(r) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr FROM (SELECT *, """ + _RANK + """ AS r FROM events) WHERE r IS NOT NULL) WHERE r > nr GROUP BY 1
 UNION ALL SELECT user_id, 'gap', count(*) FROM (SELECT user_id, date_diff('day', CAST(ts AS DATE), CAST(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE)) AS gap FROM events) WHERE gap > 1 GROUP BY 1
 UNION ALL SELECT user_id, 'duplicate', count(*) FROM (SELECT a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_id < b.event_id) GROUP BY 1""")
def all_anomalies(spark, d):
    """The detectors over the same events, together. Duplicates of a day are counted as n(n-1)/2, not paired."""
    e = table(spark, d, "events")
    none = spark.createDataFrame([], "first_kind string, next_kind string, days int, critical int")
    parts = [("sequence", T.sequence_violations(e, "user_id", "ts", "event_type", ORDER, "event_id")), ("gap", T.gaps(e, "user_id", "ts", "event_type", "event_id", none, (1, 2)))]
    out = e.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("c")).groupBy("user_id").agg(F.sum(F.expr("c * (c - 1) div 2")).alias("n")).where("n > 0").select("user_id", F.lit("duplicate").alias("kind"), "n")
    for kind, part in parts:
        out = out.unionByName(part.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit(kind).alias("kind"), "n"))
    return out


@query("r5_08_leader_clusters")
def leader_clusters(spark, d):
    """Events of a day clustered by their descriptions; order-dependent, so tested against a plain loop instead of SQL."""
    e = table(spark, d, "events").select(F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), "user_id").alias("day"), "event_id", "value", F.concat("event_type", "props").alias("text"))
    return T.leader_clusters(e, "day", "text", "value", "event_id", 0.6)


@query("r5_09_best_per_date", "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) = 1")
def best_per_date(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return T.best_per_group(o, ["o_custkey", "month"], [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "month", "o_orderkey")


@query("r5_10_date_dedupe", "SELECT min(event_id) AS event_id, lower(trim(event_type)) AS text, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events GROUP BY 2, 3")
def date_dedupe(spark, d):
    """The first of equal (text, date); a minimum by key, so it is partly done before the shuffle."""
    return table(spark, d, "events").groupBy(F.lower(F.trim("event_type")).alias("text"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("event_id").alias("event_id"))


@query("r5_11_reading_order")
def reading_order(spark, d):
    """Words of a page in lines: a line ends where y is more than 2 below the line's first word, not below the last
    word's, so the anchor is carried by an ordered fold. Stand-in boxes from lineitem."""
    box = F.struct(F.col("l_quantity").alias("y"), F.col("l_tax").alias("x"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part"))
    line = "aggregate(boxes, cast(array() as array<struct<line:int,x:double,id:int,part:bigint,anchor:double>>), (a, b) -> array_append(a, named_struct('line', if(size(a) = 0, 0, element_at(a, -1).line + if(abs(b.y - element_at(a, -1).anchor) > 2.0, 1, 0)), 'x', b.x, 'id', b.id, 'part', b.part, 'anchor', if(size(a) = 0 or abs(b.y - element_at(a, -1).anchor) > 2.0, b.y, element_at(a, -1).anchor))))"
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(box)).alias("boxes")).withColumn("placed", F.expr(line))
    return g.select("l_orderkey", F.posexplode(F.expr("transform(array_sort(transform(placed, p -> named_struct('line', p.line, 'x', p.x, 'id', p.id, 'part', p.part))), p -> p)")).alias("place", "w")).select("l_orderkey", "place", F.col("w.id").alias("word"), F.col("w.part").alias("part"), F.col("w.line").alias("line"))


@query("r5_12_running_offset", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_offset FROM lineitem")
def running_offset(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("pages"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("o"))
    return T.running_offset(li, "l_orderkey", "o", "pages").drop("o", "pages")


@query("r5_13_contiguity", """WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS i, CAST(coalesce(sum(o_orderkey % 5 + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS s, CAST(coalesce(sum(o_orderkey % 5 + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS e FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
 x AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY o_custkey ORDER BY i, s) + 1, 1) AS expected FROM c) SELECT o_custkey, o_orderkey, s, expected FROM x WHERE s <> expected""")
def contiguity(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = F.col("o_orderkey") % 5 + 1
    c = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("i"), (F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1 + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).alias("s"), F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("e"))
    return T.contiguity_errors(c, "o_custkey", "i", "s", "e").select("o_custkey", "o_orderkey", "s", "expected")


@query("r5_14_context_words", "SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list(l_partkey) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS before, array_to_string(list(l_partkey) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ',') AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) QUALIFY l_discount > 0.08")
def context_words(spark, d):
    """Two neighbours to either side of each low-confidence word (stand-in: discount above 0.08)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    said = lambda a, z: F.array_join(F.collect_list(F.col("l_partkey").cast("string")).over(w.rowsBetween(a, z)), ",")
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", said(-2, -1).alias("before"), said(1, 2).alias("after")).where("l_discount > 0.08").drop("l_discount")
    return out.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("before", "after")})


@query("r5_15_last_entries", "SELECT conv_id, array_to_string(list_transform((list(turn ORDER BY turn))[-3:], lambda x: x::VARCHAR), ',') AS turns FROM conversations GROUP BY 1")
def last_entries(spark, d):
    turns = F.sort_array(F.collect_list("turn"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(F.slice("t", -F.least(F.size("t"), F.lit(3)), F.lit(3)).cast("array<string>"), ",").alias("turns"))


@query("r5_16_bounded_append", "SELECT conv_id, array_to_string(list_transform((list_append(list(turn ORDER BY turn), 99))[-5:], lambda x: x::VARCHAR), ',') AS turns FROM conversations GROUP BY 1")
def bounded_append(spark, d):
    """Append, keep the newest five in order."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_append(F.sort_array(F.collect_list("turn")), F.lit(99).cast("long")).alias("t"))
    return g.select("conv_id", F.array_join(F.slice("t", -F.least(F.size("t"), F.lit(5)), F.lit(5)).cast("array<string>"), ",").alias("turns"))


@query("r5_17_conversation_window", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def conversation_window(spark, d):
    return T.last_n(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 4)


@query("r5_18_recent_entities", "SELECT event_type, user_id FROM (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY last DESC, user_id) <= 50")
def recent_entities(spark, d):
    g = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("last"))
    return T.last_n(g, ["event_type"], [F.desc("last"), F.col("user_id")], 50).drop("last")


@query("r7_01_concatenation", "SELECT 'matter' AS origin, doc_id AS id FROM documents WHERE source = 'src1' UNION ALL SELECT 'library', item_id FROM benchmark")
def concatenation(spark, d):
    a = table(spark, d, "documents").where("source = 'src1'").select(F.lit("matter").alias("origin"), F.col("doc_id").alias("id"))
    return a.unionByName(table(spark, d, "benchmark").select(F.lit("library").alias("origin"), F.col("item_id").alias("id")))


@query("r7_02_keyed_merge", "SELECT p_brand, p_size, min(pri) AS priority FROM (SELECT p_brand, p_size, 0 AS pri FROM part WHERE p_type = 'SMALL' UNION ALL SELECT p_brand, p_size, 1 FROM part WHERE p_type <> 'SMALL') GROUP BY 1, 2")
def keyed_merge(spark, d):
    """Two lists by key; the first list wins. Only the priority decides, so partial sums do most of the work."""
    p = table(spark, d, "part")
    both = p.where("p_type = 'SMALL'").select("p_brand", "p_size", F.lit(0).alias("pri")).unionByName(p.where("p_type <> 'SMALL'").select("p_brand", "p_size", F.lit(1).alias("pri")))
    return both.groupBy("p_brand", "p_size").agg(F.min("pri").alias("priority"))


@query("r7_03_word_overlap", "SELECT a.p_partkey, len(list_intersect(list_distinct(string_split(a.p_name, ' ')), list_distinct(string_split(b.p_name, ' ')))) AS shared FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def word_overlap(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("v"))
    return p.join(nxt, "p_partkey").select("p_partkey", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"))


@query("r7_04_set_inequality", "SELECT a.l_orderkey, a.s <> b.s AS differ FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) b USING (l_orderkey)")
def set_inequality(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("a"), F.sort_array(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")))).alias("b"))
    return g.where(F.size("b") > 0).select("l_orderkey", (F.col("a") != F.col("b")).alias("differ"))


@query("r7_05_distinct_entities", "SELECT DISTINCT CAST(ts AS DATE)::VARCHAR AS day, user_id FROM events")
def distinct_entities(spark, d):
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").distinct()
