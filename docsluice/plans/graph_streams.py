"""Registered graph operators (section 9), stateful operators (10) and the rules around model calls (11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.catalog import query
from docsluice.operators import entities as E
from docsluice.sources.tables import own_folder, table
from docsluice.streaming import jobs as S
from docsluice.streaming.folds import RateLimit, Sessions, fold, fold_stream


def _save(df: DataFrame) -> DataFrame:
    path = own_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("r9_01_resolve_or_create", "SELECT DISTINCT lower(c_mktsegment) AS mention, (SELECT min(p_partkey) FROM part WHERE p_type = c_mktsegment) AS entity FROM customer UNION SELECT DISTINCT lower(p_type), (SELECT min(q.p_partkey) FROM part q WHERE q.p_type = part.p_type) FROM part")
def resolve_or_create(spark, d):
    names = table(spark, d, "part").select("p_type", "p_partkey")
    asked = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("m")).unionByName(names.select(F.lower("p_type").alias("m")))
    return E.resolve(asked, names, "m", "p_type", "p_partkey")


@query("r9_02_entity_upsert", "SELECT p_name, p_type, CAST(sum(greatest(1, coalesce(n, 0))) AS BIGINT) AS mentions, min(p_partkey) AS entity FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1, 2")
def entity_upsert(spark, d):
    """One entity for each (name, type); each extraction adds its mentions, one at least."""
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    j = table(spark, d, "part").join(n, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy("p_name", "p_type").agg(F.sum(F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).alias("mentions"), F.min("p_partkey").alias("entity"))


@query("r9_03_alias_tiers", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, CASE WHEN jaro_winkler_similarity(a.s_name, b.s_name) >= 0.85 THEN 'link' ELSE 'context' END AS tier FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE jaro_winkler_similarity(a.s_name, b.s_name) >= 0.6")
def alias_tiers(spark, d):
    from docsluice.functions.columns import jaro_winkler_column
    from docsluice.operators.pairs import statement_pairs

    p = statement_pairs(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"), "s_nationkey", "s_suppkey")
    return p.select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), E.alias_tier(jaro_winkler_column(F.col("a.s_name"), F.col("b.s_name"))).alias("tier")).where("tier IS NOT NULL")


def _edges(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").where((k % 7 != 0) & (k >= 1)).select((k - 1).alias("a"), k.alias("b"))


@query("r9_04_components", "SELECT c_custkey AS node, CASE WHEN c_custkey % 7 = 0 THEN c_custkey ELSE c_custkey - c_custkey % 7 END AS root FROM customer WHERE NOT (c_custkey % 7 = 0 AND c_custkey + 1 NOT IN (SELECT c_custkey FROM customer))")
def components(spark, d):
    """Chains of seven joined by their links."""
    return E.components(_edges(spark, d), _save)


@query("r9_04_closure", "WITH n AS (SELECT DISTINCT unnest([c_custkey - 1, c_custkey]) AS k FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey >= 1) SELECT a.k AS a, b.k AS b, 0.75::DOUBLE AS confidence FROM n a JOIN n b ON a.k - a.k % 7 = b.k - b.k % 7 AND b.k - a.k >= 2")
def closure(spark, d):
    """Every pair of a chain of seven that is no link of it."""
    e = _edges(spark, d)
    return E.closure_pairs(e, E.components(e, _save))


def _entities(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("alias "), F.col("s_suppkey").cast("string"))).alias("aliases"), F.lit(1).cast("long").alias("mentions"))
    pairs = e.where("id % 3 <> 0").select((F.col("id") - F.col("id") % 3).alias("kept"), F.col("id").alias("merged"))
    return e, pairs


@query("r9_05_soft_merge", "SELECT k.s_suppkey AS id, 'alias ' || k.s_suppkey || coalesce(',' || (SELECT string_agg(m.s_name || ',alias ' || m.s_suppkey, ',' ORDER BY m.s_suppkey) FROM supplier m WHERE m.s_suppkey % 3 <> 0 AND m.s_suppkey - m.s_suppkey % 3 = k.s_suppkey), '') AS aliases, 1 + (SELECT count(*) FROM supplier m WHERE m.s_suppkey % 3 <> 0 AND m.s_suppkey - m.s_suppkey % 3 = k.s_suppkey) AS mentions, CASE WHEN k.s_suppkey % 3 <> 0 THEN k.s_suppkey - k.s_suppkey % 3 END AS merged_into FROM supplier k")
def soft_merge(spark, d):
    return E.merge(*_entities(spark, d)).select("id", F.array_join("aliases", ",").alias("aliases"), "mentions", "merged_into")


@query("r9_06_unmerge", "SELECT k.s_suppkey AS id, 'alias ' || k.s_suppkey || coalesce(',' || (SELECT string_agg('alias ' || m.s_suppkey, ',' ORDER BY m.s_suppkey) FROM supplier m WHERE m.s_suppkey % 3 <> 0 AND m.s_suppkey - m.s_suppkey % 3 = k.s_suppkey), '') AS aliases, 1::BIGINT AS mentions FROM supplier k")
def unmerge(spark, d):
    """Names and counts go back, the merged one's aliases stay: lossy by definition."""
    e, pairs = _entities(spark, d)
    undo = pairs.join(e, pairs["merged"] == e["id"]).select("kept", "merged", "name", "mentions")
    return E.unmerge(E.merge(e, pairs), undo).select("id", F.array_join("aliases", ",").alias("aliases"), "mentions")


@query("r9_07_relationships", "SELECT 5 AS node, l_partkey AS other, count(*) AS n FROM lineitem WHERE l_suppkey = 5 GROUP BY 2 UNION ALL SELECT 5, l_suppkey, count(*) FROM lineitem WHERE l_partkey = 5 GROUP BY 2")
def relationships(spark, d):
    li = table(spark, d, "lineitem")
    out, into = li.where("l_suppkey = 5").groupBy(F.col("l_partkey").alias("other")), li.where("l_partkey = 5").groupBy(F.col("l_suppkey").alias("other"))
    return out.count().unionByName(into.count()).select(F.lit(5).alias("node"), "other", F.col("count").alias("n"))


_GRAPH = """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem), n AS (SELECT 'p' || p_partkey AS id, p_type AS kind, p_name AS name, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS mentions FROM part
    UNION ALL SELECT 's' || s_suppkey, 'SUPPLIER', s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) FROM supplier), """


def graph(spark, d):
    """Parts and suppliers with how often they are mentioned in orders, and an edge for each that meet there."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"))
    n = parts.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("SUPPLIER").alias("kind"), F.col("s_name").alias("name")))
    times = li.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("mentions"))
    return n.join(times, "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0))), li.distinct()


@query("r9_08_graph_view", _GRAPH + "v AS (SELECT id FROM n WHERE kind IN ('ECONOMY', 'PROMO', 'SUPPLIER') AND contains(lower(name), 'r') AND mentions >= 20) SELECT source, target FROM e WHERE source IN (FROM v) AND target IN (FROM v)")
def graph_view(spark, d):
    """Edges whose two nodes pass the view's filters on kind, name and mentions."""
    return E.graph_view(*graph(spark, d), ["ECONOMY", "PROMO", "SUPPLIER"], " R ", 20)[1].select("source", "target")


@query("r9_08_neighbours", _GRAPH + "v AS (SELECT id FROM n WHERE contains(lower(name), 'red ring')) SELECT DISTINCT id, neighbour FROM (SELECT source AS id, target AS neighbour FROM e UNION ALL SELECT target, source FROM e) WHERE id IN (FROM v)")
def graph_neighbours(spark, d):
    """The neighbours of the nodes that a search finds."""
    nodes, edges = graph(spark, d)
    return E.connected(edges, E.graph_view(nodes, edges, search="Red Ring")[0])


_LIMIT = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (
    SELECT user_id, event_id, ts, i, [ts] AS q, CAST(0 AS BIGINT) AS n, CAST(0.0 AS DOUBLE) AS w FROM e WHERE i = 1
    UNION ALL
    SELECT user_id, event_id, ts, i, CASE WHEN len(live) < 2 THEN list_append(live, ts) ELSE live END, len(live), CASE WHEN len(live) < 2 THEN 0.0 ELSE greatest(0.1, (epoch_us(live[1]) + 86400000000 - epoch_us(ts)) / 1000000.0) END
    FROM (SELECT e.user_id, e.event_id, e.ts, e.i, list_filter(f.q, lambda t: t > e.ts - INTERVAL 24 HOUR) AS live FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
)
SELECT user_id, event_id, CAST(n AS INTEGER) AS in_window, n < 2 AS allowed, round(w, 3) AS wait_seconds FROM f"""
#: What the watermark of a stream has passed when all is read: it is an hour behind the latest event, in whole milliseconds.
_PASSED = " WHERE epoch_us(ts) <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events) * 1000"


@query("r10_02_rate_limit", _LIMIT)
def rate_limit(spark, d):
    """At most two admitted events of a user in a day, each decided after those before it."""
    out = fold(table(spark, d, "events"), ["user_id"], "ts", "event_id", RateLimit(2, 24 * 3600))
    return out.withColumn("wait_seconds", F.round("wait_seconds", 3))


@query("r10_02_streamed_limit", _LIMIT + _PASSED)
def streamed_limit(spark, d):
    """The same limiter as the state of each user of a stream."""
    out = fold_stream(S.stream_table(spark, d, "events"), ["user_id"], "ts", "event_id", RateLimit(2, 24 * 3600))
    return S.run_to_table(out, own_folder(spark)).withColumn("wait_seconds", F.round("wait_seconds", 3))


_LIVES = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS stop, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (
    SELECT user_id, event_id, t, i, CAST(CASE WHEN stop THEN 0 ELSE 1 END AS INTEGER) AS n, NOT stop AS live, t AS created, t + 43200000000 AS expires, CAST(0 AS INTEGER) AS extended, false AS over, CAST(CASE WHEN stop THEN 0 ELSE 1 END AS INTEGER) AS messages,
        CAST(0 AS INTEGER) AS archive, CAST(0 AS INTEGER) AS had, CASE WHEN stop THEN 'none' ELSE 'created' END AS outcome, CAST(NULL AS INTEGER) AS origin
    FROM e WHERE i = 1
    UNION ALL
    SELECT user_id, event_id, t, i, CASE WHEN o IN ('created', 'restored') THEN n + 1 ELSE n END, o NOT IN ('ended', 'none'), CASE WHEN o IN ('created', 'restored') THEN t ELSE created END,
        CASE WHEN o IN ('created', 'restored', 'extended') THEN t + 43200000000 ELSE expires END, CASE WHEN o IN ('created', 'restored') THEN 0 WHEN o = 'extended' THEN extended + 1 ELSE extended END, o IN ('limit', 'kept'),
        CASE o WHEN 'created' THEN 1 WHEN 'restored' THEN least(had, 5) + 1 WHEN 'ended' THEN messages WHEN 'none' THEN messages ELSE least(20, messages + 1) END,
        CASE WHEN o = 'ended' THEN n ELSE archive END, CASE WHEN o = 'ended' THEN messages ELSE had END, o, CASE WHEN o = 'restored' THEN archive END
    FROM (
        SELECT *, CASE WHEN stop AND alive THEN 'ended' WHEN stop THEN 'none' WHEN NOT alive AND archive > 0 THEN 'restored' WHEN NOT alive THEN 'created' WHEN over THEN 'kept' WHEN t - created >= 129600000000 THEN 'limit' ELSE 'extended' END AS o
        FROM (SELECT e.user_id, e.event_id, e.t, e.i, e.stop, f.n, f.created, f.expires, f.extended, f.over, f.messages, f.live AND e.t < f.expires AS alive,
                CASE WHEN f.live AND e.t >= f.expires THEN f.n ELSE f.archive END AS archive, CASE WHEN f.live AND e.t >= f.expires THEN f.messages ELSE f.had END AS had
            FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    )
)
SELECT user_id, event_id, CASE WHEN outcome <> 'none' THEN n END AS session, outcome, CASE WHEN outcome <> 'none' THEN extended END AS extended, CASE WHEN outcome <> 'none' THEN messages END AS messages, origin AS restored_from,
    CASE WHEN outcome NOT IN ('none', 'ended') THEN expires END AS expires_us FROM f"""


def _lives(events):
    return events.withColumn("ends", F.col("event_type") == "error")


@query("r10_03_session_lives", _LIVES)
def session_lives(spark, d):
    """Sessions of twelve hours without an access and of a day and a half at most; an error ends one."""
    return fold(_lives(table(spark, d, "events")), ["user_id"], "ts", "event_id", Sessions(12 * 3600, 36 * 3600), ends="ends")


@query("r10_03_streamed_lives", _LIVES + _PASSED.replace("epoch_us(ts)", "t"))
def streamed_lives(spark, d):
    """The same sessions as the state of each user of a stream."""
    out = fold_stream(_lives(S.stream_table(spark, d, "events")), ["user_id"], "ts", "event_id", Sessions(12 * 3600, 36 * 3600), ends="ends")
    return S.run_to_table(out, own_folder(spark))


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, count(*) AS n FROM s GROUP BY user_id, s"""


@query("r10_03_sessions", _SESSIONS)
def sessions(spark, d):
    s = S.sessions(table(spark, d, "events"), "user_id", "ts", "2 hours")
    return s.select("user_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"), "n")


@query("r10_03_streamed_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) FROM events) GROUP BY 1, 2")
def streamed_windows(spark, d):
    """Daily counts of the event stream; the days that the watermark has not passed are not yet out."""
    w = S.windowed_counts(S.stream_table(spark, d, "events"), "ts", "event_type", "1 day", "1 hour")
    return S.run_to_table(w, own_folder(spark)).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "r10_04_pronouns",
    """
WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 'male' WHEN 'view' THEN 'female' WHEN 'error' THEN 'document' ELSE 'unknown' END AS kind FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e)
SELECT event_id, last_value(CASE WHEN kind IN ('male', 'unknown') THEN event_id END IGNORE NULLS) OVER x AS he, last_value(CASE WHEN kind IN ('female', 'unknown') THEN event_id END IGNORE NULLS) OVER x AS she,
    last_value(event_id) OVER x AS they, last_value(CASE WHEN kind IN ('document', 'unknown') THEN event_id END IGNORE NULLS) OVER x AS it
FROM w WINDOW x AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
)
def pronouns(spark, d):
    """Whom he, she, they and it mean before each row: the most recent mention of a kind that the pronoun may stand for."""
    kind = F.create_map(*[F.lit(x) for x in ("click", "male", "view", "female", "error", "document")])
    e = table(spark, d, "events").withColumn("kind", F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("unknown")))
    return e.select("event_id", *[S.referent(p, "user_id", ["ts", "event_id"], F.col("kind"), F.col("event_id")).alias(p) for p in ("he", "she", "they", "it")])


@query("r10_05_rolling_history", "SELECT event_id, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE) AS total FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_history(spark, d):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).over(w).cast("double").alias("total"))


@query("r10_06_stale_jobs", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 30 MINUTE THEN CASE WHEN o_orderkey % 5 < 3 THEN 'O' ELSE 'X' END ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 30 MINUTE AND o_orderkey % 5 < 3 THEN o_orderkey % 5 + 1 ELSE o_orderkey % 5 END AS attempts FROM orders")
def stale_jobs(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", (F.col("o_orderkey") % 5).alias("tries"))
    return S.recover_stale(o, "o_orderstatus", "o_orderdate", "tries", "1999-01-01", 30, 3).select("o_orderkey", F.col("next_status").alias("status"), F.col("next_attempts").alias("attempts"))


@query("r10_07_stale_chunks", "SELECT event_id, CASE WHEN event_type = 'error' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 90 SECOND THEN CASE WHEN event_id % 4 < 3 THEN 'pending' ELSE 'failed' END ELSE event_type END AS status FROM events")
def stale_chunks(spark, d):
    stale = (F.col("event_type") == "error") & (F.col("ts") < F.expr("TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 90 SECOND"))
    return table(spark, d, "events").select("event_id", F.when(stale & (F.col("event_id") % 4 < 3), "pending").when(stale, "failed").otherwise(F.col("event_type")).alias("status"))


@query("r10_09_cache_staleness", "SELECT o_custkey, max(o_orderdate) > TIMESTAMP '2000-06-01' AS stale FROM orders GROUP BY 1")
def cache_staleness(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.max("o_orderdate") > F.lit("2000-06-01").cast("timestamp")).alias("stale"))


@query("r10_10_status_sync", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'chunking' WHEN e.vec_id IS NULL THEN 'embedding' WHEN b.item_id IS NULL THEN 'entity_extraction' ELSE 'alias_resolution' END AS stage FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def status_sync(spark, d):
    """The stage that a stale job goes back to: the first whose result is missing."""
    k = lambda t, c, f: table(spark, d, t).select(F.col(c).alias("doc_id"), F.lit(True).alias(f))
    j = table(spark, d, "documents").select("doc_id").join(k("labels", "doc_id", "a"), "doc_id", "left").join(k("embeddings", "vec_id", "b"), "doc_id", "left").join(k("benchmark", "item_id", "c"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("a").isNull(), "chunking").when(F.col("b").isNull(), "embedding").when(F.col("c").isNull(), "entity_extraction").otherwise("alias_resolution").alias("stage"))


@query("r10_11_status_rollup", "SELECT p_partkey, CASE WHEN p_size < 10 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) THEN 'available' WHEN p_size >= 10 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) THEN 'missing' WHEN p_size < 10 THEN 'missing' ELSE 'available' END AS status FROM part")
def status_rollup(spark, d):
    """Missing acts with a document become available, available ones without become missing."""
    there = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("there", F.lit(True))
    return table(spark, d, "part").select("p_partkey").join(there, "p_partkey", "left").select("p_partkey", F.when(F.col("there"), "available").otherwise("missing").alias("status"))


@query("r10_12_citation_sync", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) THEN 'pending' ELSE l_returnflag END AS status FROM lineitem")
def citation_sync(spark, d):
    there = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("there"))
    j = table(spark, d, "lineitem").join(there, "l_partkey", "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.when((F.col("l_returnflag") == "N") & F.col("there"), "pending").otherwise(F.col("l_returnflag")).alias("status"))


@query("r11_01_embedding_join", "SELECT doc_id, len(embedding) AS dims FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE trim(text) <> ''")
def embedding_join(spark, d):
    """Texts with the vectors that a model gave; blank texts get none."""
    j = table(spark, d, "documents").where("trim(text) <> ''").join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("doc_id"), "left")
    return j.select("doc_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dims"))


@query("r11_02_json_entities", "SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_entities(spark, d):
    """A model's JSON answer parsed with a schema; what does not parse is null."""
    return table(spark, d, "events").select("event_id", "user_id", F.from_json("props", "k int")["k"].alias("k"))


@query("r11_03_event_classes", "SELECT event_id, CASE WHEN coalesce(value / 100, 1.0) < 0.7 OR event_type NOT IN ('view', 'click', 'purchase') THEN 'unclassified' ELSE event_type END AS class FROM events")
def event_classes(spark, d):
    """Unsure and unknown answers are unclassified; a missing confidence counts as sure."""
    unsure = (F.coalesce(F.col("value") / 100, F.lit(1.0)) < 0.7) | ~F.col("event_type").isin("view", "click", "purchase")
    return table(spark, d, "events").select("event_id", F.when(unsure, "unclassified").otherwise(F.col("event_type")).alias("class"))


@query("r11_05_two_tiers", "SELECT event_id, CASE WHEN value / 500 >= 0.85 THEN 'screen' ELSE 'escalated' END AS tier FROM events WHERE event_type = 'error'")
def two_tiers(spark, d):
    """A cheap score first; only what stays below 0.85 goes to the costly one."""
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", (F.col("value") / 500).alias("score"))
    return e.where("score >= 0.85").select("event_id", F.lit("screen").alias("tier")).unionByName(e.where("score < 0.85").select("event_id", F.lit("escalated").alias("tier")))


@query("r11_07_recall", "WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings) SELECT label, round(count(*) FILTER (place <= 10 AND vec_id % 2 = 0) / nullif(count(*) FILTER (vec_id % 2 = 0), 0), 6) AS recall FROM r GROUP BY 1")
def recall(spark, d):
    """Share of a question's relevant rows (stand-in: even ids) among its first ten."""
    w = Window.partitionBy("label").orderBy("vec_id")
    r = table(spark, d, "embeddings").select("label", "vec_id", F.row_number().over(w).alias("place"))
    good = F.col("vec_id") % 2 == 0
    return r.groupBy("label").agg(F.round(F.count_if((F.col("place") <= 10) & good) / F.nullif(F.count_if(good), F.lit(0)), 6).alias("recall"))
