"""Chat formatting from event logs, with DataFrame functions only.

A log has events of messages: message (starts one), delta (appends streamed text), edit (replaces the text),
regenerate (replaces the text and takes back every message that was started after this one), delete. The
log is partitioned by conversation, sorted by sequence and folded into the final messages, which are
rendered with a reversible template and a loss mask over the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import read, save

#: A turn is OPEN role MIDDLE text CLOSE. Neither OPEN's first character nor CLOSE's can occur in escaped text.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Escapes, applied in this order and undone in the opposite one; the last is for roles only.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPE = (":", "\\c")


def escape(c: Column, role: bool = False) -> Column:
    for plain, safe in (*ESCAPES, ROLE_ESCAPE) if role else ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column, role: bool = False) -> Column:
    for plain, safe in reversed((*ESCAPES, ROLE_ESCAPE) if role else ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def as_events(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of finished turns as a log of message events, one message a row, in the order of turns.

    Equal turns are ordered by role and text, equal rows stay separate messages; null turns come first.
    """
    c = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    return c.select("conv_id", at.cast("long").alias("seq"), F.lit("message").alias("event"), at.cast("string").alias("message_id"), "role", "text")


def streamed(finished: DataFrame) -> DataFrame:
    """A log of finished messages (as_events) told as it may have come about; folding it gives the same messages.

    Every text arrives in three pieces: a message and two deltas. Every third message begins as a draft, a text and a delta,
    that an edit takes back before the pieces come. Every fourth is answered by a question that is
    taken back when the message is regenerated. Which is which goes by the message's place in its conversation.
    """
    text, at = F.coalesce("text", F.lit("")), F.col("seq")
    cut = F.ceil(F.length(text) / 3).cast("int")
    piece = [F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, cut), F.substr(text, 2 * cut + 1)]
    draft, again = at % 3 == 1, at % 4 == 2

    def event(k: int, kind: str, said: Column, name: Column = F.col("message_id"), role: Column = F.lit(None).cast("string")) -> Column:
        return F.struct((at * 10 + k).alias("seq"), F.lit(kind).alias("event"), name.alias("message_id"), role.alias("role"), said.alias("text"))

    other = F.concat(F.col("message_id"), F.lit("?"))
    steps = [
        (F.lit(True), event(0, "message", F.when(draft, F.lit("no, ")).when(again, F.lit("other words")).otherwise(piece[0]), role=F.col("role"))),
        (draft, event(1, "delta", F.lit("not this"))),
        (draft, event(2, "edit", F.when(again, F.lit("still not")).otherwise(piece[0]))),
        (again, event(3, "message", F.lit("say it otherwise"), other, F.lit("user"))),
        (again, event(4, "delta", F.lit(", please"), other)),
        (again, event(5, "regenerate", piece[0])),
        (F.lit(True), event(6, "delta", piece[1])),
        (F.lit(True), event(7, "delta", piece[2])),
    ]
    told = F.explode(F.filter(F.array(*[F.when(cond, e) for cond, e in steps]), lambda e: e.isNotNull()))
    return finished.select("conv_id", told.alias("e")).select("conv_id", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, at, role, text) of the messages that stand at the end of each log.

    events: conv_id, seq, event, message_id, role, text. Of events with equal seq, those that sort later by
    kind and text count as later. Other kinds of event are ignored; a null text is empty; deltas
    without a message start one. The role is that of the first event that gives one, else empty.
    """
    e = events.select("conv_id", "seq", F.lower("event").alias("event"), "message_id", "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.where(F.col("event").isin("message", "delta", "edit", "regenerate", "delete")).repartition("conv_id")
    order = F.struct("seq", "event", "text")
    base = F.col("event").isin("message", "edit", "regenerate")
    m = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("at"),
        F.max(F.when(base, order)).alias("base"),
        F.collect_list(F.when(F.col("event") == "delta", order)).alias("deltas"),
        F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).alias("again"),
        F.max(F.when(F.col("event") == "delete", F.col("seq"))).alias("gone"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"),
    )
    later = F.filter(F.sort_array("deltas"), lambda d: F.col("base").isNull() | (d > F.col("base")))
    text = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    m = m.select("conv_id", "message_id", "at", F.coalesce("named.role", F.lit("")).alias("role"), text.alias("text"), "again", (F.coalesce(F.col("gone") >= F.greatest("at", "base.seq"), F.lit(False))).alias("deleted"))
    before = Window.partitionBy("conv_id").orderBy("at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    retaken = F.coalesce(F.max("again").over(before) > F.col("at"), F.lit(False))
    return m.withColumn("retaken", retaken).where(~F.col("deleted") & ~F.col("retaken")).select("conv_id", "message_id", "at", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) with one row a conversation.

    loss: spans of code points of formatted that hold the assistant's escaped texts, each with the index and
    the start of its turn. A conversation is one row by nature: its turns meet in one task, other
    conversations do not wait for it.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(MIDDLE))
    body = escape(F.col("text"))
    m = messages.select("conv_id", "message_id", "at", "role", head.alias("head"), body.alias("body"))
    m = m.withColumn("size", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("at", "message_id")
    m = m.select("*", (F.row_number().over(order) - 1).alias("turn"), F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("turn_start"))
    start = F.col("turn_start") + F.length("head")
    span = F.struct("turn", "turn_start", start.alias("start"), (start + F.length("body")).alias("end"))
    piece = F.struct("turn", F.concat("head", "body", F.lit(CLOSE)).alias("piece"))
    grouped = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss"))
    return grouped.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def parse(formatted: DataFrame) -> DataFrame:
    """Rendered conversations read back: turns with role and text, and the text under the loss mask, unescaped."""
    pieces = F.split("formatted", CLOSE)
    df = formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, MIDDLE, 1)
        text = F.substr(piece, F.length(head) + F.lit(len(MIDDLE) + 1))
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1)), role=True).alias("role"), unescape(text).alias("text"))

    def under(s: Column) -> Column:
        return unescape(F.substr(F.get("pieces", s["turn"]), (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    return df.withColumns({"turns": F.transform("pieces", turn), "loss_text": F.array_join(F.transform("loss", under), "")}).drop("pieces")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a small one of control strings, as a log of streamed, edited and regenerated messages that is
    folded, written formatted and read back. See as_events for nulls and ties, fold for what a log may hold."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = parse(save(render(fold(streamed(as_events(rows.unionByName(tricky))))), "formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(t)
), e AS (SELECT *, text AS x, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 14 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
