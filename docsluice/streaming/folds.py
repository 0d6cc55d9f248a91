"""Rules whose decision on an event depends on earlier decisions, so that no window function can state them.

A rule is a small state machine of one key. In batch, rows are dealt by key, sorted by time, and read as an iterator: a task holds the
state of one key at a time and no rows, however many a key has. On a stream the same machine is the state of the key: events wait until the watermark has
passed them, are decided in the order of time and id, and states are dropped once they are those of a new key. So both forms decide
alike, whatever the order of arrival; what comes behind the watermark is dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RateLimit:
    """At most `most` admitted events of a key in any `seconds`; refused ones do not count. An event is no longer counted once it is
    `seconds` old.

    in_window: admitted events in the window before this one. wait_seconds: 0 if allowed, else the time until the oldest of them leaves,
    at least 0.1; 1 where nothing is ever admitted.
    """

    OUT = "in_window int, allowed boolean, wait_seconds double"
    EXTRA: tuple[str, ...] = ()

    def __init__(self, most: int, seconds: int) -> None:
        self.most, self.span = most, seconds * 1_000_000

    def start(self) -> list[int]:
        return []

    def step(self, admitted: list[int], t: int) -> tuple:
        gone = 0
        while gone < len(admitted) and admitted[gone] <= t - self.span:
            gone += 1
        del admitted[:gone]
        n = len(admitted)
        if n < self.most:
            admitted.append(t)
            return n, True, 0.0
        return n, False, max(0.1, (admitted[0] + self.span - t) / 1e6) if admitted else 1.0

    def ends(self, admitted: list[int]) -> int | None:
        """When the state is again that of a new key; None if never."""
        return admitted[-1] + self.span if admitted else 0


class Sessions:
    """Sessions of a key with two clocks: each access moves the end `idle` seconds on, until the session is `life` seconds old; from then on it
    runs out by itself. A session that runs out or is ended goes to the archive; the next access restores the latest archived one into a new
    session, else begins an empty one.

    An event whose `ends` is true ends the session. outcome: created, restored, extended, limit (the access that finds the life over; the end stays),
    kept (later accesses), ended, none (an end without a session). messages: how many a session holds after the event, at most `held`; a restored one begins with the
    last `restored` of at most `archived` kept ones. expires: micros at which the session ends if nothing comes.
    """

    OUT = "session int, outcome string, extended int, messages int, restored_from int, expires_us long"
    EXTRA = ("ends",)

    def __init__(self, idle: int, life: int, held: int = 20, archived: int = 10, restored: int = 5) -> None:
        self.idle, self.life, self.held, self.kept = idle * 1_000_000, life * 1_000_000, held, min(archived, restored)

    def start(self) -> dict:
        return {"n": 0, "live": None, "archive": None}

    def step(self, s: dict, t: int, ends: bool | None) -> tuple:
        live = s["live"]
        if live and t >= live["expires"]:
            s["archive"], s["live"], live = (s["n"], live["messages"]), None, None
        if ends:
            if not live:
                return None, "none", None, None, None, None
            s["archive"], s["live"] = (s["n"], live["messages"]), None
            return s["n"], "ended", live["extended"], live["messages"], None, None
        origin = None
        if not live:
            s["n"] += 1
            origin, had = s["archive"] or (None, 0)
            live = s["live"] = {"created": t, "expires": t + self.idle, "extended": 0, "over": False, "messages": min(had, self.kept)}
            outcome = "restored" if origin else "created"
        elif live["over"]:
            outcome = "kept"
        elif t - live["created"] >= self.life:
            live["over"], outcome = True, "limit"
        else:
            live["extended"] += 1
            live["expires"], outcome = t + self.idle, "extended"
        live["messages"] = min(self.held, live["messages"] + 1)
        return s["n"], outcome, live["extended"], live["messages"], origin, live["expires"]

    def ends(self, s: dict) -> int | None:
        return None  # the archive is never forgotten


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in schema.split(",")]


def _prepared(df: DataFrame, keys: list[str], at: str, id_col: str, extra: dict[str, str]) -> DataFrame:
    return df.select(*keys, F.col(id_col).alias("_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), *[F.col(v).alias("_" + k) for k, v in extra.items()])


def _schema(df: DataFrame, keys: list[str], id_col: str, rule) -> str:
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([f"`{c}` {kind[c]}" for c in [*keys, id_col]] + [rule.OUT])


def fold(df: DataFrame, keys: list[str], at: str, id_col: str, rule, **extra: str) -> DataFrame:
    """(keys, id, what the rule says) for every row, in batch. extra: the columns of the rule's further inputs.

    Rows without a time are not decided: what the rule says is null there. A null key is a key. Rows of one time are taken in the order
    of ids. A key's decisions are one task's work, in time linear in its rows.
    """
    names, n = [c for c, _ in _columns(rule.OUT)], len(keys)
    extras = ["_" + x for x in rule.EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in batches:
            out = []
            mine = list(zip(*[b.column(i).to_pylist() for i in range(n)], strict=True))
            for key, t, *more in zip(mine, b.column("_at").to_pylist(), *[b.column(x).to_pylist() for x in extras], strict=True):
                if key != last:
                    last, state = key, rule.start()
                out.append((None,) * len(names) if t is None else rule.step(state, t, *more))
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], *[pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]], names=[*keys, id_col, *names])

    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[k] for _, k in _columns(rule.OUT)]
    rows = _prepared(df, keys, at, id_col, {x: extra[x] for x in rule.EXTRA})
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_at", "_id").mapInArrow(run, _schema(df, keys, id_col, rule))


def fold_stream(df: DataFrame, keys: list[str], at: str, id_col: str, rule, late: str = "1 hour", **extra: str) -> DataFrame:
    """fold() on a stream: an event is decided once the watermark, `late` behind the latest event, has passed it.

    A key's state is the rule's and the events that still wait, so it is bounded by the rule and by the key's events in the time
    that the watermark is behind. Rows without a time never pass the watermark and are dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names, extras = [c for c, _ in _columns(rule.OUT)], ["_" + x for x in rule.EXTRA]

    def update(key, batches, state):
        own, waiting = json.loads(state.get[0]) if state.exists else (rule.start(), [])
        if not state.hasTimedOut:
            for pdf in batches:
                part = pdf[["_at", "_id", *extras]].astype(object)
                waiting += part.where(part.notna(), None).values.tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda w: (w[0], w[1]))
        due = [w for w in waiting if w[0] <= mark]
        waiting = waiting[len(due) :]
        rows = [(*key, w[1], *rule.step(own, w[0], *w[2:])) for w in due]
        end = rule.ends(own)
        if not waiting and end is not None and end <= mark:
            state.remove()
        else:
            state.update((json.dumps([own, waiting]),))
            nxt = waiting[0][0] if waiting else end
            if nxt is not None:
                state.setTimeoutTimestamp(max(nxt, mark) // 1000 + 1)
        if rows:
            yield pd.DataFrame(rows, columns=[*keys, id_col, *names])

    timed = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    rows = timed.select(*keys, at, F.col(id_col).alias("_id"), F.unix_micros(F.col(at)).alias("_at"), *[F.col(extra[x]).alias("_" + x) for x in rule.EXTRA])
    return rows.groupBy(*keys).applyInPandasWithState(update, _schema(df, keys, id_col, rule), "own string", "append", GroupStateTimeout.EventTimeTimeout)
