"""Decisions that depend on earlier ones: batch and stream against plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from docsluice.streaming.folds import RateLimit, Sessions, fold, fold_stream
from docsluice.streaming.jobs import run_to_table

BEGIN = datetime(2024, 1, 1)
KIND = "k string, id long, ts timestamp, ends boolean"


def plain_limit(events, most, seconds):
    """Every admitted event is kept; the window is counted anew for each event."""
    out, admitted = {}, {}
    for k, i, t, _ in sorted((e for e in events if e[2]), key=lambda e: (str(e[0]), e[2], e[1])):
        mine = [a for a in admitted.setdefault(k, []) if a > t - timedelta(seconds=seconds)]
        ok = len(mine) < most
        out[i] = (len(mine), ok, 0.0 if ok else max(0.1, (mine[0] + timedelta(seconds=seconds) - t).total_seconds()) if mine else 1.0)
        if ok:
            admitted[k].append(t)
    return out


def plain_sessions(events, idle, life):
    """Sessions as lists of their accesses; the end of each is worked out from the list."""

    def end(s):
        e = s[0]
        for t in s:
            if t - s[0] < life:
                e = t
        return e + idle

    out, by_key = {}, {}
    for k, i, t, ends in sorted((e for e in events if e[2]), key=lambda e: (str(e[0]), e[2], e[1])):
        mine = by_key.setdefault(k, [])
        alive = mine and not mine[-1]["ended"] and t < end(mine[-1]["at"])
        if ends:
            if alive:
                mine[-1]["ended"] = True
            out[i] = (len(mine), "ended") if alive else (None, "none")
            continue
        if not alive:
            mine.append({"at": [], "ended": False})
        s = mine[-1]
        s["at"].append(t)
        late = [x for x in s["at"] if x - s["at"][0] >= life]
        out[i] = (len(mine), ("restored" if len(mine) > 1 else "created") if len(s["at"]) == 1 else "extended" if not late else "limit" if len(late) == 1 else "kept")
    return out


def some_events(seed, n=400):
    r = random.Random(seed)
    at, out = BEGIN, []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 0, 1, 10, 60, 600, 3600, 20000]))  # bursts, ties, pauses, ends of windows
        out.append((r.choice(["a", "a", "a", "b", None]), i, at, r.random() < 0.05))
    return out


def test_a_steady_caller_is_served_again(spark):
    hours = [("a", i, BEGIN + timedelta(hours=i), False) for i in range(15)]
    got = fold(spark.createDataFrame(hours, KIND), ["k"], "ts", "id", RateLimit(3, 6 * 3600))
    assert [r["id"] for r in got.where("allowed").orderBy("id").collect()] == [0, 1, 2, 6, 7, 8, 12, 13, 14]
    assert got.where("id = 4").first()["wait_seconds"] == 7200.0


@pytest.mark.parametrize(("most", "seconds"), [(1, 60), (3, 600), (5, 7200), (0, 60)])
def test_limit_is_that_of_a_plain_loop(spark, most, seconds):
    events = some_events(most + 1)
    df = spark.createDataFrame([*events, ("a", 999, None, False)], KIND).repartition(3)
    got = {r["id"]: (r["in_window"], r["allowed"], r["wait_seconds"]) for r in fold(df, ["k"], "ts", "id", RateLimit(most, seconds)).collect()}
    assert got.pop(999) == (None, None, None)
    assert got == plain_limit(events, most, seconds)
    assert fold(df.limit(0), ["k"], "ts", "id", RateLimit(most, seconds)).count() == 0


@pytest.mark.parametrize(("idle", "life"), [(600, 3600), (20000, 50000), (60, 30)])
def test_sessions_are_those_of_a_plain_loop(spark, idle, life):
    events = some_events(idle)
    rows = fold(spark.createDataFrame(events, KIND).repartition(3), ["k"], "ts", "id", Sessions(idle, life), ends="ends").collect()
    assert {r["id"]: (r["session"], r["outcome"]) for r in rows} == plain_sessions(events, timedelta(seconds=idle), timedelta(seconds=life))
    for r in rows:
        assert (r["restored_from"] is not None) == (r["outcome"] == "restored") and (r["messages"] or 0) <= 20


def test_a_restored_session_begins_with_the_last_messages(spark):
    events = [("a", i, BEGIN + timedelta(minutes=i), False) for i in range(30)] + [("a", 30, BEGIN + timedelta(days=2), False), ("a", 31, BEGIN + timedelta(days=2, minutes=1), True), ("a", 32, BEGIN + timedelta(days=2, minutes=2), False)]
    rows = fold(spark.createDataFrame(events, KIND), ["k"], "ts", "id", Sessions(3600, 86400), ends="ends").orderBy("id").collect()
    assert [(r["session"], r["outcome"], r["messages"], r["restored_from"]) for r in rows[29:]] == [(1, "extended", 20, None), (2, "restored", 6, 1), (2, "ended", 6, None), (3, "restored", 6, 2)]


@pytest.mark.parametrize("rule", [RateLimit(2, 1800), Sessions(1800, 7200)])
def test_stream_decides_as_batch_does_whatever_the_order_of_arrival(spark, tmp_path, rule):
    events = [e for e in some_events(7) if e[0]]
    r = random.Random(1)
    late = sorted(events, key=lambda e: e[2] + timedelta(seconds=r.random() * 1700))  # out of order, within the watermark
    for n in range(6):
        part = late[n * len(late) // 6 : (n + 1) * len(late) // 6]
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    more = {"ends": "ends"} if rule.EXTRA else {}
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run_to_table(fold_stream(stream, ["k"], "ts", "id", rule, late="30 minutes", **more), f"{tmp_path}/out").collect()
    want = {x["id"]: tuple(x) for x in fold(spark.createDataFrame(events, KIND), ["k"], "ts", "id", rule, **more).collect()}
    passed = {e[1] for e in events if e[2] <= max(e[2] for e in events) - timedelta(minutes=30)}
    assert {x["id"]: tuple(x) for x in got} == {i: want[i] for i in passed} and len(got) == len(passed)
