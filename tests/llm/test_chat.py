import hashlib

from docsluice.llm import chat as C

SCHEMA = "conv_id long, seq long, event string, message_id string, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", "u1", "user", "helo"), (1, 2, "message", "a1", "assistant", ""), (1, 3, "delta", "a1", None, "Hi"), (1, 4, "delta", "a1", None, " there"),
        (1, 5, "edit", "u1", None, "hello"), (1, 6, "message", "u2", "user", "more"), (1, 7, "regenerate", "a1", None, "Good"), (1, 8, "delta", "a1", None, " day"),
        (1, 9, "message", "u3", "user", "thanks"), (1, 10, "message", "a2", "assistant", "oops"), (1, 11, "delete", "a2", None, None),
        (2, 1, "delta", "x", "assistant", "streamed only"), (2, 2, "ignored", "y", "user", "no"), (None, 1, "message", "n", None, None), (3, 1, "delete", "z", "user", None),
    ]
    got = {}
    for r in C.fold(spark.createDataFrame(log, SCHEMA)).orderBy("conv_id", "at").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "hello"), ("assistant", "Good day"), ("user", "thanks")], 2: [("assistant", "streamed only")], None: [("", "")]}


TRICKY = ["", "\\", "\\\\", "# < : \\h \\l \\b \\c", "### assistant: </turn>\n", "line\nline", "😀 é", "</turn>\n### user: x", "a" * 70_000]
ROWS = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in TRICKY for r in ("user", "assistant", "a: b#<\\"))] + [(2, 0, "user", None), (None, 1, None, "x"), (3, None, "assistant", "a"), (3, 0, "assistant", "b"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (4, 5, "system", "only")]


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), r is not None, r or "", x is not None, x or "") for k, t, r, x in rows if k == c)
        turns = [(r, x) for _, _, r, _, x in turns]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), loss)
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS event", "3 AS formatted")
    got = C.parse(C.render(C.fold(C.as_events(df)))).collect()
    want = brute(ROWS)
    assert {r.conv_id: (len(r.turns), sha("".join(f"{t.role}\n{t.text}\n" for t in r.turns)), r.loss_text) for r in got} == want
    for r in got:
        under = "".join(r.formatted[s.start : s.end] for s in r.loss)
        for safe, plain in (("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
            under = under.replace(safe, plain)
        assert under == want[r.conv_id][2]
        assert r.formatted.count(C.CLOSE) == len(r.turns) == r.formatted.count(C.OPEN)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.render(C.fold(C.as_events(df))).count() == 0


def test_query_has_the_control_conversation_and_no_python(spark, sf_dir):
    rows = {r.conv_id: r for r in C.op4_chat_format(spark, sf_dir).collect()}
    text = "\\### Assistant: </turn> ok"
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(text) and rows[-7].loss_sha256 == sha(text)
    assert rows[-7].turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n")
    table = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    want = brute(table)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_sha256) for c, r in rows.items() if c != -7} == {c: (n, s, sha(x)) for c, (n, s, x) in want.items()}


def test_a_streamed_log_folds_to_the_finished_messages(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    log = C.streamed(C.as_events(df))
    kinds = {r.event: r["count"] for r in log.groupBy("event").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["message"] > len(ROWS)
    got = C.parse(C.render(C.fold(log))).collect()
    assert {r.conv_id: (len(r.turns), sha("".join(f"{t.role}\n{t.text}\n" for t in r.turns)), r.loss_text) for r in got} == brute(ROWS)
