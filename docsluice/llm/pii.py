"""Personal data: spans of fixed formats, and further candidates chosen by boosted trees. DataFrame functions only.

Generators of high recall propose overlapping spans (numbers in groups, tokens with digits, spelt-out
addresses); trees score each by its format and its context; a calibrated threshold of each kind selects.
The spans of the fixed formats always stay. All positions are code points, ends exclusive.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .base import read

# Fixed formats. Each pattern finds what its plain form finds, from left to right without overlap, in time
# linear in the text: possessive runs, and a start only where a run of its characters starts.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Generators of further candidates.
_TOKEN = "[A-Za-z0-9+/_-]"
MORE = {
    "handle": r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]++(?:\s?(?:\.|[(\[]\s?dot\s?[)\]])\s?[A-Za-z0-9-]++)++",
    "number": r"[0-9(](?<![0-9A-Za-z.+(-][0-9(])(?<=(?=[0-9(][0-9 ().-]{7}).)[0-9]*+(?![0-9A-Za-z])(?:[ ().-]{1,4}+[0-9]++(?![A-Za-z]))*+",
    "secret": rf"{_TOKEN}(?<!{_TOKEN}{_TOKEN})(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{9,}}+",
}
#: Characters of a number at least; shorter matches of its generator are no candidates.
NUMBER = 8
#: What a text must have for a generator to find anything: a cheap test that loses nothing.
NEEDS = {"email": "@", "phone": "+"}
CONTEXT = 24
#: Characters of a text that are cut off at once where spans are replaced.
CHUNK = 4096
#: Length from which on the features tell spans apart no more.
LONGEST = 256
_SPAN = "struct<start:bigint,end:bigint,text:string,before:string,after:string>"

SECRET_CUES = r"(?i)(passw|pwd|secret|token|api.?key|access.?key|bearer|private.?key|credential)"
PHONE_CUES = r"(?i)(phone|tel\b|tel[.:]|mobile|cell|call|fax|ssn|social|passport|account|iban|whatsapp)"
PLAIN_CUES = r"(?i)(isbn|version|page|order|item|part|model|commit|vol|no\.|figure|table|total|price|year|build|file|id )"


#: Entries of a list that are summed up one by one. The state of a fold is copied at every step, so no fold here has a list for its
#: state that grows with the matches: n entries cost about n * PART + (n / PART) ** 2 steps.
PART = 128


def _bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once: a one-element array binds a value inside an expression."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The values of a list so far, put together by an associative op: running sums or maxima, each with its own value."""
    total = lambda xs: F.aggregate(xs, zero, op)

    def inside(part: Column, before: Column) -> Column:
        return F.transform(part, lambda _, i: op(before, total(F.slice(part, F.lit(1), i + 1))))

    def over(parts: Column) -> Column:
        sums = F.transform(parts, total)
        return _bound(sums, lambda t: F.flatten(F.transform(parts, lambda part, k: _bound(total(F.slice(t, F.lit(1), k)), lambda before: inside(part, before)))))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda k: F.slice(v, k * PART + 1, F.lit(PART)))

    return _bound(values, lambda v: F.when(F.size(v) == 0, v).otherwise(_bound(cut(v), over)))


def _greatest(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def located(text: Column, matches: Column, pattern: str) -> Column:
    """Spans of the matches, from the lengths of the pieces between them; with context on both sides."""

    def spans(pieces: Column) -> Column:
        sizes = F.transform(matches, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("bigint"))

        def span(m: Column, i: Column, end: Column) -> Column:
            start = (end - F.length(m)).alias("start")
            return F.struct(start, end.alias("end"), m.alias("text"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("after"))

        ends = running(sizes, lambda x, y: x + y, F.lit(0).cast("bigint"))
        return _bound(ends, lambda e: F.transform(matches, lambda m, i: span(m, i, F.get(e, i))))

    return F.when(F.size(matches) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(_bound(F.split(text, pattern, -1), spans))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(chars, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    t = span["text"]
    if kind == "ip":
        return F.forall(F.transform(F.split(t, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(_digits(t)).between(13, 19) & luhn(_digits(t))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    return F.lit(True)


def features(c: Column) -> list[Column]:
    """Format and context of a candidate; also the order of the model's columns."""
    t, n = c["text"], F.length(c["text"])
    # of a longer span the trees know no more than that it is long; the span itself is whole
    clipped = F.least(n, F.lit(LONGEST))
    share = lambda pattern: (n - F.length(F.regexp_replace(t, pattern, ""))) / n
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return [
        clipped.cast("double"), share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^0-9A-Za-z]"), flag(t.rlike("^[0-9a-f]+$")), flag(t.rlike("^[A-Z]{4}[0-9A-Z]+$")),
        F.size(F.array_distinct(F.split(F.lower(t), ""))) / clipped, flag(c["before"].rlike(r"[=:]\s?[\"']?$")), flag(c["before"].rlike(SECRET_CUES)), flag(c["before"].rlike(PHONE_CUES)), flag(c["before"].rlike(PLAIN_CUES)),
        flag(t.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")), flag(t.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), F.length(_digits(t)).cast("double"), flag(t.rlike("[A-Za-z]{4,}")), flag(c["after"].rlike("^[./@=]")),
    ]


def _samples(seed: int = 7, n: int = 1500) -> list[tuple[str, str, int]]:
    """(kind, text, label): made-up lines, each with one candidate of its kind, for the fit."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    filler = lambda: " ".join(chars("aeinorstlhdu", int(rng.integers(2, 9))) for _ in range(int(rng.integers(1, 5))))
    d, lower, upper = string.digits, string.ascii_lowercase, string.ascii_uppercase
    word = lambda: chars("aeinorstlhdu", int(rng.integers(4, 9)))
    number = lambda: f"{chars(d[2:], 1)}{chars(d, 2)}{pick('-. ')}{chars(d, 3)}{pick('-. ')}{chars(d, 4)}"
    year = lambda: f"{pick(['19', '20'])}{chars(d, 2)}"
    make = {
        ("secret", 1): [
            lambda: f"{pick(['AKIA', 'ASIA', 'GHPX'])}{chars(upper + d, 11)}{chars(d, 2)}{chars(upper + d, 3)}",
            lambda: f"{pick(['password', 'passwd', 'pwd', 'token', 'api_key', 'secret', 'access key'])}{pick(['=', ': ', ' = '])}{pick(['', chr(34)])}{chars('0123456789abcdef', int(rng.integers(12, 65)))}0a1{chr(34)}",
            lambda: f"{pick(['token', 'secret', 'Bearer', 'credential'])}{pick(['=', ': ', ' '])}{chars(lower + upper + d, int(rng.integers(16, 44)))}7qX2",
            lambda: f"{pick(['key', 'auth', 'x'])} = {chr(34)}{chars('0123456789abcdef', 36)}1a2b{chr(34)}",
        ],
        ("secret", 0): [
            lambda: f"{word()}-{word()}-{word()}{chars(d, 2)}", lambda: f"{word()}_{year()}_{word()}_v{chars(d, 1)}", lambda: f"{pick(['model', 'part', 'item'])} {chars(upper, 2)}{chars(d, 4)}-{word()}",
            lambda: f"{year()}-{chars('01', 1)}{chars('12', 1)}-{chars('012', 1)}{chars('123', 1)}T{chars('01', 1)}{chars(d, 1)}", lambda: f"version {word()}-{chars(d, 5)}", lambda: f"{word()}{word()}{chars(d, 2)}", lambda: f"order {chars(d, 12)}", lambda: f"{word()}/{word()}/{chars(d, 3)}/{word()}", lambda: f"{chars(d, int(rng.integers(10, 18)))}", lambda: f"commit {chars('0123456789abcdef', 14)}1a",
        ],
        ("number", 1): [lambda: f"{pick(['phone', 'tel:', 'call', 'mobile', 'fax', 'cell'])} {number()}", lambda: f"{pick(['', 'fax', 'tel.'])} ({chars(d[2:], 1)}{chars(d, 2)}) {chars(d, 3)}{pick('- ')}{chars(d, 4)}", lambda: f"{pick(['SSN', 'social security', 'passport', ''])} {chars(d, 3)}-{chars(d, 2)}-{chars(d, 4)}", lambda: f"{pick(['account', 'phone', 'whatsapp'])} {chars(d, int(rng.integers(9, 13)))}", lambda: f"{pick(['account', 'IBAN', 'passport', 'account no'])} {' '.join(chars(d, 4) for _ in range(int(rng.integers(3, 40))))}"],
        ("number", 0): [lambda: f"{pick(['', 'table', 'total', 'page'])} {' '.join(chars(d, int(rng.integers(1, 4))) for _ in range(int(rng.integers(5, 60))))}", lambda: f"{year()}-{year()} {chars(d, 2)}", lambda: f"{chars(d, 2)} {chars(d, 2)} {chars(d, 2)} {chars(d, 2)}", lambda: f"{pick(['ISBN', 'order', 'item', 'page', 'total', ''])} {chars(d, int(rng.integers(8, 17)))}", lambda: f"{chars(d, 4)}.{chars(d, 4)}.{chars(d, 2)}", lambda: f"{year()}-{chars('01', 1)}{chars('12', 1)}-{chars('012', 1)}{chars('123', 1)}", lambda: f"{chars(d, 3)} {chars(d, 3)} {chars(d, 3)}.{chars(d, 2)}"],
        ("handle", 1): [lambda: (lambda a, b: f"{word()}{pick(['', '', '.', '_', '-'])}{pick(['', word()])}{a}{pick(['(at)', '[at]', '( at )'])}{a}{pick([word(), chars(lower, int(rng.integers(2, 5)))])}{b}{pick(['(dot)', '[dot]', '.'])}{b}{pick(['com', 'org', 'net', 'de'])}")(pick([" ", ""]), pick([" ", ""]))],
        ("handle", 0): [lambda: f"{word()}{pick(['', word()])}{pick([' ', ''])}(at){pick([' ', ''])}{chars(d, 1)}.{chars(d, 2)}", lambda: f"{chars(d, 1)} [at] {chars(d, 2)}.{chars(d, 1)}"],
    }
    keys = list(make)
    return [(kind, f"{filler()} {pick(make[kind, label])()} {filler()}", label) for kind, label in (pick(keys) for _ in range(n))]


def candidates(text: Column, kind: str) -> tuple[Column, str]:
    """The generator's raw matches in a text, and its pattern."""
    pattern = (BASE | MORE)[kind]
    need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(r"(?i)[(\[]\s?at") if kind == "handle" else text.rlike("[0-9]")
    return F.when(need, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")), pattern


def long_enough(kind: str, s: Column) -> Column:
    return s["end"] - s["start"] >= NUMBER if kind == "number" else F.lit(True)


@cache
def _models(spark: SparkSession) -> dict[str, tuple[boosting.Boosted, float]]:
    """Trees and threshold of each kind, fitted on made-up lines whose features Spark computes."""
    rows = spark.createDataFrame(_samples(), "kind string, text string, label int")
    out = {}
    for kind in MORE:
        matches, pattern = candidates(F.col("text"), kind)
        found = rows.where(F.col("kind") == kind).withColumn("m", matches).withColumn("c", F.get(located(F.col("text"), F.col("m"), pattern), F.lit(0))).where("c is not null")
        got = found.where(long_enough(kind, F.col("c"))).select("label", F.array(*features(F.col("c"))).alias("x")).collect()
        x, y = np.array([r["x"] for r in got]), np.array([r["label"] for r in got])
        model = boosting.boost(x, y)
        held = np.arange(len(x)) % 3 == 2
        out[kind] = (model, max(0.5, boosting.threshold(model.probability(x[held]), y[held], PRECISION)))
    return out


#: Precision on held-out lines from which on a kind's candidates are selected.
PRECISION = 0.98
_OUT = "struct<kind:string,start:bigint,end:bigint,score:double>"


def _by_start(spans: Column) -> Column:
    """Marked spans by start; of equal starts those of the fixed formats first."""
    return F.array_sort(spans, lambda a, b: F.when(a["s"]["start"] < b["s"]["start"], -1).when(a["s"]["start"] > b["s"]["start"], 1).when(a["fixed"] == b["fixed"], 0).when(a["fixed"], -1).otherwise(1))


def _clear(base: Column, chosen: Column) -> Column:
    """The chosen spans that touch no base span, by start: before one no base span reaches into it, behind its start none begins in it."""
    far, none = F.lit(1 << 62).cast("bigint"), F.lit(0).cast("bigint")
    mark = lambda spans, fixed: F.transform(spans, lambda s: F.struct(F.lit(fixed).alias("fixed"), s.alias("s")))

    def free(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda x: F.when(x["fixed"], x["s"]["end"]).otherwise(none)), _greatest, none)
        following = F.reverse(running(F.reverse(F.transform(xs, lambda x: F.when(x["fixed"], x["s"]["start"]).otherwise(far))), _least, far))
        ok = lambda x, i, r, n: ~x["fixed"] & (F.get(r, i) <= x["s"]["start"]) & (F.get(n, i) >= x["s"]["end"])
        return _bound(reach, lambda r: _bound(following, lambda n: F.transform(F.filter(xs, lambda x, i: ok(x, i, r, n)), lambda x: x["s"])))

    return _bound(_by_start(F.concat(mark(base, True), mark(chosen, False))), free)


def _sweep(spans: Column) -> Column:
    """Of overlapping spans, in order of their starts, the one of the higher score; the earlier of equals. Spans are by start.

    Spans that start behind all ends before them begin a new group, so only the spans of one group are folded one after the other."""
    first = F.struct(F.lit(None).cast(_OUT).alias("last"), F.array().cast(f"array<{_OUT}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        apart = acc["last"].isNull() | (x["start"] >= acc["last"]["end"])
        out = F.when(apart & acc["last"].isNotNull(), F.array_append(acc["out"], acc["last"])).otherwise(acc["out"])
        return F.struct(F.when(apart | (x["score"] > acc["last"]["score"]), x).otherwise(acc["last"]).alias("last"), out.alias("out"))

    def best(group: Column) -> Column:
        return F.when(F.size(group) == 1, group).otherwise(F.aggregate(group, first, step, lambda acc: F.array_append(acc["out"], acc["last"])))

    def groups(xs: Column, ends: Column) -> Column:
        heads = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
        return _bound(heads, lambda h: F.transform(h, lambda at, k: best(F.slice(xs, at + 1, F.coalesce(F.get(h, k + 1), F.size(xs)) - at))))

    ends = lambda xs: running(F.transform(xs, lambda x: x["end"]), _greatest, F.lit(0).cast("bigint"))
    return _bound(spans, lambda xs: F.when(F.size(xs) == 0, xs).otherwise(_bound(ends(xs), lambda e: F.flatten(groups(xs, e)))))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, text, base (spans of the fixed formats) and added (further spans); no shuffle.

    A span is (kind, start, end, score). Base spans are ordered by kind, then start; a match that fails its
    check is dropped. Added spans overlap neither base spans nor each other. Null texts are empty.
    """
    models = _models(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.select(F.col(id_col).alias("id"), text.alias("text"))
    patterns = {}
    for kind in (*BASE, *MORE):
        matches, patterns[kind] = candidates(F.col("text"), kind)
        out = out.withColumn(f"m_{kind}", matches)
    out = out.withColumns({f"s_{k}": located(F.col("text"), F.col(f"m_{k}"), p) for k, p in patterns.items()})
    span = lambda k, s, score: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    def checked(k: str) -> Column:
        return F.transform(F.filter(f"s_{k}", lambda s: valid(k, s)), lambda s: span(k, s, F.lit(1.0)))

    def selected(k: str) -> Column:
        model, least = models[k]
        scored = F.transform(F.col(f"s_{k}"), lambda s: span(k, s, model.column(features(s))))
        return F.filter(scored, lambda s: (s["score"] >= F.lit(least)) & long_enough(k, s))

    base, chosen = [checked(k) for k in BASE], [selected(k) for k in MORE]
    out = out.select("id", "text", F.concat(*base).alias("base"), F.concat(*chosen).alias("chosen"))
    added = F.array_sort(_sweep(_clear(F.col("base"), F.col("chosen"))), lambda a, b: F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).when(a["start"] < b["start"], -1).otherwise(1))
    added = F.when(F.size("chosen") == 0, F.array().cast(f"array<{_OUT}>")).otherwise(added)
    return out.select(F.col("id").alias(id_col), F.col("text"), "base", added.alias("added"))


def redact(found: DataFrame) -> DataFrame:
    """The result of personal_data with a column redacted: every span replaced by its kind in brackets.

    Of overlapping spans the one that starts first is named; what the others have beyond it is cut too.
    """
    spans = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).otherwise(1))
    size = F.length("text")

    def cut(chunks: Column, a: Column, z: Column) -> Column:
        """Characters a to z, from the chunks that hold them."""
        first, last = F.floor(a / CHUNK).cast("int"), F.floor((z - 1) / CHUNK).cast("int")
        return F.when(z <= a, "").otherwise(F.substr(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), (a - first * CHUNK + 1).cast("int"), (z - a).cast("int")))

    def replaced(xs: Column, ends: Column, chunks: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1))
        label = lambda s, i: F.when(s["start"] >= before(i), F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        parts = F.transform(xs, lambda s, i: F.concat(cut(chunks, before(i), F.greatest(s["start"], before(i))), label(s, i)))
        return F.concat(F.array_join(parts, ""), cut(chunks, F.get(ends, F.size(ends) - 1), size.cast("bigint")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor(size / CHUNK).cast("int")), lambda k: F.substr("text", k * CHUNK + 1, F.lit(CHUNK)))
    ends = lambda xs: running(F.transform(xs, lambda x: x["end"]), _greatest, F.lit(0).cast("bigint"))
    whole = _bound(spans, lambda xs: _bound(ends(xs), lambda e: _bound(chunks, lambda c: replaced(xs, e, c))))
    return found.withColumn("redacted", F.when(F.size("base") + F.size("added") == 0, F.col("text")).otherwise(whole))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, with counts of the fixed formats, of added spans and of all; see personal_data."""
    found = personal_data(read(spark, sf_dir, "documents"))

    def count(k: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    counts = [*[count(k) for k in BASE], F.size("added").cast("long").alias("n_added"), F.size(F.concat("base", "added")).cast("long").alias("n_spans")]
    found = found.select("doc_id", *counts, joined(F.col("base")).alias("b"), joined(F.concat("base", "added")).alias("spans"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.col("b").cast("binary"), 256).alias("base_sha256"), "spans", "n_added", "n_spans")
