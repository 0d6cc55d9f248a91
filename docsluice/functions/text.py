"""Text functions as columns: cleaning, dates, amounts, citations, safety rules. No Python runs for any of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .arrays import bound, chunks, running, stretch

L = "[\\p{L}\\p{N}_]"


def _each(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


# ---- cleaning

#: What a scan leaves behind, and what stands for it, in order.
OCR_STEPS = [
    (V.PDF_ARTIFACTS, ""), (V.BOX_DRAWING, " "), (V.ORPHAN_DIACRITICS, ""), (V.MIXED_SCRIPT_NOISE, " "), (V.REPEATED_CHARS, "$1$1"),
    (V.ASTERISK_NOISE, " "), (V.REPEATED_PUNCTUATION, " "), (V.PUNCTUATION_GIBBERISH, " "),
]
LAST_STEPS = [(V.EXCESSIVE_WHITESPACE, " "), (V.EXCESSIVE_NEWLINES, "\n\n"), (r"^\s+|\s+$", "")]


def clean_ocr(c: Column, aggressive: bool = False) -> Column:
    return _each(c, [*OCR_STEPS, *([(V.SPECIAL_CHAR_GARBAGE, " ")] if aggressive else []), *LAST_STEPS])


def clean_for_display(c: Column) -> Column:
    """The aggressive form without control characters and without spaces other than the plain one."""
    return _each(clean_ocr(c, True), [(r"[\p{C}&&[^\n\t]]", ""), (r"[\p{Z}&&[^ ]]", "")])


def is_noise(c: Column, most_special: float = 0.1) -> Column:
    special = F.length(F.regexp_replace(c, r"[\p{L}\p{N}_\s.,;:!?'\"()-]", ""))
    return c.rlike(r"(?s)(.)\1{5,}|\*{2,}|[\x{2500}-\x{257F}]") | ((F.length(c) > 0) & (special / F.length(c) > most_special))


def correct_digits(c: Column) -> Column:
    """The ordered rules, twice: what a first pass mends (1O) lets a second one see more (1O,OOO is 10,000)."""
    return _each(c, [*V.OCR_DIGITS, *V.OCR_DIGITS])


def is_critical(c: Column) -> Column:
    """Dates, amounts and section references must be read without errors."""
    return c.rlike(r"(?i)\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b|\brs\.? ?[0-9]|₹ ?[0-9]|\bsections? [0-9]")


# ---- dates and amounts

NUMERIC_DATE = V.DATE_NUMERIC


def calendar_date(year: Column, month: Column, day: Column, lenient: bool = False) -> Column:
    """ISO text of a real day of 1900 to 2100, else null; lenient takes any day up to 31 in any month."""
    iso = F.format_string("%04d-%02d-%02d", year, month, day)
    ok = year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31)
    return F.when(ok, iso if lenient else F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))


def dates(c: Column, lenient: bool = False) -> Column:
    """Distinct dates of a text by family: numeric (day first), "dated" ones, written ones, ISO; in each in the order of the
    text. A day that the calendar lacks is no date unless lenient."""
    month_of = F.create_map(*[F.lit(x) for kv in V.MONTHS.items() for x in kv])

    def family(pattern: str, year: int, month: int, day: int) -> Column:
        part = lambda m, k: F.regexp_extract(m, pattern, k)

        def one(m: Column) -> Column:
            named = F.try_element_at(month_of, F.lower(part(m, month)))
            number = F.coalesce(named, F.when(part(m, month).rlike("^[0-9]+$"), part(m, month))).cast("int")
            return calendar_date(part(m, year).cast("int"), number, part(m, day).cast("int"), lenient)

        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), one)

    found = F.concat(family(V.DATE_NUMERIC, 3, 2, 1), family(V.DATE_LEGAL, 3, 2, 1), family(V.DATE_WRITTEN, 3, 2, 1), family(V.DATE_ISO, 1, 2, 3))
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))


def parse_date(c: Column) -> Column:
    """A date in one of the formats, the first that fits; no free-form guess."""
    t = F.trim(c)
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyy/MM/dd"]
    return F.coalesce(*[F.try_to_date(t, f) for f in formats])


AMOUNT = r"(?i)(rs\.? ?|₹ ?|\$ ?|usd ?)?([0-9][0-9,]*(?:\.[0-9]+)?) ?(crores?|cr|lakhs?|lacs?|rupees|%|percent)?(?![A-Za-z0-9])"


def amount_value(m: Column) -> Column:
    """`UNIT:number` of one match of AMOUNT, or null for a bare number; crores and lakhs are multiplied out."""
    unit, front = F.lower(F.regexp_extract(m, AMOUNT, 3)), F.lower(F.trim(F.regexp_extract(m, AMOUNT, 1)))
    n = F.replace(F.regexp_extract(m, AMOUNT, 2), F.lit(","), F.lit("")).cast("decimal(24,4)")
    times = F.when(unit.startswith("cr"), 10_000_000).when(unit.startswith("la"), 100_000).otherwise(1).cast("decimal(10,0)")
    text = F.regexp_replace((n * times).cast("decimal(34,4)").cast("string"), r"\.?0+$", "")
    text = F.when((n * times) == F.floor(n * times), F.floor(n * times).cast("string")).otherwise(text)
    kind = F.when(unit.isin("%", "percent"), "PERCENT").when(front.isin("$", "usd"), "USD").when((front != "") | (unit != ""), "INR")
    return F.when(kind.isNotNull(), F.concat_ws(":", kind, text))


def amounts(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)), amount_value), lambda x: x.isNotNull())


# ---- normal forms

def normalise(c: Column) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed."""
    return F.trim(_each(F.lower(c), [(r"[^\p{L}\p{N}_\s]", " "), (r"\s+", " ")]))


def normalise_query(c: Column) -> Column:
    """Lower case, spaces collapsed, symbols dropped but for the question's marks."""
    return _each(F.trim(_each(F.lower(c), [(r"\s+", " ")])), [(r"[^\p{L}\p{N}_\s?.,'-]", "")])


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def act_key(c: Column) -> Column:
    """snake_case key of an act's name with its year."""
    return _each(normalise(F.regexp_replace(c, r"(?i)^the ", "")), [(r"\s+", "_")])


def year_of(c: Column) -> Column:
    """The first year of 1800 to 2099."""
    y = F.regexp_extract(c, r"(?<![0-9])((?:18|19|20)[0-9]{2})(?![0-9])", 1)
    return F.when(y != "", y.cast("int"))


def citations(c: Column) -> Column:
    """array<struct<section, subsection, clause, act, year, raw, confidence>> of the references in a text, by pattern: section of
    an act, short form, u/s, range, read with; each in the order of the text. A range and a pair that is read together
    give two citations; those of a pair have no act."""

    def of(pattern: str, sections: tuple[int, ...], act: int | None, year: int | None = None) -> Column:
        part = lambda m, k: F.regexp_extract(m, pattern, k)
        null = F.lit(None).cast("string")

        def one(m: Column, k: int) -> Column:
            number = part(m, k)
            inner = lambda p: F.nullif(F.regexp_extract(number, p, 1), F.lit(""))
            return F.struct(
                F.regexp_extract(number, r"(?i)^(\d+[A-Z]{0,2})", 1).alias("section"), inner(r"\(\s*(\d+)\s*\)").alias("subsection"), inner(r"(?i)\(\s*([a-z])\s*\)").alias("clause"),
                (F.regexp_replace(F.trim(F.regexp_replace(part(m, act), r"\s+", " ")), "[ .,]+$", "") if act else null).alias("act"), (F.nullif(part(m, year), F.lit("")) if year else null).alias("year"), F.trim(m).alias("raw"), F.lit(V.CITATION_CONFIDENCE).alias("confidence"),
            )

        return F.flatten(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: F.array(*[one(m, k) for k in sections])))

    return F.concat(of(V.CITE_SECTION, (1,), 2, 3), of(V.CITE_SHORT, (1,), 2), of(V.CITE_UNDER, (1,), 2), of(V.CITE_RANGE, (1, 2), 3), of(V.CITE_READ_WITH, (1, 2), None))


def section_starts(c: Column) -> Column:
    """Distinct section numbers of a text's headers, by pattern; where it has no header, of its references. Spaces are dropped."""
    found = lambda p: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", ""))
    headers = F.array_distinct(F.concat(*[found(p) for p in V.SECTION_HEADERS]))
    return F.when(F.size(headers) > 0, headers).otherwise(F.array_distinct(found(V.SECTION_REFERENCE)))


def has_contents_keyword(c: Column) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*map(F.lit, V.TOC_KEYWORDS)), lambda k: F.contains(low, k))


def act_validity(act: Column, known: list[str]) -> Column:
    """generic, garbage, known or unknown, the first that holds."""
    key = act_key(act)
    return F.when(key.isin("act", "code", "rules", "said_act", "the_act"), "generic").when((F.length(key) < 5) | ~key.rlike("[a-z]{3}"), "garbage").when(key.isin(*known), "known").otherwise("unknown")


# ---- safety

INJECTION = [f"(?i){p}" for p in V.INJECTION]


def injection_hits(c: Column) -> Column:
    """How many of the patterns occur in a text, wherever in it."""
    whole = F.coalesce(c, F.lit(""))
    return sum((F.when(whole.rlike(p), 1).otherwise(0) for p in INJECTION), F.lit(0))


def injection_risk(hits: Column) -> list[Column]:
    risk = F.when(hits >= 3, "high").when(hits == 2, "medium").when(hits == 1, "low").otherwise("none")
    sure = F.when(hits >= 3, 0.9).when(hits >= 1, 0.6).otherwise(0.8)
    return [risk.alias("risk"), sure.alias("confidence")]


def injection_spans(c: Column) -> Column:
    """array<struct<start, end, pattern, context>> of all patterns' matches, leftmost first, in code points, with up to 30
    characters of context on each side."""
    spans = match_spans(c, "(?im)" + "|".join(f"(?:{p})" for p in V.INJECTION))
    n = V.INJECTION_CONTEXT

    def shown(parts: Column, size: Column) -> Column:
        context = lambda s: stretch(parts, F.greatest(F.lit(0), s["start"] - n), F.least(size, s["end"] + n))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), stretch(parts, s["start"], s["end"]).alias("pattern"), context(s).alias("context")))

    return bound(chunks(c), lambda p: bound(F.length(c).cast("bigint"), lambda size: shown(p, size)))


def guard(c: Column) -> Column:
    """What a question asks for that must not be answered: the kind of the first pattern that fits, else null."""
    return F.coalesce(*[F.when(c.rlike(f"(?i){p}"), F.lit(kind)) for kind, p in V.GUARDS])


#: Quotations and named sources, which are left as they are. Of regions that overlap the one that starts first counts.
PROTECTED = "|".join(f"(?:{p})" for p in (V.DOUBLE_QUOTE, V.SINGLE_QUOTE, V.CITED_SOURCE, V.BLOCK_QUOTE))


def outside(c: Column, protected: str, change: Callable[[Column], Column]) -> Column:
    """A text with a change made everywhere but inside matches of `protected`."""
    kept = F.regexp_extract_all(c, F.lit(protected), F.lit(0))
    return F.array_join(F.zip_with(F.transform(F.split(c, protected, -1), change), kept, lambda x, k: F.concat(x, F.coalesce(k, F.lit("")))), "")


def police(c: Column) -> Column:
    """Phrases that state more than is known are replaced, outside quotations and named sources."""
    return outside(c, PROTECTED, lambda x: _each(x, [(f"(?i){p}", to) for p, to in V.POLICING]))


def intents(c: Column) -> Column:
    """map<engine, confidence> of the engines with a pattern that fits, each with the highest of its confidences."""
    best = [F.struct(F.lit(e).alias("key"), F.greatest(F.lit(0.0), *[F.when(c.rlike(f"(?i){p}"), w).otherwise(0.0) for p, w in ps]).alias("value")) for e, ps in V.INTENTS.items()]
    return F.map_from_entries(F.filter(F.array(*best), lambda x: x["value"] > 0))


def contradiction_of(evidence: Column) -> Column:
    """The kind of contradiction that a kind of evidence means; null where a model must decide."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in V.CONTRADICTIONS.items() for x in kv]), F.lower(evidence))


def escape_boundaries(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markdown_table(rows: Column, width: int) -> Column:
    """Rows of cells as a table: the first is the header, rows are cut or padded, bars escaped."""
    def line(r: Column) -> Column:
        cells = F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width)
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))

    rule = F.lit("|" + " --- |" * width)
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def severity(kind: Column, confidence: Column) -> Column:
    """Below 0.6 low; dates, amounts and facts from 0.8 high; else medium. A missing confidence counts as 0.7."""
    sure = F.coalesce(confidence, F.lit(0.7))
    return F.when(sure < 0.6, "low").when(kind.isin("date_mismatch", "amount_mismatch", "factual_contradiction") & (sure >= 0.8), "high").otherwise("medium")


# ---- acts and mentions

def clean_act(c: Column) -> Column:
    """An act's name without what running text puts behind it: cut after Act, Code or Rules and a year that follows."""
    cut = F.regexp_extract(c, r"(?i)^(.*?\b(?:act|code|rules)\b(?:,? (?:of )?[0-9]{4})?)", 1)
    return F.regexp_replace(F.trim(F.when(cut != "", cut).otherwise(c)), r"[\s.,;:]+$", "")


def canonical_act(c: Column, known: dict[str, str]) -> Column:
    """The known act of a name: by its key, by its key without a year, each also without a leading article."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    bare = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k.rstrip("0123456789").rstrip("_"), v)])
    key = F.regexp_replace(act_key(c), "_of_([0-9]{4})$", "_$1")
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(bare, F.regexp_replace(key, "_[0-9]{4}$", "")))


def mentions(c: Column) -> Column:
    """array<struct<mention, kind, confidence>>: persons with a title, organisations, institutions, other proper nouns of
    two to four words. A mention counts once, whatever its case, under the first family that finds it."""

    def of(pattern: str, group: int, kind: str, sure: float, longer: int = 0, needs: str | None = None) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
        found = F.when(c.rlike(needs), found).otherwise(F.array().cast("array<string>")) if needs else found  # a cheap test that loses nothing
        said = F.transform(found, lambda m: F.struct(F.regexp_replace(m, r"^\s+|\s+$", "").alias("mention"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence")))
        return F.filter(said, lambda m: F.length(m["mention"]) > longer)

    # the titles' case does not matter, that of the names does
    titles, courts = "(?i:" + "|".join(V.TITLES) + ")", "(?i)(?:" + "|".join(V.INSTITUTIONS) + ")"
    every = F.concat(
        of(rf"({titles}\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,3}})", 1, "person", 0.9, needs=titles),
        *[of(rf"([A-Z][A-Za-z\s&]+\s*{x})", 1, "org", 0.85, 3, needs=x) for x in V.ORG_INDICATORS],
        of(rf"{courts}[^,\.]*", 0, "institution", 0.85, 5),
        F.filter(of(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b", 1, "person", 0.6, 5), lambda m: ~F.lower(m["mention"]).isin(*V.COMMON_PHRASES)),
    )

    def once(ms: Column) -> Column:
        keys = F.transform(ms, lambda m: F.lower(m["mention"]))
        return F.get(F.transform(F.array(keys), lambda k: F.filter(ms, lambda m, i: F.array_position(k, F.lower(m["mention"])) == i + 1)), F.lit(0))

    return F.get(F.transform(F.array(every), once), F.lit(0))  # one-element arrays bind a value once


def match_spans(c: Column, pattern: str) -> Column:
    """array<struct<start, end>> of a pattern's matches in code points, from running sums of the lengths of the matches and of what lies between."""
    zero = F.lit(0).cast("bigint")

    def placed(hits: Column, pieces: Column) -> Column:
        ends = running(F.transform(hits, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("bigint")), lambda a, b: a + b, zero)
        return bound(ends, lambda e: F.transform(hits, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"))))

    return bound(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda h: bound(F.split(c, pattern, -1), lambda p: placed(h, p)))
