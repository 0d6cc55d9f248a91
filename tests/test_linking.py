"""Chunks and their boxes: slips, short boxes, repeats; alignment against plain windows."""

import random
import re

import pytest

from docsluice.functions import alignment
from docsluice.functions.alignment import RUN, Text, codes, distances, many_distances, many_lcs, places
from docsluice.functions.similarity import indel_ratio, lcs
from docsluice.operators.linking import candidate_pages, line_boxes, line_chunks, link_boxes

VOCABULARY = [f"{a}{b}{c}" for a in ("con", "re", "pre", "ad") for b in ("tract", "ject", "vise", "mand", "port") for c in ("ed", "ing", "ion", "or")]


def slip(text, r):
    """A slip in every second word: a letter changed, lost or doubled."""
    words = text.split(" ")
    for i in range(1, len(words), 2):
        w = words[i]
        if len(w) > 2:
            k = r.randrange(1, len(w) - 1)
            words[i] = r.choice([w[:k] + "#" + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:]])
    return " ".join(words)


def lines(r, n, words):
    return [" ".join(r.choice(VOCABULARY) + str(r.randrange(90)) for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize(("words", "pages"), [(8, None), (8, 3), (1, None), (3, None)])
def test_every_box_of_a_chunk_with_slips_is_linked(spark, words, pages):
    r = random.Random(words)
    docs = [(i, "\n".join(lines(r, 200 // words, words))) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    boxes, exact = line_boxes(df), line_chunks(df, 300)
    rows = [(c["doc_id"], c["chunk"], slip(c["chunk_text"], r)) for c in exact.collect()]
    got = {(x["doc_id"], x["chunk"]): x for x in link_boxes(spark.createDataFrame(rows, exact.schema), boxes, pages=pages).collect()}
    for i, text in docs:
        at, spans = 0, []
        for x in text.split("\n"):
            spans.append((at, at + len(x), x))
            at += len(x) + 1
        for k in range((len(text) + 299) // 300):
            g = got[i, k]
            mine = set(next(t for d, c, t in rows if (d, c) == (i, k)).lower().split())
            inside = [p for p, (a, b, x) in enumerate(spans) if a >= 300 * k + 6 and b <= 300 * k + 294 and len(set(x.split()) & mine) >= min(3, len(x.split()))]
            # pages of five lines of eight words hold a chunk of 300 characters
            assert set(inside) <= set(g["places"]) and (g["ratio"] or 1) >= 0.65
            assert g["page"] is None or g["page"] in {p // 5 for p in g["places"]}


def test_defined_results_of_odd_rows(spark):
    same = "the same line again and again\n" * 30
    docs = [(1, None), (2, ""), (3, " \n\t\n"), (4, same), (5, "x"), (6, "İstanbul ÜBER straße\n" * 40), (7, "\U0001f600 a b\n" * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["chunk"]): r for r in link_boxes(line_chunks(df), line_boxes(df)).collect()}
    assert {k: (r["ratio"], r["places"], r["page"]) for k, r in got.items() if k[0] < 4} == {(i, 0): (None, [], None) for i in (1, 2, 3)}
    assert got[4, 0]["ratio"] == 1 and got[4, 0]["places"] == list(range(14)) and got[4, 0]["page"] == 0
    assert got[5, 0]["places"] == [0] and got[6, 0]["ratio"] == 1 and got[7, 0]["places"][0] == 0
    none = df.limit(0)
    assert link_boxes(line_chunks(none), line_boxes(none)).count() == 0
    other = spark.createDataFrame([(1, 0, "nothing like it at all, not a word")], line_chunks(df).schema)
    assert [tuple(r) for r in link_boxes(other, line_boxes(spark.createDataFrame([(1, "zzzz yyyy\nqqqq")], "doc_id long, text string"))).collect()] == [(1, 0, None, [], None)]


def test_candidate_pages_are_those_of_a_plain_count(spark):
    r = random.Random(3)
    docs = [(i, "\n".join(" ".join(r.choice(VOCABULARY[:12]) for _ in range(4)) for _ in range(40))) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for x in candidate_pages(line_chunks(df, 150), line_boxes(df), 3).collect():
        got.setdefault((x["doc_id"], x["chunk"]), set()).add((x["page"], x["shared"]))
    for i, text in docs:
        pages = {}
        for k, x in enumerate(text.split("\n")):
            pages.setdefault(k // 5, set()).update(x.split())
        flat = text.replace("\n", " ")
        for c in range((len(flat) + 149) // 150):
            mine = set(flat[150 * c : 150 * c + 150].split())
            best = sorted((-len(mine & w), p) for p, w in pages.items() if mine & w)[:3]
            assert got[i, c] == {(p, -n) for n, p in best}


def test_places_are_about_as_good_as_the_best_window():
    r = random.Random(11)
    for n in (30, 200, 1500):
        text = " ".join(r.choice(VOCABULARY) for _ in range(n // 5))
        t = Text(text)
        for _ in range(15):
            k = r.randrange(max(1, len(text) - 60))
            a = slip(text[k : k + r.choice([12, 40, 60])], r)
            best = max(indel_ratio(a, text[s : s + len(a)]) for s in range(max(1, len(text) - len(a) + 1)))
            got = t.place(a, 0.65)
            assert got and got[2] >= best - 0.05 and text[got[0] : got[1]]


def test_texts_without_a_shared_run_are_found_too():
    text = "".join(chr(97 + i % 26) for i in range(300))
    a = "".join(c if i % RUN else "_" for i, c in enumerate(text[100:180]))  # no run of RUN characters is whole
    assert not Text(text).bands(codes(a), 16)
    assert Text(text).place(a, 0.65)[0] % 26 == 100 % 26
    assert Text(text).place("0123456789", 0.65) is None and Text("").place("x", 0.5) is None and Text("abc").place("", 0.5) is None
    assert Text("abc").place("abcd", 0.65)[:2] == (0, 3)


def test_distances_are_those_of_the_full_table():
    r = random.Random(2)
    for _ in range(30):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(0, 9))) for _ in range(2))
        got = distances(codes(a), codes(b)).tolist()
        for e in range(len(b) + 1):
            assert got[e] == min(len(a) + len(x) - round(indel_ratio(a, x) * (len(a) + len(x))) for x in (b[s:e] for s in range(e + 1)))


def test_many_texts_are_found_as_one_by_one():
    r = random.Random(7)
    texts = [Text(" ".join(r.choice(VOCABULARY) for _ in range(n))) for n in (0, 3, 40, 150)] + [Text("\U0001f600é" * 60)]
    jobs = []
    for _ in range(150):
        t = r.choice(texts)
        k = r.randrange(max(1, len(t.text) - 60))
        jobs.append((t, slip(t.text[k : k + r.choice([0, 5, 64, 65, 300])], r)))
    assert places(jobs, 0.65) == [t.place(a, 0.65) for t, a in jobs] and places([], 0.65) == []


def test_many_common_subsequences_and_distances_at_once():
    r = random.Random(9)
    some = ["".join(r.choice("abc\U0001f600") for _ in range(r.choice([1, 63, 64, 65, 128, 200]))) for _ in range(20)]
    pairs = [(r.randrange(20), r.choice([*some, "", "zzz"])) for _ in range(80)]
    assert many_lcs([codes(a) for a in some], [(k, codes(b)) for k, b in pairs]).tolist() == [lcs(some[k], b) for k, b in pairs]
    got = many_distances([(codes(some[k]), codes(b)) for k, b in pairs])
    assert all(x.tolist() == distances(codes(some[k]), codes(b)).tolist() for x, (k, b) in zip(got, pairs, strict=True))


def test_documents_share_batches(spark):
    """One call of Python for many documents, null ids too; a call for each document was most of the time of small ones."""
    df = spark.createDataFrame([(None if i == 3 else i, f"some line {i}\nanother line of {i}") for i in range(50)], "doc_id long, text string")
    got = link_boxes(line_chunks(df), line_boxes(df))
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    assert sorted((r["doc_id"] or 3, r["ratio"], r["places"], r["page"]) for r in got.where("doc_id IS NULL OR doc_id > 0").collect()) == [(i, 1.0, [0, 1], 0) for i in range(1, 50)]


def test_texts_with_all_known_characters_in_order_are_not_searched(monkeypatch):
    """A stretch that has every character of a text that can be had is the best one; a text with too few of them has no place. Neither needs a table or other stretches."""
    monkeypatch.setattr(alignment, "_searched", lambda jobs, least: pytest.fail("searched"))
    r = random.Random(13)
    for n in (40, 120):
        line = " ".join(r.choice(VOCABULARY) for _ in range(n // 4))
        t = Text(" ".join([line, *(r.choice(VOCABULARY) for _ in range(n)), line]))
        for k in [0, len(t.text) - len(line), *(r.randrange(len(t.text) - 90) for _ in range(12))]:
            a = re.sub(r"(\S+ \S)\S", r"\1~", t.text[k : k + 90])
            a += "" if k % 2 else "~"
            windows = [(indel_ratio(a, t.text[s : s + len(a)]), -s) for s in range(len(t.text) - len(a) + 1)]
            ratio, s = max(windows)
            assert places([(t, a)], 0.65) == [(-s, -s + len(a), ratio)]
    assert places([(Text("abc" * 50), "abc~~~~~~" * 5), (Text("ab"), "a~~~~~~~~")], 0.65) == [None, None]


def test_a_searched_text_has_its_best_stretch_at_its_first_place():
    """Texts of which a part stands elsewhere: the result is that of comparing all stretches, and none where no stretch is alike enough."""
    r = random.Random(5)
    for _ in range(80):
        t = Text(" ".join(r.choice(VOCABULARY[: r.choice([3, 60])]) for _ in range(r.choice([1, 3, 20, 60]))))
        k = r.randrange(max(1, len(t.text) - 30))
        a = (r.choice(["", "zebra quiz ", "zebra quiz zebra quiz "]) + slip(t.text[k : k + r.choice([5, 12, 40, 90])], r))[:90]
        n = min(len(a), len(t.text))
        ratio, s = max((indel_ratio(a, t.text[s : s + n]), -s) for s in range(len(t.text) - n + 1))
        assert a in t.text or places([(t, a)], 0.65) == [(-s, -s + n, ratio) if ratio >= 0.65 else None]
