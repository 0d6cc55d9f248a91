import pytest

from docsluice.llm import licences as L


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return L.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def found(spark, model, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS t", "2 AS found", "3 AS id")
    return [r.licence for r in L.scan(df, model).orderBy("doc_id").collect()]


def test_every_template_is_named(spark, model):
    cases = [(f, t) for f in L.FAMILIES for t in L.TEMPLATES[f]]
    got = found(spark, model, [f"Some prose before.\n{t}\nand after" for _, t in cases])
    assert [(f, g) for (f, _), g in zip(cases, got) if f != g] == []


def test_changed_notices_and_other_uses(spark, model):
    known = {"Copyright (c) 2020 A. Person. Released under the MIT License.": "MIT", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0": "Apache-2.0", "licensed under cc by-nc 4.0": "CC-BY-NC"}
    assert found(spark, model, list(known)) == list(known.values())
    other = ["My driving licence expired in May.", "He went to MIT.", "The apache tribe", "A licence to kill, version 2.0", "Ein ganz normaler Satz ohne alles.", *L.PLAIN]
    assert not [x for x in found(spark, model, other) if x not in ("unknown", "unconfirmed")]


def test_null_empty_long_and_repeated(spark, model):
    long = "\n".join(f"line {i} of a long text about nothing" for i in range(4000)) + "\nReleased under the MIT License."
    assert found(spark, model, [None, "", "\n\n", long, "x" * 100_000, "..."]) == ["unknown", "unknown", "unknown", "MIT", "unknown", "unknown"]
    df = spark.createDataFrame([(1, "All rights reserved."), (1, "All rights reserved."), (None, "All rights reserved.")], "doc_id long, text string")
    assert [r.licence for r in L.scan(df, model).collect()] == ["proprietary"] * 3
    assert L.scan(df.limit(0), model).count() == 0


def test_first_of_equals_and_paragraph_numbers(spark, model):
    row = L.scan(spark.createDataFrame([(1, "a\nAll rights reserved.\n\nAll rights reserved.")], "doc_id long, text string"), model).first()
    assert [(x.paragraph, x.family, x.confirmed) for x in row.found] == [(1, "proprietary", True), (3, "proprietary", True)] and row.n_paragraphs == 3


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = L.op1_licence_scan(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    notice = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    for r in rows:
        stated = {f for n, f in notice.items() if n in docs[r.doc_id].split("\n")}
        assert (r.licence in stated) if stated else r.licence in ("unknown", "unconfirmed")


def test_training_on_an_empty_table(spark):
    m = L.train(spark.createDataFrame([], "doc_id long, text string"))
    assert found(spark, m, ["Released under the MIT License."]) == ["MIT"]


def test_identifier_lines_and_more_licences(spark, model):
    cases = [(f, f"// SPDX-License-Identifier: {x}") for f, names in L.SPDX.items() for x in names]
    cases += [("GPL", "Licensed under the GNU General Public License, version 2."), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)"), ("AGPL", "Licensed under the GNU Affero General Public License, version 3.")]
    got = found(spark, model, [t for _, t in cases])
    assert [(f, t, g) for (f, t), g in zip(cases, got) if f != g] == []


def test_wording_that_no_fit_has_seen(spark, sf_dir, monkeypatch):
    """Held-out accuracy: of each family with several sentences one is left out; more than half of these (11 of 18 when this was written) are still taken for licences,
    and hardly any paragraph of the documents is."""
    left = {f: t[1] for f, t in L.TEMPLATES.items() if len(t) > 2 and not t[1].startswith("SPDX")}
    monkeypatch.setattr(L, "TEMPLATES", {f: [x for x in t if x != left.get(f)] for f, t in L.TEMPLATES.items()})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = L.train(docs)
    got = found(spark, m, list(left.values()))
    assert len(left) > 8 and sum(g != "unknown" for g in got) >= 0.5 * len(got), list(zip(left, got))
    lines = {x for r in docs.collect() for x in (r.text or "").split("\n") if "licen" not in x.lower() and "rights" not in x.lower() and x.strip()}
    wrong = [g for g in found(spark, m, sorted(lines)[:2000]) if g != "unknown"]
    assert len(wrong) <= 20
