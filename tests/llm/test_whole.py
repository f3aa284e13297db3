"""Pages and licence notices that were read in part."""

import re
import pytest

from wavecohort.llm import langid, licenses, pages

from .test_operators import documents

START = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
LATER = "of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "text, name",
    [
        (f"{START}; either version 2 {LATER}", "GPL-2.0-or-later"),
        (f"{START}; either version 3 {LATER}", "GPL-3.0-or-later"),
        (f"{START}; version 2 of the License.", "GPL-2.0-only"),
        (f"{START}; version 3 of the License.", "GPL-3.0-only"),
        (START + ".", "GPL-1.0-or-later"),
        ((START + "; either version 2 " + LATER).replace(" under", "\n under").replace(" either", "\neither"), "GPL-2.0-or-later"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "MPL-1.1"),
        ("Chapters:\n2.0\nversion 2\nThis program is free software.", ""),
    ],
)
def test_versions_of_notices(spark, text, name):
    row = licenses.scan(documents(spark, [text])).first()
    assert row["licenses"] == name and row["use"] == ("terms" if name else "none")
    assert not row["sentences"] if not name else row["sentences"]


def test_whole_notices_keep_their_identifiers(spark):
    row = licenses.scan(documents(spark, [f"{START}; either version 2 {LATER}"])).first()
    assert row["sentences"] == "gpl2-or-later"


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("<html><head><title>T</title><article><p>One.</p></article>", ["One."]),
        ("<html><head><title>T</title><meta name='a'><style>p{}</style>Bare<p>Two.", ["Bare", "Two."]),
        ("<html><head><noscript><p>no</p></noscript><template><p>no</p></template><p>yes", ["yes"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>", ["Let x=2 hold."]),
        ("<p>So <math><semantics><mi>y</mi><annotation encoding='application/x-tex'>y</annotation></semantics></math>.</p>", ["So y."]),
    ],
)
def test_pages_are_read_whole(html, blocks):
    assert [b[0] for b in pages.leaf_blocks(html)] == blocks


def test_long_attribute_values_are_read():
    utility = " ".join(f"px-{i}" for i in range(60))
    assert "name:sidebar" in pages.leaf_blocks(f'<div class="{utility} sidebar"><p>x</p></div>')[0][1]


def test_nothing_learnt_drops_nothing(spark):
    docs = documents(spark, ["the and of", "", None])
    model = langid.learn(docs)  # no row has a language
    assert model == {} and langid.accepted(docs, model).count() == 3


def test_languages_not_learnt_go(spark):
    texts = {"en": "the cat sat on the mat and looked at the dog by the door", "es": "el gato se sienta en la alfombra y mira al perro de la casa"}
    learnt = spark.createDataFrame([(i, t, k) for i in range(8) for k, t in texts.items()], "doc_id long, text string, lang string")
    model = langid.learn(learnt)
    greek = "το γατάκι κάθεται στο χαλί και κοιτάζει τον σκύλο δίπλα στην πόρτα του σπιτιού"
    rows = [(1, "the dog sat by the door and looked at the cat on the mat", 5, "x"), (2, greek, 6, "y"), (3, "γάτα", 7, "z"), (4, "12 34 !!", 8, "z"), (5, None, 9, "z"), (6, "", 1, "z"), (None, "the mat", None, None), (1, greek * 3000, 5, "x"), (2, greek, 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, lang_pred string")
    got = langid.accepted(docs, model)
    assert got.columns == docs.columns
    kept = [(1, rows[0][1], 5, "x"), (3, "γάτα", 7, "z"), (None, "the mat", None, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(kept, key=str)
    assert langid.accepted(docs.limit(0), model).count() == 0
    assert {r["doc_id"] for r in langid.accepted(docs, model, ["es"]).collect()}.isdisjoint({1, None})


PROSE = ["It was a long day in the valley, and nobody had thought of the rain. The river rose.", "They went home by the old road, which is not on any map; it took all night.", "In the morning there was light, and bread, and a letter from the town."]
TOP, END = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>', "<footer><p>&copy; 2024 Example</p></footer>"
BODY = "".join(f"<p>{x}</p>" for x in PROSE)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<html><body><form action='/'>{TOP}<article>{BODY}</article>{END}</form></body></html>", PROSE),
        (f"<html><body>{TOP}<div class='has-sidebar'><article>{BODY}</article></div>{END}</body></html>", PROSE),
        (f"<html><body class='single comments-open'>{TOP}<div class='entry-content'>{BODY}</div>{END}</body></html>", PROSE),
        (f"<html><body>{TOP}<div id='content'>{'<br><br>'.join(PROSE)}</div>{END}</body></html>", [" ".join(PROSE)]),
        (f"<html><body>{TOP}<div class='content'>{''.join(f'<div>{x}</div>' for x in PROSE)}</div>{END}</body></html>", PROSE),
        (f"<html class='no-js has-menu'><body>{TOP}<main>{BODY}</main><div class='sidebar'><p>{PROSE[1]}</p></div>{END}</body></html>", PROSE),
    ],
)
def test_articles_within_wrappers_are_found(html, want):
    assert pages.main_text(html, pages.model()) == "\n\n".join(want)


def test_names_of_near_and_of_wide_ancestors():
    got = pages.leaf_blocks("<div class='content'><p>one two three</p><div class='sidebar is-footer'><p>a</p></div><p>four five six</p></div>")
    assert [b[0] for b in got] == ["one two three", "a", "four five six"]
    assert "wide:name:content" in got[0][1] and "name:content" not in got[0][1]
    assert {"name:sidebar", "wide:name:content"} <= got[1][1] and "name:footer" not in got[1][1]
    deep = "<div class='content'>" * 20_000 + "<p>x</p>" * 3
    assert len(pages.leaf_blocks(deep)) == 3


def test_main_text_of_the_given_pages_keeps_prose_and_no_more(spark):
    """Blocks of all given pages against a plain rule on their markup: paragraphs within ``article`` or ``main`` that lie in
    no aside, form, footer or named box are main text; all of ``nav`` and ``footer`` is not."""
    hits = lost = wrong = 0
    out = re.compile(r"near:name:(comment|comments|ad|ads|advert|sidebar|related|newsletter|cookie|consent|promo|share|social|menu|nav|widget|notice|banner)")
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        text = set(pages.main_text(r["html"], pages.model()).split("\n\n"))
        for block, names, tag, _ in pages.leaf_blocks(r["html"]):
            plain = {n.removeprefix("wide:") for n in names}
            if plain & {"in:nav", "in:footer", "in:aside", "in:form", "in:button"}:
                wrong += block in text and plain & {"in:nav", "in:footer"} != set()
            elif tag == "p" and plain & {"in:article", "in:main"} and not any(out.match(n) for n in names) and not any(x in " ".join(plain) for x in ("comment", "sidebar", "name:ad")):
                hits, lost = hits + (block in text), lost + (block not in text)
    assert hits > 300 and lost <= 0.05 * hits and wrong <= 0.05 * hits


def test_the_sql_of_licences_states_pieces_and_versions(spark):
    import duckdb

    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{}"
    texts = [gpl.format(*x) for x in ((";", "; either version 2 of the License, or (at your option) any later version."), (":", ", either version 3 of the License, or (at your option) any later version."), (";", "; version 2 of the License."), (";", "; version 3 of the License."), (";", "; version 2."), (";", "."))]
    texts += [f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}. If a copy" for v in ("2.0", "1.1")] + ["version 2 of the License. 1.1. 2.0", "Version 3; MIT\nReleased under the MIT License.\nAll rights reserved.", "", None]
    texts += [f"{texts[2]} {texts[7]}", f"{texts[5]} version 2 of the License. version 3 of the License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(docs).select("doc_id", "sentences", "licenses", "n_licenses", "use").collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = sorted(con.sql(f"SELECT doc_id, sentences, licenses, n_licenses, use FROM ({licenses.SQL})").fetchall())
    assert got == want
    assert {x for r in got for x in r[2].split(",")} >= {"GPL-2.0-only", "GPL-3.0-only", "GPL-1.0-or-later", "MPL-1.1", "MPL-2.0", "GPL-2.0-or-later", "GPL-3.0-or-later"}
