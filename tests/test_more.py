"""Settings, exports, corrections, registers, bands, drift since a draft."""

import random

import pytest

from marginalia.operators import craft, drafts, store, style
from marginalia.operators import structure as st
from marginalia.plans import exports, runner
from marginalia.sources import settings

from .test_store import COLS


def test_settings(tmp_path):
    assert settings.parse('﻿{"a": [1, 2,], "b": "x,]",}') == ({"a": [1, 2], "b": "x,]"}, "read with a trailing comma ignored")
    with pytest.raises(ValueError):
        settings.parse("{oops")
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (tmp_path / "house.json").write_text('{"terms": ["x", "y"], "style": "Plain.", "rules": [{"id": "r", "pattern": "a"}], "options": {"opener_run": 4, "rule_hits": 9}}')
    (deep / "project.json").write_text('{"terms": ["y", "z"], "rules": [{"id": "r", "cased": true}], "options": {"opener_run": 5},}')
    got = settings.opened(deep)
    assert got.terms == ["x", "y", "z"] and got.rules == [{"id": "r", "pattern": "a", "cased": True}] and got.options == {"opener_run": 5, "rule_hits": 9} and len(got.problems) == 1
    (deep / "project.json").write_text("[1]")
    assert settings.opened(deep).problems == ["project.json: expected dict"] and settings.house_of(deep / "d" / "e" / "f") is None
    assert settings.own_options({"opener_run": 4, "new": 1}, {"options": {"opener_run": 4}}) == {"new": 1}
    assert settings.input_budget(0, 9) == 8192 and settings.input_budget(1000, 900) == 500 and settings.input_budget(1000, 1) == 936


def test_exports(spark):
    text = "# The Road\n\nOpening.\n\n## One\n\nFirst scene.\n\n***\n\nSecond  scene.\n\n### Sub\n\nUnder it.\n\n## Two\n\nLast.\n"
    files = spark.createDataFrame([("a.md", 0, text)], "rel string, file_order int, text string")
    blocks = st.blocks(files).cache()
    sec = st.sections(blocks).cache()
    loc = st.located(blocks, sec)
    rows = exports.numbered_text(files, sec).orderBy("part", "ord").collect()
    assert [r.text for r in rows][:4] == ["- 1 The Road", "  - 1.1 One", "    - 1.1.1 Sub", "  - 1.2 Two"]
    assert [r.text for r in rows][4:] == ["# 1 The Road\n\nOpening.", "## 1.1 One\n\nFirst scene.\n\n***\n\nSecond  scene.", "### 1.1.1 Sub\n\nUnder it.", "## 1.2 Two\n\nLast."]
    lines = exports.submission_text(loc, sec).orderBy("chapter_ord", "ord", "start").collect()
    assert [r.text for r in lines] == ["Opening.", "One", "First scene.", "#", "Second scene.", "#", "Under it.", "Two", "Last.", "THE END"]
    assert exports.title_page(sec, "T", "A", ["x", ""]) == ["x", "", "about 8 words", "", "# T", "", "by A"]
    assert [r.id for r in st.subtree(sec, "a.md#2").orderBy("ord").collect()] == ["a.md#2", "a.md#3"] and st.children(sec, "a.md#1").count() == 2


def test_corrections_and_register(spark):
    rows = [(1, "lid", "torque", "40", "Nm", "a#1", "q", "measured", "numeric"), (2, "lid", "torque", "45", "Nm", "a#2", "q", "model", "numeric"), (3, "pressure", "value", "2", "bar", "a#2", "q", "measured", "numeric")]
    claims = spark.createDataFrame(rows, COLS + ", kind string")
    journal = spark.createDataFrame([(1, 1, "accepted", ""), (3, 2, "superseded", "9")], "claim_id long, seq int, action string, detail string")
    now = store.current(claims, journal)
    new, more = store.corrected(now, 1, {"value": "41"}, 7, 2)
    later = store.current(claims.unionByName(new), journal.unionByName(more.select(*[more[c].cast(journal.schema[c].dataType) for c in journal.columns])))
    got = {r.id: (r.value, r.state, r.section_id) for r in later.collect()}
    assert got[1][1] == "rejected" and got[7] == ("41", "accepted", "a#1")
    c, j = store.authored(spark, {"subject": "hull", "value": "red", "predicate": "is"}, COLS, 8, 4)
    assert c.first().origin == "author" and j.first().action == "accepted"
    sheet = {(r.component, r.quantity): (r.uses, r["values"], r.history, r.conflicts) for r in store.register(now).collect()}
    assert sheet == {("lid", "torque"): (2, ["40 Nm", "45 Nm"], [], 1), ("(not named)", "pressure"): (0, [], ["2 bar"], 0)}
    sections = spark.createDataFrame([("s1", "The Lid and a slid."), ("s2", "nothing")], "section_id string, text string")
    hits = spark.createDataFrame([("s2", 2, 1), ("s1", 1, 1)], "section_id string, id long, rank int")
    assert sorted((r.section_id, r.id, r["rank"]) for r in store.bearing(now, sections, hits).collect()) == [("s1", 1, 1), ("s1", 2, 2), ("s2", 2, 1)]


def test_bands(spark):
    long = "A first one here. A second one there. A third. A last one."
    sec = spark.createDataFrame([(f"s{i}", i, long * (i + 1)) for i in range(5)], "id string, ord int, text string")
    claims = spark.createDataFrame([(1, "lid", "torque", "40")], "id long, subject string, predicate string, value string")
    rows = drafts.candidates(sec, None, "s2", [("style", "Plain words."), ("rules", " ")], claims, "1 One").collect()
    assert {r.id: r.band for r in rows} == {"s0": 4, "s1": 1, "s2": 1, "s3": 1, "s4": 4, "always:style": 0, "claim:1": 2, "outline": 3}
    full = drafts.assemble(rows, 10_000)
    assert full[:2] == ["always:style", "s2"] and full[-1] in ("s0", "s4") and len(full) == 8
    some = drafts.assemble(rows, 110)
    assert "s2" in some and any(x.endswith("(summary)") for x in some)


def test_inline_and_versions(spark, tmp_path):
    a = spark.createDataFrame([("x", "The red lid. Same.")], "rel string, text string")
    b = spark.createDataFrame([("x", "The blue lid. Same. More.")], "rel string, text string")
    h = drafts.hunks(a, b).cache()
    got = drafts.inline(h).first().parts
    assert [(p.op, p.text) for p in got if p.op != "same"] == [("gone", "red"), ("new", "blue")]
    assert tuple(drafts.summary(h).first()) == ("x", 1, 0, 1)
    path = f"file://{tmp_path}/v"
    drafts.save_version(a, path, "first draft")
    with pytest.raises(ValueError):
        drafts.restore_version(spark, path, "first draft", b)
    assert drafts.restore_version(spark, path, "first draft", b, confirm=True).first().text == "The red lid. Same."
    drafts.rename_version(spark, path, "first draft", "one")
    assert drafts.versions(spark, path) == ["before first draft", "one"]
    drafts.delete_version(spark, path, "one")
    assert drafts.versions(spark, path) == ["before first draft"]


def test_drift_since_a_draft(spark):
    r = random.Random(1)
    ws = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    text = lambda n, k: " ".join(" ".join(r.choice(ws) for _ in range(n)).capitalize() + "." for _ in range(k))
    then = spark.createDataFrame([("m", "c0", 0, text(8, 60))], "ms string, id string, ord int, text string")
    now = spark.createDataFrame([("m", f"c{i}", i, text(8 if i < 3 else 25, 40)) for i in range(5)] + [("m", "short", 9, text(8, 3))], "ms string, id string, ord int, text string")
    got = {x.id: x for x in style.since(now, then).collect()}
    assert set(got) == {f"c{i}" for i in range(5)} and {i for i, x in got.items() if x["rank"] <= 2} == {"c3", "c4"}
    assert got["c0"].second_half > got["c0"].first_half > 0
    s = style.score(now.withColumnRenamed("id", "doc_id"), style.fit(then, "ms"), "ms")
    assert "longer sentences" in {x.doc_id: x.said for x in style.described(s).collect()}["c3"]
    lines = spark.createDataFrame([("a", "one two " * 100), ("b", "few words")], "who string, text string")
    assert [x.who for x in style.spoken(lines, "who").collect()] == ["a"]
    assert style.unborrowed(lines, ["few  words"]).where("who = 'b'").first().text.strip() == ""


def test_section_summaries_claims_and_report(spark):

    files = spark.createDataFrame([("m", "a.md", 0, "# 1 A\n\nOne two. Three four. Five. Six seven.\n\n# B\n\n# C\n\nSee Section 9.\n")], "ms string, rel string, file_order int, text string")
    blocks = st.blocks(files)
    sec = st.sections(blocks).cache()
    loc = st.located(blocks, sec).cache()
    got = {r.section_id: r.summary for r in craft.section_summaries(sec, st.section_texts(loc)).collect()}
    assert sorted(got.values()) == ["B — 0 words.", "C (2 words): See Section 9.", "§1 A (7 words): One two. Three four. … Six seven."]
    now = spark.createDataFrame([(1, "Lid", "torque", "numeric", "accepted"), (2, "lid ", "mass", "numeric", "proposed"), (3, "Bo", "age", "attribute", "accepted")], "id long, subject string, predicate string, kind string, state string")
    ids = lambda **k: [r.id for r in store.chosen(now, **k).collect()]
    assert ids() == [1, 2, 3] and ids(subject="LID") == [1, 2] and ids(key=("lid", "Mass")) == [2] and ids(state="accepted", kind="numeric") == [1] and ids(ids=[3, 9]) == [3]
    report = runner.run(runner.Context(loc, sec), only=["xrefs", "steps", "rules"], quotes=True)
    said = exports.report_summary(report)
    assert said["counts"] == {"xrefs": {"defect": 1}} and set(said["quiet"]) == {"steps", "rules"} and not said["failed"]
    assert report.findings.first().quote == "See Section 9."
