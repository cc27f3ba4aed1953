"""The claim store's verbs and the check runner."""

import pytest

from marginalia.operators import store
from marginalia.operators import structure as st
from marginalia.plans import runner

COLS = "id long, subject string, predicate string, value string, unit string, section_id string, quote string, origin string"


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(1, "lid", "torque", "40", "Nm", "a#1", "q", "measured"), (2, "lid", "torque", "45", "Nm", "a#2", "q", "measured"), (3, "pump", "is", "red", "", "a#2", "q", "author")]
    return spark.createDataFrame(rows, COLS)


def test_verbs(spark, claims):
    journal = spark.createDataFrame([(1, 1, "accepted", ""), (2, 2, "rejected", "")], "claim_id long, seq int, action string, detail string")
    now = store.current(claims, journal)
    assert {r.id: r.state for r in now.collect()} == {1: "accepted", 2: "rejected", 3: "proposed"}
    asked = spark.createDataFrame([(1, "supersede", "3"), (2, "revise", ""), (3, "accept", ""), (9, "accept", ""), (1, "fly", "")], "claim_id long, verb string, detail string")
    rows, refused = store.act(now, asked, 2)
    assert {(r.claim_id, r.action) for r in rows.collect()} == {(1, "superseded"), (3, "accepted")}
    assert {(r.claim_id, r.verb) for r in refused.collect()} == {(2, "revise"), (9, "accept"), (1, "fly")}
    later = store.current(claims, journal.unionByName(rows.select(*journal.columns)))
    assert {(r.id, r.state, r.replaced_by) for r in later.collect()} == {(1, "superseded", "3"), (2, "rejected", None), (3, "accepted", None)}
    assert {r.state: r.n for r in store.counts(later).collect()} == {"superseded": 1, "rejected": 1, "accepted": 1, "proposed": 0}
    fresh = claims.select("subject", "predicate", "value", "unit", "section_id", "quote")
    assert {(r.subject, r.value) for r in store.for_sweep(fresh, later).collect()} == {("pump", "red"), ("lid", "40")}
    assert [r.id for r in store.governing(later, "a#2", "the pump").collect()] == [3]


def test_dependents_and_replies(spark):
    p = spark.createDataFrame([("a", 0, "s1", "The lid takes 40 Nm."), ("a", 9, "s1", "The lid again."), ("b", 0, "s2", "A lid at 29.5 lb-ft."), ("b", 5, "s3", "The lid is far.")], "rel string, start int, section_id string, prose string")
    assert [(r.rel, r.start, r.strength) for r in store.dependents(p, "lid", "40", "Nm").collect()] == [("a", 0, 3), ("b", 0, 3), ("a", 9, 2), ("b", 5, 1)]
    raw = spark.createDataFrame([("s1", 'ok [{"subject":"lid","kind":"numeric","predicate":"t","value":"40 Nm","quote":"lid takes  40 Nm"}, {"subject":"x","value":"y","quote":"not there at all"}] bye'), ("s1", "no json")], "section_id string, reply string")
    got = store.model_claims(raw)
    assert got.count() == 2
    sec = spark.createDataFrame([("s1", "The lid takes 40 Nm.")], "section_id string, text string")
    assert [r.subject for r in store.located_claims(got, sec).collect()] == ["lid"]
    t = spark.createDataFrame([("keep this. some borrowed\nprose here. end",)], "text string")
    out = store.record(["some borrowed prose here."], t).first().text
    assert len(out) == 40 and out.startswith("keep this. ") and out.endswith(" end") and "borrowed" not in out and "\n" in out
    c = spark.createDataFrame([("s", "p", v, i, 0) for i, v in enumerate("aabba")], "subject string, predicate string, value string, ord int, start int")
    assert sorted((r.value, r.first, r.last, r.n) for r in store.arcs(c).collect()) == [("a", 0, 1, 2), ("a", 4, 4, 1), ("b", 2, 3, 2)]


def test_runner(spark, tmp_path):
    files = spark.createDataFrame([("a.md", 0, "# A\n\nSee Section 9.\n\n1. x\n2. y\n4. z\n\nThe QRS and QRS.\n")], "rel string, file_order int, text string")
    blocks = st.blocks(files)
    sec = st.sections(blocks)
    ctx = runner.Context(st.located(blocks, sec), sec)
    runner.CHECKS["broken"] = runner.Check("broken", "", ("technical",), None, lambda c: c.located.select("nothing"))
    try:
        report = runner.run(ctx, materialise=lambda d: d.cache())
    finally:
        del runner.CHECKS["broken"]
    assert "broken" in report.failed and "steps" in report.ran
    got = {(r.check, r.severity) for r in report.findings.collect()}
    assert got == {("xrefs", "defect"), ("steps", "defect"), ("acronyms", "warn")}
    assert all(len(r.key) == 12 for r in report.findings.collect())
    ctx.language = "de"
    run, skipped = runner.chosen(ctx)
    assert "xrefs" in skipped and "steps" in {c.name for c in run}
    assert {c.name for c in runner.chosen(runner.Context(ctx.located, sec, "fiction"), add=["steps"])[0]} >= {"pacing", "pov", "steps", "rules"}
