"""Remembered runs, baselines, and prompts that stay within their budgets."""

import random

import pytest

from marginalia.operators import drafts, style
from marginalia.operators import structure as st
from marginalia.plans import history, runner


def manuscript(spark, text):
    files = spark.createDataFrame([("m", "a.md", 0, text)], "ms string, rel string, file_order int, text string")
    blocks = st.blocks(files).cache()
    sec = st.sections(blocks).cache()
    return runner.Context(st.located(blocks, sec).cache(), sec, files=files)


def test_a_second_run_shows_what_is_fresh_and_gone(spark, tmp_path):
    shelf = history.Shelf(spark, f"file://{tmp_path}/shelf")
    assert history.previous(shelf) is None
    choice = {"only": ["xrefs", "steps"], "quotes": False}
    one = manuscript(spark, "# 1 A\n\nSee Section 7 and Section 8.\n\n1. A.\n2. B.\n4. C.\n")
    first = history.compared(one, shelf, at="monday", **choice)
    assert first.first and {(r.title, r.state) for r in first.states.collect()} == {("No section 7", "shown"), ("No section 8", "shown"), ("Steps of a.md: missing 3", "shown")} - {("No section 8", "shown")}  # keys see digits as one
    two = manuscript(spark, "# 1 A\n\nSee Section 7. See Figure 2.\n\n1. A.\n2. B.\n3. C.\n")
    hide = first.states.where("title like 'No section%'").select("key")
    second = history.compared(two, shelf, hide, at="tuesday", **choice)
    assert not second.first and {(r.title, r.state) for r in second.states.collect()} == {("No section 7", "hidden"), ("No figure 2", "fresh"), ("Steps of a.md: missing 3", "gone")}
    third = history.compared(two, shelf, **choice)
    assert {(r.title, r.state) for r in third.states.collect()} == {("No section 7", "shown"), ("No figure 2", "shown")}
    assert shelf.facts(history.RUNS)["version"] == history.KEY_VERSION
    assert len([p for p in (tmp_path / "shelf").iterdir() if p.name == "last-run.json"]) == 1


def test_failed_runs_and_damaged_pointers(spark, tmp_path, monkeypatch):
    shelf = history.Shelf(spark, f"file://{tmp_path}/shelf")
    ctx = manuscript(spark, "# 1 A\n\nSee Section 7.\n")
    choice = {"only": ["xrefs", "steps"], "quotes": False}
    history.compared(ctx, shelf, **choice)
    before = shelf.facts(history.RUNS)
    monkeypatch.setitem(runner.CHECKS, "steps", runner.Check("steps", "steps", ("technical",), None, lambda c: 1 / 0))
    assert history.compared(ctx, shelf, **choice).report.failed and shelf.facts(history.RUNS) == before
    with pytest.raises(RuntimeError, match="no check ran"):
        history.compared(ctx, shelf, only=["steps"])
    monkeypatch.setattr(history, "KEY_VERSION", 2)
    assert history.previous(shelf) is None
    (tmp_path / "shelf" / "last-run.json").write_text("{")
    assert shelf.facts(history.RUNS) is None and shelf.load(history.RUNS) is None


def test_baselines(spark, tmp_path):
    shelf = history.Shelf(spark, f"file://{tmp_path}/shelf")
    assert history.load_baseline(shelf, "plain") is None
    table = spark.createDataFrame([("a", "metric", 1.5, 0.25)], "grp string, metric string, mean double, sd double")
    history.save_baseline(shelf, "plain", table, "chapter one")
    history.save_baseline(shelf, "plain", table.union(table), "chapter two")
    assert history.load_baseline(shelf, "plain").count() == 2 and shelf.facts("baseline-plain")["fitted_on"] == "chapter two"
    assert style.fit is not None


def test_prompts_never_exceed_their_budgets(spark):
    r = random.Random(9)
    said = lambda n: " ".join(r.choice(["One two three.", "A longer sentence stands here, with words.", "é🙂 x!", "Was it?"]) for _ in range(n))
    cands, asks = [], []
    for q in range(120):
        for k in range(r.randrange(0, 14)):
            cands.append((q, f"c{k}", r.choice([0, 1, 2, 3, 4, 4, 4]), said(r.randrange(0, 30)), r.random() * 9, r.choice(["", None, "Short."])))
        asks.append((q, r.randrange(1, 700), r.choice(["", None, "Write the next scene. " * r.randrange(1, 9)])))
    rows = drafts.prompts(spark.createDataFrame(cands, "request long, id string, band int, text string, value double, summary string").repartition(3), spark.createDataFrame(asks, "request long, budget int, ask string"))
    got = {int(x.request): x for x in rows.collect()}
    assert set(got) == set(range(120))
    cut = 0
    for q, budget, ask in asks:
        x, own = got[q], {c[1]: c for c in cands if c[0] == q}
        if x.problem:
            assert x.text == "" and not x.carried
            continue
        assert x.tokens == drafts.estimated(x.text) <= budget
        assert sorted(x.carried + x.dropped) == sorted(own) and set(x.shortened) | set(x.summarised) <= set(x.carried)
        assert all(own[i][3].strip() in x.text for i in own if own[i][2] == 0) and (ask or "").strip() in x.text
        for i in set(x.carried) - set(x.summarised) - set(x.shortened):
            assert own[i][3].strip() in x.text
        cut += len(x.shortened)
    assert cut > 5 and sum(x.problem is not None for x in got.values()) > 3


def test_a_text_over_budget_is_cut_at_a_sentence(spark):
    text = "One two three four. " * 3 + "Five six seven eight nine ten."
    c = spark.createDataFrame([("q", "a", 1, text, 1.0, "")], "request string, id string, band int, text string, value double, summary string")
    whole = drafts.estimated(text)
    got = drafts.prompts(c, spark.createDataFrame([("q", whole, "")], "request string, budget int, ask string")).first()
    assert got.shortened == ["a"] and got.text.endswith("One two three four.") and got.tokens <= whole
