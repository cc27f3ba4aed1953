"""Files in one row each, against the flat table of blocks and its windows."""

from marginalia.operators import checks as C
from marginalia.operators import narrative as N
from marginalia.operators import structure as ST
from marginalia.plans import records, runner

TEXTS = [
    "Before.\n\n# 1 One\n\nA b. C d.\n\n- x\n- y\n\n## Sub\n\n1. Go.\n2. Stop.\n\nPlain end.", "---\na: b\n---\n\n# Top\n\nText of it.\n\nMore\n===\n\n> said", "", None, "| a |\n\n```\ncode\n```\n\n# Late\n\nWords 40 Nm here.",
    "no heading at all", "# only\n# headings", "   Blank ahead.\n\n\n***\n\n  end  ", "| t |",
]


def rows(df, *cols):
    return sorted(repr(tuple(r)) for r in df.select(*(cols or df.columns)).collect())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def files_of(spark):
    own = [(str(k % 3), f"f{k}.{'txt' if k % 4 == 3 else 'md'}", k // 3, t) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(own + [("", "a/no name.md", 0, TEXTS[0])], "ms string, rel string, file_order int, text string")


def test_one_row_for_a_file_is_its_blocks_sections_and_texts(spark):
    files = files_of(spark)
    blocks, whole = ST.blocks(files).cache(), ST.whole(files).cache()
    sec = ST.sections(blocks).cache()
    assert whole.count() == files.count()
    assert rows(ST.sections(whole), *sec.columns) == rows(sec)
    loc = ST.located(blocks, sec).cache()
    assert ST.unfolded(whole).columns == loc.columns and rows(ST.unfolded(whole)) == rows(loc)
    for made in (ST.section_texts, ST.file_texts):
        assert rows(made(whole), *made(loc).columns) == rows(made(loc)) != []


def test_texts_are_not_shuffled(spark):
    whole = ST.whole(files_of(spark))
    for d in (ST.section_texts(whole), ST.file_texts(whole), ST.unfolded(whole)):
        assert "Exchange" not in plan(d)
    # Runs of steps and sections go through windows, without the texts of blocks.
    blocks = ST.blocks(files_of(spark)).cache()
    for d in (ST.steps(ST.located(blocks, ST.sections(blocks)).cache()), ST.sections(blocks)):
        for line in plan(d).split("InMemoryRelation")[0].splitlines():
            assert "Exchange" not in line or "text#" not in line and "prose#" not in line


def test_check_pass_reads_one_row_for_a_file(spark):
    ctx = records._manuscripts(spark, "/root/testdata/sf0.001")
    for d in (ctx.by_file(), ctx.by_section(), N.numeric_claims(ST.paragraphs(ctx.located).selectExpr("ms", "rel", "section_id", "0 as ord", "start", "prose as text")).select("subject", "value"), C.long_steps(ctx.located)):
        assert "Exchange" not in plan(d).replace("rangepartitioning", "") or d.columns == ["subject", "value"]
    only = ["steps", "units", "lengths", "openers", "terminology"]
    flat = runner.Context(ctx.located, ctx.sections)
    a, b = runner.run(ctx, only=only, quotes=False), runner.run(flat, only=only, quotes=False)
    assert not a.failed and not b.failed and rows(a.findings) == rows(b.findings) != []
