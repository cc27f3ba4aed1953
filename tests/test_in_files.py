"""Novels' checks in the file's row, against the flat table of blocks; texts stay where they are."""

import re

from pyspark.sql import functions as F

from marginalia.functions import scalar as S
from marginalia.operators import checks as C
from marginalia.operators import structure as ST
from marginalia.operators import terms
from marginalia.plans.leaf import leaf

WIND = "The wind blew and Tom’s İ hat fell off. " * 22
TEXTS = [
    "Ahead.\n\n# One\n\n" + "He knew it. Tom felt cold. " * 40 + f"\n\n***\n\nTom knew. TOM felt. He saw.\n\n## Sub\n\n“Go now,” Tom said softly. {WIND}\n\n- he saw\n- she felt",
    f"## Low\n\n{WIND}\n\n# High\n\nHe knew. He knew. Ann felt. Ann felt.\n\n{WIND}\n\n### Deep\n\n" + '"Yes," Ann hissed loudly. \'No,\' he muttered. ' * 25,
    "", None, f"* * *\n\n{WIND}\n\n---\n\nEnd of it.", "--'a-- b'-c ’d × é-'", "# 1\n\nI knew <b>it</b> and `I felt` [I felt](x) **I saw** _I saw_ <!-- I saw -->",
]


def tables(spark):
    own = [(str(k % 2), f"f{k}.md", k, t) for k, t in enumerate(TEXTS)]
    files = spark.createDataFrame(own, "ms string, rel string, file_order int, text string")
    blocks, whole = ST.blocks(files).cache(), ST.whole(files).cache()
    sec = ST.sections(blocks).cache()
    return ST.located(blocks, sec).cache(), sec, whole


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_in_a_files_row_find_the_same(spark):
    loc, sec, whole = tables(spark)
    assert rows(C.points_of_view(whole, ["Tom", "Ann"])) == rows(C.points_of_view(loc, ["Tom", "Ann"])) != []
    assert rows(C.dialogue_shares(whole, sec)) == rows(C.dialogue_shares(loc, sec)) != []
    cols = ["section_id", "scene", "start", "prose"]
    assert rows(ST.scene_blocks(whole).select(cols)) == rows(ST.scene_blocks(loc).select(cols)) != []
    tags = C.dialogue_tags(loc, 1).collect()
    assert {(r.verb, r.uses) for r in tags} >= {("hissed", 25), ("said", 1)} and sum(r.uses for r in tags) == C.tag_verbs(loc).count()


def test_no_text_is_shuffled_for_them(spark):
    _, sec, whole = tables(spark)
    loc = ST.unfolded(whole)
    for d in (C.points_of_view(whole, ["Tom"]), C.dialogue_shares(whole, sec), C.mentions(loc, sec, ["Tom"]), C.dialogue_tags(loc)):
        own = plan(d).split("InMemoryRelation")[0]
        assert "Broadcast" not in plan(C.points_of_view(whole, ["Tom"])) and "Exchange" in own
        for line in own.splitlines():
            assert "Exchange" not in line or not any(c in line for c in ("prose#", "parts#"))
    assert "Window" not in plan(ST.sections(whole))


def test_names_stand_where_they_did(spark):
    loc, sec, _ = tables(spark)
    texts = loc.where(F.col("kind").isin(*ST.PROSE)).select("ms", "section_id", "start", F.col("prose").alias("text"))
    for names in (["Tom", "ann ", "Tom"], ["é", "Tom"], ["nobody"]):
        assert rows(terms.found_all(texts, names)) == rows(terms.found(texts, terms.of_all(texts, names)))
    assert terms.found_all(texts, []).count() == 0


def test_chapters_words_and_plain_prose(spark):
    _, sec, whole = tables(spark)
    assert rows(ST.roots(sec)) == rows(ST.roots(sec.drop("root_id")))
    top = {r.id for r in sec.where("parent_id is null").collect()}
    assert {r.section_id for r in ST.section_texts(whole).where("top").collect()} <= top
    assert all(ST._words(t or "") == len(re.findall(S.WORD, t or "")) for t in [*TEXTS, "--", "'", "a--b '' -c- d"])
    text = TEXTS[6]
    assert ST.prose(text, ST.scan(text)).split() == ["I", "knew", "it", "and", "I", "felt", "I", "saw", "I", "saw"]


def test_large_rows_inside_of_arrays_are_not_broadcast(spark):
    big = leaf(spark.range(200).select(F.col("id").alias("k"), F.array(F.struct(F.repeat(F.lit("The wind blew. "), 4000).alias("text"))).alias("parts")))
    assert "Broadcast" not in spark.range(9).toDF("k").join(big, "k")._jdf.queryExecution().sparkPlan().toString()
