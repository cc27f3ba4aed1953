"""Steps that read a text once, or in compiled code."""

import re

from pyspark.sql import functions as F

from marginalia.functions import scalar as S
from marginalia.operators import style, units
from marginalia.plans import continuity


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_and_texts_of_one_pass(spark):
    texts = ["A dog ran - it ran like an ox. „So?“ \"Oh, my cat; no\" he said. " * 5, "One two three four five.", "A. " * 40, "", None, "Ǯb é-’ The end—of it – as if\n\nas big as it. An 'ox' fell. The A- b c d e quickly.", "x y z " * 30]
    d = spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in enumerate(texts)], "doc_id int, source string, text string")
    rows = style.profiled(d, "source").cache()
    base, want = style.baseline(rows.where("not whole")), style.fit(d, "source")
    near = lambda df: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()], key=repr)
    assert near(base) == near(want) != []
    assert near(style.scored(rows.where("whole"), base)) == near(style.score(d, want, "source")) != []
    # A word's letters may lie outside of the class of words once it is normalised: it counts as it is written.
    got = style.counted(d.select("doc_id", S.sentences(F.col("text")).alias("s"))).where("doc_id = 5").first()
    assert (got.in_sentences, got.dash_marks, got.simile_marks) == (len(re.findall(S.WORD, texts[5])), 2, 2)


def test_matches_compile_their_pattern_once(spark):
    d = spark.createDataFrame([("a1b22c",), ("22",), ("\x1f1\x1f2 x",), ("none",), ("",), (None,)], "t string")
    got = [r[0] and [(x.at, x.hit) for x in r[0]] for r in d.select(S.matches(F.col("t"), "\\d+")).collect()]
    assert got == [[(1, "1"), (3, "22")], [(0, "22")], [(1, "1"), (3, "2")], [], [], None]
    assert "regexp_replace" in plan(d.select(S.matches(F.col("t"), "\\d+")))


def test_pairs_of_small_keys_are_compiled(spark):
    d = spark.createDataFrame([(1, float(i), float(i)) for i in range(4)], "k int, low double, high double")
    out = units.apart(d.withColumn("i", F.col("low").cast("int")), ["k"], ["i"])
    assert out.count() == 6 and "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_read_where_the_text_is(spark):
    seen = []
    continuity._claims(continuity.manuals(spark, "/root/testdata/sf0.001"), lambda p: seen.append(p) or p)
    assert "Exchange" not in plan(seen[0].select("ms", "text"))
