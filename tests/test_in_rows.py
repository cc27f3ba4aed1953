"""Steps that stay in a document's row or pair up small keys without Python, against plain ways."""

from itertools import combinations

from pyspark.sql import functions as F

from marginalia.functions import scalar as S
from marginalia.operators import craft, evidence, retrieval, units

MEET = r"[^\s.]*\d{3}[^\s.]*"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_sentences_around_matches_need_no_shuffle(spark):
    texts = ["One is 123 (of 45).\nTwo 6789, and\n1000. None.", "\x1e A 12\x1e345 b. C 999.", "„Ab“ 777!  \n\nEnd 5", "", None, "éé 12345. " * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = evidence.around(d, ["doc_id"], MEET, r"\d{3}")
    docs = d.select("doc_id", F.lit(0).alias("start"), F.coalesce("text", F.lit("")).alias("text"))
    places = docs.select("doc_id", F.explode(S.matches(F.col("text"), MEET)).alias("m")).select("doc_id", F.col("m.at").alias("at"))
    want = evidence.quoted(places, evidence.sentences(docs, ["doc_id"]), ["doc_id"], "at").select("doc_id", "at", "quote")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plain = evidence.around(d.where("not contains(text, '\x1e')"), ["doc_id"], MEET, r"\d{3}")
    assert plain.count() == 304


def test_phrases_and_terms_are_counted_without_a_shuffle(spark):
    d = spark.createDataFrame([(1, "red fox ran home " * 5 + "Red’s Fox"), (2, "of the and of " * 9), (3, "a b"), (4, None), (5, "blue cat sat down. Blue cat sat down, blue cat sat down; blue cat sat down")], "doc_id int, text string")
    p = craft.phrases(d)
    assert "Exchange" not in plan(p)
    got = {(r.doc_id, r.phrase): r.n for r in p.collect()}
    assert got[1, "red fox ran home"] == 5 and got[1, "home red fox ran"] == 4 and got[5, "blue cat sat down"] == 4 and not [k for k in got if k[0] in (2, 3, 4)]
    t = retrieval.terms(d, "doc_id", "text")
    assert "Exchange" not in plan(t)
    assert {(r.id, r.term, r.tf, r.len) for r in t.where("id = 1").collect()} == {(1, w, n, 22) for w, n in (("red", 6), ("fox", 6), ("ran", 5), ("home", 5))}


def test_keys_are_bare_words(spark):
    d = spark.createDataFrame([("Don’t stop-- the 'rock-'n'-roll' A- é'- x''-y",)], "t string")
    old = F.transform(S.words(S.normalise(F.col("t"))), S.bare)
    assert "regexp_replace" not in plan(d.select(S.keys(F.col("t"))))
    a, b = d.select(S.keys(F.col("t")).alias("a"), old.alias("b")).first()
    assert a == b


def test_token_spans_of_one_batch(spark):
    texts = ["Où? Là-bas…\n\n x", "", None, "a " * 70000, "𝄞 b."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    assert "MapInArrow" in plan(craft.token_spans(d))
    got = craft.token_spans(d).collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.i)
        assert "".join(r.token for r in own) == (t or "") and [r.i for r in own] == list(range(len(own)))
        assert all((t or "")[r.start : r.end] == r.token for r in own)


def test_small_keys_pair_up_as_the_sweep_does(spark, monkeypatch):
    rows = [(k, i, None if i % 7 == 3 else float(i % 5), None if i % 11 == 3 or i % 7 == 3 else i % 5 + 0.5 * (i % 3)) for k, n in ((1, 1), (2, 9), (None, 12), (3, 70)) for i in range(n)]
    d = spark.createDataFrame(rows, "k int, i int, low double, high double")
    few = sorted(map(repr, units.apart(d, ["k"], ["i"]).collect()))
    monkeypatch.setattr(units, "FEW", 0)
    assert few == sorted(map(repr, units.apart(d, ["k"], ["i"]).collect())) and len(few) > 1000
    clash = lambda a, b: (a[2] is None or b[2] is None) or (a[3] is not None and a[3] < b[2]) or (b[3] is not None and b[3] < a[2])
    own = [r for r in rows if r[0] == 2]
    assert sum(f.startswith("Row(k=2,") for f in few) <= sum(clash(a, b) for a, b in combinations(own, 2))
    assert "collect_list" in plan(units.apart(d, ["k"], ["i"]))
