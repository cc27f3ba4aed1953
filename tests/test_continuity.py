"""Evidence, terms, name groups, clashing intervals, references and links, and the clauses of
quantities, each against a plain search or a table of truths."""

import random
import re

from marginalia.functions import scalar as s
from marginalia.operators import evidence, narrative, structure, terms, units
from pyspark.sql import functions as F


def test_sentence_spans_are_the_sentences(spark):
    r = random.Random(1)
    bits = ["Dr. ", "A b. ", "No. 5 ", "é🙂! ", "\n\n", "\n \n\n", " ", "e.g. x", "?” ", "End", "."]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(30)))) for i in range(400)] + [(900, None), (901, "A b c. " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for x in docs.select("text", s.sentences(F.col("text")).alias("a"), s.sentence_spans(F.col("text")).alias("b")).collect():
        assert [y.said for y in x.b] == x.a
        assert all(x.text[y.start : y.end] == y.said for y in x.b)


def test_quotes_equal_a_plain_look_up(spark):
    r = random.Random(2)
    texts = [(f"f{i}", base, "".join(r.choice(["One two. ", "Three four five! ", "\n\n", "w " * 300, "é🙂 x. ", "  "]) for _ in range(40))) for i in range(6) for base in (0, 90_000)]
    texts.append(("long", 7, "word " * 20_000 + "end. Next one."))
    pieces = spark.createDataFrame(texts, "rel string, start int, text string")
    spots = [(rel, base + r.randrange(-3, len(t) + 3)) for rel, base, t in texts for _ in range(60)] + [("none", 4), ("f1", None)]
    places = spark.createDataFrame([(*p, k) for k, p in enumerate(spots)], "rel string, start int, k int").repartition(3)
    spans = {(x.rel, x.start): x.b for x in pieces.select("rel", "start", s.sentence_spans(F.col("text")).alias("b")).collect()}
    got = evidence.quoted(places, evidence.sentences(pieces, ["rel"]), ["rel"]).collect()
    assert len(got) == len(spots)
    for x in got:
        want = [y.said for (rel, base), b in spans.items() if rel == x.rel and x.start is not None for y in b if base + y.start <= x.start < base + y.end]
        assert x.quote == re.sub(r"\s+", " ", want[0] if want else "")


def test_term_places_equal_plain_search(spark):
    r = random.Random(3)
    names = {"a": ["lid", "lid bolts", "Über", "a a", "x+y", "İz", ""], "b": ["LID", "bolts"], "c": ["never"]}
    bits = ["lid", "Lid", "bolts", " ", " ", "über", "ÜBER", "a", "x+y", "_", "-", "İz", "é", "9", "\n"]
    rows = [(r.choice("abcd"), i, "".join(r.choice(bits) for _ in range(r.randrange(40)))) for i in range(500)] + [("a", 999, None)]
    docs = spark.createDataFrame(rows, "ms string, doc_id long, text string").repartition(3)
    listed = spark.createDataFrame([(ms, n) for ms, ns in names.items() for n in ns], "ms string, name string")
    got = {(x.doc_id, x.term, x["from"], x.to) for x in terms.found(docs, listed).collect()}
    want = {(i, n, m.start(), m.end()) for ms, i, t in rows for n in names.get(ms, []) if n for m in re.finditer(rf"(?<!\w){re.escape(n)}(?!\w)", t or "", re.I)}
    assert got == want and len(want) > 100


def test_name_groups(spark):
    names = [("m", "Alexander", 9), ("m", "Aleksandr", 5), ("m", "Sasha", 5), ("m", "Mira", 8), ("m", "Kestrel", 4), ("m", "Kestrels", 3), ("o", "Sasha", 2), ("o", "Viktor", 2), ("o", "Victor", 3)]
    got = {(x.ms, x.name): (x.forms, x.uses) for x in narrative.name_groups(spark.createDataFrame(names, "ms string, name string, uses long")).collect()}
    assert got == {("m", "Alexander"): (["Aleksandr", "Sasha"], 19), ("m", "Kestrel"): (["Kestrels"], 7), ("o", "Victor"): (["Viktor"], 5)}
    # A star: Lisa and Liza lie next to Lina, not always next to each other; each belongs to the first head that takes it.
    r = random.Random(4)
    cast = [("k", "".join(r.choice("aeklnrs") for _ in range(r.randrange(5, 7))).capitalize(), r.randrange(1, 9)) for _ in range(60)]
    cast = list({x[1]: x for x in cast}.values())
    d = spark.createDataFrame(cast, "ms string, name string, uses long")
    tie = {frozenset((x.name, x.form)) for x in narrative.name_variants(d).collect()}
    free, want = sorted(cast, key=lambda x: (-x[2], x[1])), {}
    while free:
        head, *free = free
        forms = [x for x in free if frozenset((head[1], x[1])) in tie]
        free = [x for x in free if x not in forms]
        if forms:
            want[head[1]] = [x[1] for x in forms]
    assert {x.name: x.forms for x in narrative.name_groups(d).collect()} == want and want


def test_the_sweep_finds_all_pairs_that_lie_apart(spark):
    r = random.Random(5)
    value = lambda: r.choice([str(r.randrange(1, 12)), f"{r.randrange(1, 9)}–{r.randrange(3, 14)}", f"{r.random() * 9:.1f}", f"{r.randrange(1, 9)}000"])
    rows = [(r.choice("abc"), value(), r.choice(["mm", "m", "km", "kg", "°C", "°F", "foo"])) for _ in range(160)]
    d = spark.createDataFrame(rows, "key string, value string, unit string").repartition(5)
    one = d.distinct()
    a, b = one.select("key", F.col("value").alias("a"), F.col("unit").alias("a_unit")), one.select("key", F.col("value").alias("b"), F.col("unit").alias("b_unit"))
    every = a.join(b, "key").where(F.struct("a", "a_unit") < F.struct(F.col("b"), F.col("b_unit"))).where(units.conflict(F.col("a"), F.col("a_unit"), F.col("b"), F.col("b_unit")))
    cols = ["key", "a", "a_unit", "b", "b_unit"]
    want = sorted(map(tuple, every.select(cols).collect()))
    assert sorted(map(tuple, units.conflicts(d, ["key"]).select(cols).collect())) == want and len(want) > 500


def test_objects_and_ranges_of_quantities(spark):
    rows = {
        "The torque for the lid bolts is 40 Nm.": [("40", "Nm", "torque", "lid bolts")], "The lid bolt torque is 40 Nm to 50 Nm.": [("40–50", "Nm", "torque", "lid bolt")],
        "Tighten the wheel nuts to 110 Nm.": [("110", "Nm", "torque", "wheel nuts")], "Apply 40 Nm to the lid bolts.": [("40", "Nm", "torque", "lid bolts")], "A torque of 45 Nm on the cover.": [("45", "Nm", "torque", "cover")],
        "A pressure of 3 bar applies to the front tyre.": [("3", "bar", "pressure", "front tyre")], "A torque of 40 Nm is applied to the housing.": [("40", "Nm", "torque", "housing")], "Set the supply voltage to 12 V.": [("12", "V", "voltage", "supply")],
        "The torque range for the pump is 10–20 Nm.": [("10–20", "Nm", "torque range", "pump")], "Tighten the 4 bolts to 40 Nm.": [("40", "Nm", "torque", "bolts")], "Heat 3 cups to 180 °C.": [("180", "°C", "temperature", "cups")],
        "bolts 1 to 6 to 25 Nm": [("25", "Nm", "", "")], "Wait 5 min to 40 Nm.": [("5", "min", "", ""), ("40", "Nm", "", "")], "A pressure of 500 kPa to 7 bar.": [("5–7", "bar", "pressure", "")], "": [], "It is.": [],
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = {x.t: [(y.value, y.unit, y.quantity, y.object) for y in x.q] for x in df.select("t", units.quantities(F.col("t")).alias("q")).collect()}
    assert got == rows
    places = {x.t: [x.t[y.at : y.end] for y in x.q] for x in df.select("t", units.measures(F.col("t")).alias("q")).collect()}
    assert places["Wait 5 min to 40 Nm."] == ["5 min", "40 Nm"] and places["The lid bolt torque is 40 Nm to 50 Nm."] == ["40 Nm to 50 Nm"]


GUIDE = """# Chapter Two

See Section 4.2, Section 9.9, Figure 1, Figure 7, Table A1, Chapter 2, Part IV, Annex B, appendix c and the part I liked. See Part Overview.

## 4.2 Care of it!

[a](#42-care-of-it) [b](#42-care-of-it-1) [c](#42-care-of-it-2) [d](other.md#made-up) [e](sub/../other.md#own) [f](gone.md) [g](https://x.y/z#q) [h](other.md#Here) [i](#spot)

Figure 1: One. <a id="spot"></a>

## 4.2 Care of it!

Table A1. Two.

# Appendix C
"""
OTHER = "# Here\n\nText {#own} as is. [up](../guide.md) and [back](guide.md#chapter-two).\n"


def test_references_and_links(spark):
    files = spark.createDataFrame([("m", "guide.md", 0, GUIDE), ("m", "other.md", 1, OTHER), ("n", "guide.md", 0, "# One\n\nSee Section 1 and Section 4.2. [x](other.md)")], "ms string, rel string, file_order int, text string")
    blocks = structure.blocks(files)
    sec = structure.sections(blocks)
    loc = structure.located(blocks, sec).cache()
    broken = structure.broken_references(loc, sec).collect()
    assert {(x.ms, x.what, x.target) for x in broken} == {("m", "section", "9.9"), ("m", "figure", "7"), ("m", "annex", "B"), ("n", "section", "4.2")}
    for x in broken:
        if x.ms == "m":
            assert GUIDE[x.at :].lower().startswith(f"{x.what} {x.target}".lower())
    gone = structure.broken_links(loc, files).collect()
    assert {(x.ms, x.rel, x.what, x.target) for x in gone} == {("m", "guide.md", "anchor", "#42-care-of-it-2"), ("m", "guide.md", "anchor", "other.md#made-up"), ("m", "guide.md", "file", "gone.md"), ("n", "guide.md", "file", "other.md")}
