"""Claims, contradictions, names and time markers on small passages."""

import pytest

from marginalia.operators import narrative as n
from marginalia.operators import units

TEXT = [
    ("a", "a#1", 0, "The torque for the lid bolts is 40 Nm. Tighten the wheel nuts to 110 Nm. It weighs 5 apples in 3 V."),
    ("a", "a#2", 1, "The torque for the lid bolts is 45 Nm. The bronze sword lay there. Mira is Tom's sister. The wedding was on Tuesday."),
    ("b", "b#1", 2, "The torque for the lid bolts is 29.5 lb-ft. He drew the steel sword. The wedding was on Thursday. The sword was a gift, and old."),
    ("b", "b#2", 3, "On 2024-03-05 they left. Then 2024-03-01 came, two days later, at 10:30 pm. It took 20 minutes."),
]


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame([(r, s, o, 100 * o, t) for r, s, o, t in TEXT], "rel string, section_id string, ord int, start int, text string").cache()


def test_claims_and_contradictions(spark, passages):
    got = n.claims(passages, ["sword"]).cache()
    rows = {(r.subject, r.predicate, r.value, r.unit, r.kind) for r in got.collect()}
    assert {("lid bolts", "torque", "40", "Nm", "numeric"), ("wheel nuts", "torque", "110", "Nm", "numeric"), ("lid bolts", "torque", "29.5", "lb-ft", "numeric")} <= rows
    assert {("sword", "material", "bronze", "", "attribute"), ("sword", "material", "steel", "", "attribute"), ("sword", "is", "gift", "", "attribute")} <= rows
    assert ("Mira", "sister of", "Tom", "", "relationship") in rows and ("wedding", "when", "tuesday", "", "temporal") in rows
    assert all(r.state == "proposed" for r in got.collect())
    pairs = {(r.key, r.a_value, r.b_value): r.certain for r in n.contradictions(got).collect()}
    # 40 and 29.5 lb-ft agree within their stated precision; 45 is apart from both.
    assert pairs == {("lid bolts|torque", "40", "45"): True, ("lid bolts|torque", "45", "29.5"): True, ("sword|material", "bronze", "steel"): True, ("wedding|when", "tuesday", "thursday"): True}
    assert n.fresh_claims(got, got).count() == 0
    assert n.fresh_claims(got, got.where("kind = 'numeric'")).where("kind = 'numeric'").count() == 0


def test_moments(spark, passages):
    got = [(r.kind, r.text) for r in n.moments(passages).orderBy("ord", "start").collect()]
    assert got == [("weekday", "Tuesday"), ("weekday", "Thursday"), ("date", "2024-03-05"), ("date", "2024-03-01"), ("relative", "two days later"), ("clock", "10:30 pm"), ("duration", "20 minutes")]
    assert [(r.before, r.text) for r in n.dates_backwards(n.moments(passages)).collect()] == [("2024-03-05", "2024-03-01")]
    for r in n.moments(passages).collect():
        t = TEXT[r.ord][3]
        assert t[r.start - 100 * r.ord :].startswith(r.text)


def test_cast_and_variants(spark):
    text = "Sasha ran. Then Sasha met Aleksandr. Alexander and Aleksandr saw Sasha. So Aleksandr left with Alexander. Later Alexander wept. But Sasha knew Alexander and Aleksandr. " * 2
    text += "On Tuesday it rained. By Tuesday they left. On Tuesday again. Last Tuesday too. Meanwhile it rained. Meanwhile. Meanwhile. Meanwhile."
    p = spark.createDataFrame([("a", "a#1", 0, 0, text)], "rel string, section_id string, ord int, start int, text string")
    names = n.cast(p)
    assert {r.name for r in names.collect()} == {"Sasha", "Aleksandr", "Alexander"}
    got = {frozenset((r.name, r.form)) for r in n.name_variants(names).collect()}
    assert got == {frozenset(x) for x in (("Sasha", "Aleksandr"), ("Sasha", "Alexander"), ("Aleksandr", "Alexander"))}
    other = spark.createDataFrame([("Mira", 5), ("Kestrel", 4)], "name string, uses long")
    assert n.name_variants(other).count() == 0


def test_unit_table(spark):
    rows = [(u, d, f) for u, c, d, f in [("MW", 0, "power", 1e6), ("mw", 0, "power", 1e-3), ("Nm", 0, "torque", 1.0), ("°C", 0, "temperature", 1.0), ("zz", 0, None, None)]]
    df = spark.createDataFrame([(u,) for u, _, _ in rows], "u string")
    got = [tuple(r) for r in df.select("u", units.dimension(df.u), units.factor(df.u)).collect()]
    assert got == rows
    assert units.unit_table(spark).count() > 90


def test_states(spark):
    j = spark.createDataFrame([(1, 1, "proposed"), (1, 3, "rejected"), (1, 2, "accepted"), (2, 4, "proposed")], "claim_id long, seq long, action string")
    assert {r.claim_id: r.state for r in n.states(j).collect()} == {1: "rejected", 2: "proposed"}


def test_quantities(spark):
    rows = {
        "The torque range is 10 to 20 Nm.": [("10 to 20", "Nm", "torque range")], "Bolts 1 to 6 to 25 Nm torque.": [("25", "Nm", "torque")], "At 3 V supply, the load is off.": [("3", "V", "supply")],
        "Use 5 kg then check the speed.": [("5", "kg", "")], "The pressure and the gap of 2 mm.": [("2", "mm", "gap")], "It weighs 4 apples.": [],
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select("t", units.quantities(df.t).alias("q"), units.split_value(df.t).alias("v")).collect()
    assert {r.t: [(x.value, x.unit, x.quantity) for x in r.q] for r in got} == rows
    assert {r.t: tuple(r.v) for r in got}["It weighs 4 apples."] == ("4", "") and got[0].v.value == "10 to 20"
