"""Checks and lyrics on small manuscripts."""

import pytest

from marginalia.operators import checks, lyrics
from marginalia.operators import structure as st

A = """# One

The Anti Lock Unit (ALU) is here. The ALU works and the ECU too. Then ECU again. XYZ was XYZ (xenial yellow zone).

- **Lid bolt**: a bolt that holds the lid.

1. Undo the long bolt and then turn it around and around and around and around and around and around and around until it is out of the seat and free of all the dirt that fell.
2. Lift.

"Go," said Ann. "Stay," muttered Bob. Never use very nice words. The seal ring is round. Use the lid bolt. It is 5 kPa or 6 kpa, 7 kPa or 8 kpa.
"""
B = "# Two\n\n" + "Ann thought it was fine. Ann felt cold. He knew it. He wondered. " * 14 + "\n"
C = "# Three\n\nshort one.\n"
D = "# Four\n\n" + "plain words go on here and there. " * 12 + "\n"


@pytest.fixture(scope="module")
def spine(spark):
    files = spark.createDataFrame([("a.md", 0, A), ("b.md", 1, B), ("c.md", 2, C), ("d.md", 3, D)], "rel string, file_order int, text string")
    blocks = st.blocks(files).cache()
    sec = st.sections(blocks).cache()
    return st.located(blocks, sec).cache(), sec


def test_technical(spark, spine):
    loc, sec = spine
    got = {r.acronym: (r.uses, r.state) for r in checks.acronyms(loc).collect()}
    assert got == {"ECU": (2, "never expanded"), "XYZ": (2, "expanded late")}
    assert {r.key for r in checks.definitions(loc).collect()} == {"lidbolt"}
    assert {(r.term, r.state) for r in checks.undefined_terms(loc, ["lid bolt", "seal ring", "not there"]).collect()} == {("seal ring", "never defined")}
    assert [(r.number, r.severity) for r in checks.long_steps(loc).collect()] == [(1, "warn")]
    assert [(r.units, r.uses) for r in checks.unit_spellings(loc).collect()] == [(["kPa", "kpa"], 4)]


def test_fiction(spark, spine):
    loc, sec = spine
    assert ("c.md#1", "short") in {(r.root, r.kind) for r in checks.pacing(sec).collect()}
    assert [(r.section_id, r.holders) for r in checks.points_of_view(loc, ["Ann"]).collect()] == [("b.md#1", ["ann", "he"])]
    tags = checks.dialogue_tags(loc, 2)
    assert {("said", True), ("muttered", False)} <= {(r.verb, r.plain) for r in tags.collect()}
    assert {(r.name, r.chapter, r.n) for r in checks.mentions(loc, sec, ["Ann", "Bob"]).collect()} == {("Ann", 0, 1), ("Bob", 0, 1), ("Ann", 1, 28)}


def test_rules(spark, spine):
    loc, _ = spine
    rules = spark.createDataFrame([("nice", checks.phrase("very nice"), "prose", "*", False), ("head", "one", "headings", "a.*", False), ("case", "ann", "prose", None, True), ("step", "lift", "steps", "*", False)], "id string, pattern string, scope string, files string, cased boolean")
    got = {(r.id, r.said, r.total) for r in checks.rules(loc, rules).collect()}
    assert got == {("nice", "very nice", 1), ("head", "One", 1), ("step", "Lift", 1)}
    many = spark.createDataFrame([("ann", "ann", "prose", "*", False)], "id string, pattern string, scope string, files string, cased boolean")
    rows = checks.rules(loc, many, limit=5).collect()
    assert len(rows) == 5 and rows[0].total == 29


def test_read_aloud(spark, spine):
    loc, _ = spine
    rows = checks.read_aloud(st.paragraphs(loc), 100).where("section_id = 'b.md#1'").orderBy("passage").collect()
    assert all(len(r.text) <= 100 for r in rows) and " ".join(r.text for r in rows) == B.split("\n\n")[1].strip()


SONG = """[Verse 1]
The day is bright and clear
I walk away my dear
Nobody ever can hear
The wind is near

[Chorus]
Love above the line
All of it is mine
(ooh)

[Verse 2: low]
Some other words appear

[Chorus x2]
Love above the line
All of it was mine

[Chorus]
Love above the line
All of it is mine
HELLO IV
"""


def test_lyrics(spark):
    ln = lyrics.lines(spark.createDataFrame([("s", SONG)], "song string, text string")).cache()
    rows = ln.orderBy("line_no").collect()
    assert [r.tag for r in rows] == ["verse"] * 4 + ["chorus"] * 2 + ["verse"] + ["chorus"] * 5
    assert all(r.text != "(ooh)" for r in rows)
    assert [(r.text, r.usual) for r in lyrics.drifted_refrains(ln).collect()] == [("All of it was mine", "all of it is mine")]
    key = lambda s: spark.createDataFrame([(x,) for x in s], "t string").select(lyrics.rhyme_key(lyrics.F.col("t")).alias("k")).collect()
    assert [r.k for r in key(["night", "the rain", "day", "river", "above", "love", "fire", "desire", "", "x"])] == ["ight", "ain", "ay", "er", "ove", "ove", "ire", "ire", "", "x"]
    sch = lyrics.schemes(ln).orderBy("stanza").collect()
    assert [r.scheme for r in sch][:2] == ["AAAA", "AA"]
    assert [r.words for r in lyrics.shouted(ln).collect()] == [["HELLO"]]
    assert lyrics.misaligned(ln).count() == 0
    assert lyrics.uneven_lines(ln).count() >= 0
    assert lyrics.odd_schemes(lyrics.schemes(ln)).count() == 0


def test_song_tags(spark):
    text = "> a style\n[Vrese 1]\n[Chorus: Mara, dark tenor]\nline (echo) one\n[Bridge: Mara over a bass drop]\n[Verse: Tom and Mara]\n[Outro: Ann, soprano]\nend"
    songs = spark.createDataFrame([("s", text)], "song string, text string")
    cast, record = ["Mara", "Tom", "Ann"], {"mara": "low baritenor", "Ann": "bass voice"}
    got = {(r.inner[:6], r.name, r.severity) for r in lyrics.broken_voices(songs, cast, record).collect()}
    assert got == {("Bridge", "Mara", "warn"), ("Verse:", "Tom", "note"), ("Verse:", "Mara", "warn"), ("Outro:", "Ann", "defect")}
    assert [(r.tag, r.guess) for r in lyrics.misspelt_tags(songs).collect()] == [("vrese", "verse")]
    tagged = spark.createDataFrame([("t", "[Verse: Ann sings]\n[Ann, bright soprano]\n[Tom and Ann]\n[Outro: a duet]\n[Verse: Tom]")], "song string, text string")
    assert [(r.line_no, r.name) for r in lyrics.unvoiced(tagged, ["Tom", "Ann"], {"tom": "bass"}).collect()] == [(0, "Ann")]
    assert [r.line_no for r in lyrics.two_voices(tagged, ["Tom", "Ann"]).orderBy("line_no").collect()] == [2, 3]
    limits = spark.createDataFrame([("t", "Before it.\n> soft\n[Verse]\nla la\n\nla (la) la"), ("u", "")], "song string, text string")
    assert [(r.song, r.body, r.style, r.brackets) for r in lyrics.format_limits(limits).orderBy("song").collect()] == [("t", 26, 4, 1), ("u", 0, 0, 0)]
    r = lyrics.format_limits(songs, body=20, style=3).first()
    assert r.long_body and r.long_style and r.brackets == 1
    assert {tuple(r.singers) for r in lyrics.sung_by(songs, cast).collect() if len(r.singers) > 1} == {("Mara", "Tom")}
