"""Queries for the checks of handbooks, novels and songs, and for the continuity sweep.

The manuscripts are derived from `documents`, one for each row: what is wrong in them follows
from the row's id k and length n, so that SQL can say which findings must come out and which
must not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from . import runner
from .leaf import leaf


def _joined(*parts: str) -> str:
    """SQL expressions of paragraphs, with an empty line between; Spark and DuckDB both read them."""
    return " || chr(10) || chr(10) || ".join(parts)


def _chapter(i: int, text: str) -> str:
    return _joined(f"'# Chapter {i}'", text)


#: A handbook: an acronym with or without its expansion, two spellings, duties, a term without a definition, a long step.
HANDBOOK = _joined(
    "'# 1 Fitting'",
    "CASE k % 3 WHEN 0 THEN 'The ECU is here and the ECU there.' WHEN 1 THEN 'The Engine Control Unit (ECU) is here and the ECU there.' ELSE 'The ECU is here. There stands the Engine Control Unit (ECU).' END",
    "'Use the Wi-Fi set. The ' || CASE WHEN n % 3 = 0 THEN 'WiFi' ELSE 'Wi-Fi' END || ' set is off. Some Wi-Fi is on.'",
    "repeat('Shall it go? ', CAST(2 + n % 2 AS INT)) || repeat('Must it stay? ', CAST(3 + k % 2 AS INT))",
    "CASE WHEN k % 4 = 0 THEN 'Look at the lid bolts.' ELSE 'Look at it.' END || CASE WHEN k % 8 = 0 THEN ' Lid bolts are defined as what holds a lid.' ELSE '' END",
    "'1. Turn ' || repeat('on ', CAST(25 + n % 18 AS INT)) || 'it.' || chr(10) || '2. Stop.'",
    "'# 2 Care'",
    "'Wipe it.'",
)

_WIND = "The wind blew over the hill and down again to the sea. "
#: A novel of thirteen chapters: long and short ones, one that is all talk, two heads in a scene, a person who goes.
NOVEL = _joined(
    _chapter(1, "repeat('The rain fell on the roof and Tom thought it was fine. ' || CASE WHEN k % 2 = 0 THEN 'He knew it well. Tom felt cold. He wondered why. ' ELSE 'It went well. The roof was cold. Nobody asked why. ' END, 9)"),
    _chapter(2, f"repeat('{_WIND}', 15)"),
    _chapter(3, f"repeat('{_WIND}', CASE WHEN k % 3 = 0 THEN 40 ELSE 15 END)"),
    *[_chapter(i, f"repeat('{_WIND}', 15)") for i in range(4, 12)],
    _chapter(12, "repeat('\"Go now,\" Bob ' || CASE WHEN n % 5 = 0 THEN 'said' ELSE 'hissed' END || ' loudly. ', CAST(20 + k % 15 AS INT))"),
    _chapter(13, f"CASE WHEN n % 3 = 0 THEN repeat('{_WIND}', 15) ELSE 'Short one.' END || CASE WHEN n % 2 = 0 THEN ' There came Tom.' ELSE '' END"),
)

#: A tale: a day that may be told in two ways, people who may stay away to the end, a form of a name.
TALE = _joined(
    _chapter(1, "'In came Alexander with Mira. So Mira saw Alexander. The wedding was on ' || CASE WHEN k % 2 = 0 THEN 'Tuesday' ELSE 'Friday' END || '.'"),
    _chapter(2, "'Here Mira met Alexander again.' || CASE WHEN k % 3 = 0 THEN ' There Sasha ran, then Sasha sat, now Sasha slept.' ELSE '' END"),
    *[_chapter(i, f"'{_WIND.strip()}'") for i in range(3, 12)],
    _chapter(12, "CASE WHEN n % 3 = 0 THEN 'Then Alexander came back.' ELSE 'Then all was still.' END || ' The wedding was on ' || CASE WHEN n % 2 = 0 THEN 'Tuesday' ELSE 'Friday' END || '.'"),
)

_LF = " || chr(10) || "
#: A song: a misspelt tag, one with two singers or without a voice, a refrain that drifts, a line that is too long, a word in capitals.
SONG = _LF.join(
    [
        "'# A song'", "''", "'> style'", "CASE WHEN k % 2 = 0 THEN '[Vrese 1]' WHEN n % 4 = 0 THEN '[Verse 1: Ann]' WHEN n % 4 = 1 THEN '[Verse 1: Ann and Tom]' WHEN n % 4 = 2 THEN '[Verse 1: Ann, warm alto]' ELSE '[Verse 1]' END", "'One line of words here now'", "'Another line of words here now'",
        "CASE WHEN k % 3 = 0 THEN 'The third line is such a very much longer line than any of the other lines were' ELSE 'A third line of words here' END", "'A last line of words here'", "''",
        "'[Chorus]'", "'Love above the line'", "'All of it is mine'", "''", "'[Chorus]'", "'Love above the line'", "CASE WHEN n % 2 = 0 THEN 'All of it was mine' ELSE 'All of it is mine' END", "''",
        "'[Chorus]'", "'Love above the line'", "'All of it is mine'", "CASE WHEN n % 3 = 0 THEN 'HELLO there' ELSE 'Hello there' END", "''",
    ]
)


def derived(spark, sf_dir: str, text: str, **more) -> runner.Context:
    """A manuscript of one file for every document, made of its id and length."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("k"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    files = leaf(d.select(F.col("k").cast("string").alias("ms"), F.lit("text.md").alias("rel"), F.lit(0).alias("file_order"), F.expr(text).alias("text")))
    return runner.context(files, files=files, **more)


def _found(findings: DataFrame) -> DataFrame:
    return findings.select(F.col("ms").cast("long").alias("doc_id"), "check", "severity", "title")


def _checked(ctx: runner.Context, *only: str) -> DataFrame:
    report = runner.run(ctx, only=only, quotes=False)
    if report.failed:
        raise RuntimeError("; ".join(f"{name}: {why}" for name, why in report.failed.items()))
    return _found(report.findings)


def handbook_checks(spark, sf_dir):
    """Acronyms, terms, definitions, duties and long steps of the handbooks."""
    ctx = derived(spark, sf_dir, HANDBOOK, terms=["lid bolts"], common=(*L.STOPWORDS, "use"))
    return _checked(ctx, "acronyms", "terminology", "definitions", "register", "long_steps")


def fiction_checks(spark, sf_dir):
    """Pacing, dialogue, its tags, heads and presence in the novels."""
    ctx = derived(spark, sf_dir, NOVEL, type="fiction", cast=["Mira", "Tom"])
    return _checked(ctx, "pacing", "dialogue", "dialogue_tags", "pov", "presence")


def song_checks(spark, sf_dir):
    """Line lengths, refrains and the format of the songs."""
    return _checked(derived(spark, sf_dir, SONG, type="lyrics", cast=["Ann", "Tom"]), "lyric_lines", "refrain", "suno")


def continuity_sweep(spark, sf_dir):
    """Contradictions, dropped threads and names that may be one in the tales."""
    return _found(runner.sweep(derived(spark, sf_dir, TALE, type="fiction")))


QUERIES = {"handbook_checks": handbook_checks, "fiction_checks": fiction_checks, "song_checks": song_checks, "continuity_sweep": continuity_sweep}

_D = "WITH d AS (SELECT doc_id, doc_id AS k, coalesce(n_chars, 0) AS n FROM documents)"


def _cases(*cases: tuple[str, str, str, str]) -> str:
    """(check, severity, title, condition) of each finding that must come out."""
    rows = [f"""SELECT doc_id, '{c}' AS "check", {s} AS severity, {t} AS title FROM d WHERE {w}""" for c, s, t, w in cases]
    return _D + " " + " UNION ALL ".join(rows)


ORACLES = {
    "handbook_checks": _cases(
        ("acronyms", "'warn'", "'ECU: never expanded'", "k % 3 = 0"),
        ("acronyms", "'warn'", "'ECU: expanded late'", "k % 3 = 2"),
        ("terminology", "'warn'", "'One term in 2 spellings: wi-fi, wifi'", "n % 3 = 0"),
        ("definitions", "'warn'", "'lid bolts: never defined'", "k % 8 = 4"),
        ("register", "'warn'", "'Duties are put with “shall” ×3 and with “must” ×' || (3 + k % 2)", "n % 2 = 1"),
        ("long_steps", "CASE WHEN n % 18 + 27 >= 40 THEN 'defect' ELSE 'warn' END", "'Step 1 has a sentence of ' || (27 + n % 18) || ' words'", "n % 18 + 27 >= 30"),
    ),
    "fiction_checks": _cases(
        ("pacing", "'note'", "'Chapter 3 is long'", "k % 3 = 0"),
        ("pacing", "'note'", "'Chapter 13 is short'", "n % 3 <> 0"),
        ("dialogue", "'note'", "'Chapter 12: much more dialogue than in all'", "true"),
        ("dialogue_tags", "'note'", "'Tag verbs used often: hissed'", "n % 5 <> 0"),
        ("dialogue_tags", "'warn'", "'Adverbs at ' || (20 + k % 15) || ' dialogue tags'", "true"),
        ("pov", "'warn'", "'Heads: he, tom'", "k % 2 = 0"),
        ("presence", "'warn'", "'Tom is gone after chapter 1'", "k % 2 = 0 AND n % 2 = 1"),
        ("presence", "'note'", "'Tom is away for long; last in chapter 13'", "n % 2 = 0"),
    ),
    "song_checks": _cases(
        ("lyric_lines", "'note'", "'“The third line is such a very much longer line than any of the other lines were” has 21 syllables'", "k % 3 = 0"),
        ("refrain", "'warn'", "'“All of it was mine” where others sing “all of it is mine”'", "n % 2 = 0"),
        ("suno", "'warn'", "'“vrese” may be meant as verse'", "k % 2 = 0"),
        ("suno", "'warn'", "'A tag names Ann and no voice: Verse 1: Ann'", "k % 2 = 1 AND n % 4 = 0"),
        ("suno", "'warn'", "'More than one voice in a tag: Verse 1: Ann and Tom'", "k % 2 = 1 AND n % 4 = 1"),
        ("suno", "'warn'", "'In capitals: HELLO'", "n % 3 = 0"),
    ),
    "continuity_sweep": _cases(
        ("contradiction", "'defect'", "'Wedding: ' || CASE k % 2 WHEN 0 THEN 'tuesday' ELSE 'friday' END || ', elsewhere ' || CASE n % 2 WHEN 0 THEN 'tuesday' ELSE 'friday' END", "k % 2 <> n % 2"),
        ("dropped_thread", "'warn'", "'“Mira” comes in, goes on, and is not heard of again'", "true"),
        ("dropped_thread", "'warn'", "'“Alexander” comes in, goes on, and is not heard of again'", "n % 3 <> 0"),
        ("name_drift", "'warn'", "'May be one: “Alexander”, “Sasha” (a diminutive on the list)'", "k % 3 = 0"),
    ),
}
