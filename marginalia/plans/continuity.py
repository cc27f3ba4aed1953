"""Queries for evidence, terms, clashing values, names, references and the checks of manuals.

The manuals are derived from `documents`: each row gives a small manuscript whose numbers,
steps, references and quantities follow from its id and length, so that SQL can say which
findings must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evidence, narrative, structure, terms, units
from . import runner
from .language import token_sql
from .leaf import leaf


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence_quotes(spark, sf_dir):
    """The sentence around every number of three digits or more."""
    out = evidence.around(_read(spark, sf_dir, "documents"), ["doc_id"], f"[^\\s{S.LETTER}.!?…]*\\d{{3}}[^\\s{S.LETTER}.!?…]*", "\\d{3}")
    return out.select("doc_id", F.col("at").cast("long").alias("start"), "quote")


def term_mentions(spark, sf_dir):
    """The words of seven letters and more that benchmark items start with, in all documents: uses and first places."""
    word = F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1))
    names = _read(spark, sf_dir, "benchmark").select(F.lit("").alias("ms"), word.alias("name")).where(F.length("name") >= 7).distinct()
    docs = _read(spark, sf_dir, "documents").select(F.lit("").alias("ms"), "doc_id", "text")
    out = terms.found(docs, names)
    return out.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("from").cast("long").alias("first"))


def value_clashes(spark, sf_dir):
    """Customers whose orders state weights that can't both hold: odd orders in kilograms, even ones in grams."""
    o = _read(spark, sf_dir, "orders")
    kilo = F.col("o_orderkey") % 2 == 1
    value = F.when(kilo, F.floor(F.col("o_totalprice") / 1000)).otherwise(F.floor("o_totalprice")).cast("string")
    rows = o.select("o_custkey", value.alias("value"), F.when(kilo, "kg").otherwise("g").alias("unit"))
    return units.conflicts(rows, ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("clashes"), F.sum(F.col("a_uses") * F.col("b_uses")).alias("uses"))


def name_groups(spark, sf_dir):
    """Names of each source's documents that may be one: groups of the source's cast."""
    d = _read(spark, sf_dir, "documents").where("lang = 'en'")
    p = d.select(F.col("source").alias("ms"), F.col("doc_id").cast("string").alias("rel"), F.lit("").alias("section_id"), F.lit(0).alias("ord"), F.lit(0).alias("start"), F.coalesce("text", F.lit("")).alias("text"))
    out = narrative.name_groups(leaf(narrative.cast(p)))
    return out.select(F.col("ms").alias("source"), "name", "forms", "uses", "reason")


#: The parts of a derived manual, with its number k and the length n of its document.
def _manual(k: str, n: str) -> str:
    """As one SQL expression that Spark and DuckDB both read; a line feed is chr(10)."""
    lines = (
        "# 1 Fitting", "", f"The torque for the lid bolts is ' || (40 + {k} % 3) || ' Nm. See Section ' || (1 + {k} % 4) || '. Read [this](#2-care) and [that](#no-' || {k} || ').", "",
        f"The pump pressure is ' || (2 + {n} % 2) || ' bar to ' || (3 + {n} % 2) || ' bar.", "",
        "1. Undo it.", "2. Lift it.", f"' || (3 + {k} % 2) || '. Turn it.", "",
        "# 2 Care", "", f"Tighten the lid bolts to ' || (40 + {n} % 3) || ' Nm. A pressure of ' || (200 + 100 * ({k} % 3)) || ' kPa applies to the pump. See Figure ' || (1 + {k} % 2) || '.", "",
        "Figure 1: The pump.",
    )
    return "'" + "' || chr(10) || '".join(lines) + "'"


def manuals(spark, sf_dir) -> runner.Context:
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ms"), F.lit("manual.md").alias("rel"), F.lit(0).alias("file_order"), F.expr(_manual("doc_id", "n_chars")).alias("text"))
    files = leaf(d)
    return runner.context(files, files=files)


def manual_checks(spark, sf_dir):
    """Steps, references, links and quantities of the manuals, with the sentences they stand in."""
    report = runner.run(manuals(spark, sf_dir), only=["steps", "xrefs", "units"])
    if report.failed:
        raise RuntimeError("; ".join(f"{name}: {why}" for name, why in report.failed.items()))
    return report.findings.select(F.col("ms").cast("long").alias("doc_id"), "check", "severity", "title", F.coalesce("quote", F.lit("")).alias("quote"))


def _claims(ctx: runner.Context, read) -> DataFrame:
    """What read() finds in the paragraphs. The order of sections is looked up for that, so no text is shuffled."""
    p = structure.paragraphs(ctx.located).select("ms", "rel", "section_id", F.lit(0).alias("ord"), "start", F.col("prose").alias("text"))
    return read(p).drop("ord").join(ctx.sections.select(F.col("id").alias("section_id"), "ord"), "section_id")


def manual_claims(spark, sf_dir):
    """What the manuals measure, of what."""
    c = _claims(manuals(spark, sf_dir), narrative.numeric_claims)
    return c.select(F.col("ms").cast("long").alias("doc_id"), "ord", "subject", "predicate", "value", "unit")


def manual_contradictions(spark, sf_dir):
    """The claims of the manuals that can't both hold."""
    c = leaf(_claims(manuals(spark, sf_dir), narrative.claims))
    p = narrative.contradictions(c)
    return p.select(F.col("ms").cast("long").alias("doc_id"), "key", "a_value", F.col("a_u").alias("a_unit"), "b_value", F.col("b_u").alias("b_unit"), F.col("a_mentions").cast("long").alias("a_mentions"), "certain")


QUERIES = {
    "evidence_quotes": evidence_quotes, "term_mentions": term_mentions, "value_clashes": value_clashes, "name_groups": name_groups,
    "manual_checks": manual_checks, "manual_claims": manual_claims, "manual_contradictions": manual_contradictions,
}

ORACLES = {
    "evidence_quotes": f"""
        WITH {token_sql()}, spot AS (SELECT *, CAST(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) - length(t) AS BIGINT) AS start FROM numbered)
        SELECT spot.doc_id, spot.start, regexp_replace(sent.body, '\\s+', ' ', 'g') AS quote FROM spot JOIN sent USING (doc_id, sid) WHERE regexp_matches(spot.t, '^[^\\s{S.LETTER}.!?…]*[0-9]{{3}}')""",
    "term_mentions": """
        WITH b AS (SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS term FROM benchmark), names AS (FROM b WHERE length(term) >= 7),
        d AS (SELECT doc_id, regexp_split_to_array(text, '[\\p{L}\\p{N}_]+') AS gaps, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS words FROM documents),
        w AS (SELECT doc_id, unnest(words) AS word, unnest(gaps[1 : len(words)]) AS gap, generate_subscripts(words, 1) AS k FROM d WHERE len(words) > 0),
        s AS (SELECT doc_id, lower(word) AS term, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY k) - length(word) AS BIGINT) AS start FROM w)
        SELECT doc_id, term, count(*) AS n, min(start) AS first FROM s JOIN names USING (term) GROUP BY 1, 2""",
    "value_clashes": """
        WITH v AS (SELECT o_custkey, o_orderkey % 2 = 1 AS kilo, CASE WHEN o_orderkey % 2 = 1 THEN floor(o_totalprice / 1000) ELSE floor(o_totalprice) END AS x FROM orders),
        d AS (SELECT o_custkey, kilo, x, count(*) AS uses, CASE WHEN kilo THEN x * 1000 ELSE x END AS g, CASE WHEN kilo THEN 500 ELSE 0.5 END AS h FROM v GROUP BY 1, 2, 3),
        p AS (SELECT a.o_custkey, a.uses * b.uses AS uses FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND (a.g, a.kilo) < (b.g, b.kilo)
              WHERE CASE WHEN a.kilo = b.kilo THEN a.x <> b.x ELSE abs(a.g - b.g) > a.h + b.h END)
        SELECT o_custkey, count(*) AS clashes, CAST(sum(uses) AS BIGINT) AS uses FROM p GROUP BY 1""",
    "manual_claims": """
        WITH d AS (SELECT doc_id, doc_id AS k, n_chars AS n FROM documents)
        SELECT doc_id, 0 AS ord, 'lid bolts' AS subject, 'torque' AS predicate, CAST(40 + k % 3 AS VARCHAR) AS value, 'Nm' AS unit FROM d
        UNION ALL SELECT doc_id, 0, 'pump', 'pressure', (2 + n % 2) || '–' || (3 + n % 2), 'bar' FROM d
        UNION ALL SELECT doc_id, 1, 'lid bolts', 'torque', CAST(40 + n % 3 AS VARCHAR), 'Nm' FROM d
        UNION ALL SELECT doc_id, 1, 'pump', 'pressure', CAST(200 + 100 * (k % 3) AS VARCHAR), 'kPa' FROM d""",
    "manual_contradictions": """
        WITH d AS (SELECT doc_id, doc_id AS k, n_chars AS n FROM documents)
        SELECT doc_id, 'lid bolts|torque' AS key, CAST(40 + k % 3 AS VARCHAR) AS a_value, 'Nm' AS a_unit, CAST(40 + n % 3 AS VARCHAR) AS b_value, 'Nm' AS b_unit, CAST(1 AS BIGINT) AS a_mentions, true AS certain FROM d WHERE k % 3 <> n % 3
        UNION ALL SELECT doc_id, 'pump|pressure', (2 + n % 2) || '–' || (3 + n % 2), 'bar', CAST(200 + 100 * (k % 3) AS VARCHAR), 'kPa', 1, true FROM d
                  WHERE 200 + 100 * (k % 3) + 0.5 < 100 * (1.5 + n % 2) OR 200 + 100 * (k % 3) - 0.5 > 100 * (3.5 + n % 2)""",
    "manual_checks": """
        WITH d AS (SELECT doc_id, doc_id AS k, n_chars AS n FROM documents)
        SELECT doc_id, 'steps' AS "check", 'defect' AS severity, 'Steps of manual.md: missing 3' AS title, '' AS quote FROM d WHERE k % 2 = 1
        UNION ALL SELECT doc_id, 'xrefs', 'defect', 'No section ' || (1 + k % 4), 'See Section ' || (1 + k % 4) || '.' FROM d WHERE k % 4 >= 2
        UNION ALL SELECT doc_id, 'xrefs', 'defect', 'No figure 2', 'See Figure 2.' FROM d WHERE k % 2 = 1
        UNION ALL SELECT doc_id, 'xrefs', 'defect', 'No anchor #no-' || k, 'Read this and that .' FROM d
        UNION ALL SELECT doc_id, 'units', 'defect', '“lid bolts torque” has 2 values that clash: ' || least(40 + k % 3, 40 + n % 3) || ' Nm, ' || greatest(40 + k % 3, 40 + n % 3) || ' Nm', '' FROM d WHERE k % 3 <> n % 3
        UNION ALL SELECT doc_id, 'units', 'defect', '“pump pressure” has 2 values that clash: ' || list_aggregate(list_sort([(2 + n % 2) || '–' || (3 + n % 2) || ' bar', (200 + 100 * (k % 3)) || ' kPa']), 'string_agg', ', '), '' FROM d
                  WHERE 200 + 100 * (k % 3) + 0.5 < 100 * (1.5 + n % 2) OR 200 + 100 * (k % 3) - 0.5 > 100 * (3.5 + n % 2)""",
}
