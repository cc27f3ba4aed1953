"""Licence scans: whole texts looked up by the digest of their canonical form.

Canonical form: A-Z lower-cased, copyright lines dropped, marks and white space reduced
to single blanks, equivalent spellings made one. Equal digests (SHA-256) are equal
canonical texts, so the scan is one hash join to the known licences, a fixed list whose
size is known; no other row moves. Every text gets its digest, and texts that are not a
known licence as a whole have no licence.

Null text is empty, whose digest is that of the empty string and no licence's. Repeated
rows count each; texts of any length are whole; clashing columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licences import LICENCES, TITLES, full

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns and replacements, in the common syntax of Java's and RE2's
#: expressions. Words stand between single blanks when the spellings are applied.
COPYRIGHT = (r"(^|\n)[ \t#*/;-]*(copyright[ \t]+(\(c\)|©|[0-9<\[{])|\(c\)[ \t]|©|all rights reserved)[^\n]*", "\n")
MARKS = (r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f©‘’“”–—«»•…  ]+", " ")
SPELLINGS = (
    (" (sub)?licence", " ${1}license"),
    (" sub license", " sublicense"),
    (" (organ|author|recogn|util|custom|optim|summar|initial|final|serial|general|normal)is(e|ed|es|ing|ation)", " ${1}iz${2}"),
    (" (col|fav|hon|behavi|lab|neighb|endeav)our", " ${1}or"),
    (" (cent)re ", " ${1}er "),
    (" (acknowledg|judg)ement", " ${1}ment"),
    (" (non) (commercial|infringement|exclusive|transferable)", " ${1}${2}"),
    (" copyright owner", " copyright holder"),
    (" whilst ", " while "),
    (" merchantibility ", " merchantability "),
)


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    out = F.regexp_replace(out, COPYRIGHT[0], COPYRIGHT[1])
    out = F.concat(F.lit(" "), F.regexp_replace(out, *MARKS), F.lit(" "))
    for pattern, by in SPELLINGS:
        out = F.regexp_replace(out, pattern, by.replace("${", "$").replace("}", ""))
    return F.trim(out)


def forms(licences: dict[str, str]) -> list[tuple[str, str]]:
    """(license_id, text) of every form: bare, under each title, and the longer licences with
    and without their appendix."""
    own = [(k, t) for k, v in licences.items() for t in (v, *(f"{title}\n\n{v}" for title in TITLES.get(k, ())))]
    if licences is LICENCES:
        for k, v in full().items():
            body, end, _ = v.partition("END OF TERMS AND CONDITIONS")
            own += [(k, v), (k, body + end), (k, body)]
    return own


def known(docs: DataFrame, licences: dict[str, str]) -> DataFrame:
    """(digest, license_id): at most as many rows as forms, the first name of equal ones."""
    rows = docs.sparkSession.createDataFrame(forms(licences), "license_id string, body string")
    return rows.groupBy(F.sha2(canonical(F.col("body")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licences: dict[str, str] = LICENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, license_id (null if none), is_license of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    out = rows.join(F.broadcast(known(docs, licences)), "digest", "left")
    return out.select(F.col("_id").alias(id_col), "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def oracle(licences: dict[str, str] = LICENCES) -> str:
    """The same rows in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    back = lambda s: s.replace("${", "\\").replace("}", "")
    body = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    body = f"regexp_replace({body}, {quote(COPYRIGHT[0])}, chr(10), 'g')"
    body = f"' ' || regexp_replace({body}, {quote(MARKS[0])}, ' ', 'g') || ' '"
    for pattern, by in SPELLINGS:
        body = f"regexp_replace({body}, {quote(pattern)}, {quote(back(by))}, 'g')"
    digest = f"sha256(trim({body}))"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in dict.fromkeys(forms(licences)))
    return f"""
        WITH licences(license_id, text) AS (VALUES {rows}),
        known AS (SELECT {digest} AS digest, min(license_id) AS license_id FROM licences GROUP BY 1),
        docs AS (SELECT doc_id, {digest} AS digest FROM documents)
        SELECT doc_id, digest, license_id, license_id IS NOT NULL AS is_license FROM docs LEFT JOIN known USING (digest)
    """
