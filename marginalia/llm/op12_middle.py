"""Fill-in-the-middle rewriting with bit-parallel integers.

A text's UTF-8 bytes become big integers, one bit for each byte: `bytes.translate` maps the
bytes of a class to "1" and all others to "0", and the digits are read in base two. Shifted
boolean operations turn class masks into a mask of the places where units start,
`bit_count` counts them, and a unit's place is found by recursive halving: the lower half's
count tells which half holds the wanted bit. Code points are counted with the same masks.

Units are lines (each with its line feed; the last one may lack it), words (a run of
non-blanks with the ASCII blanks after it; leading blanks are a unit) or code points.
A digest of the seed and the id picks two cuts and the form, so a row's result depends on
nothing but itself: lost executors change nothing, and repeated rows get equal results.

Form "psm" is <P>prefix<S>suffix<M>middle, "spm" <S>suffix<P>prefix<M>middle; "plain" is
the text itself: empty texts, texts that hold a marker, and the rest of `rate`. `restored`
takes a text apart again.

Null text is empty (plain, no units). A null id counts as the empty string in the digest.
Very long texts are cut whole: work and memory are linear in their bytes. An empty table
gives no rows. Other columns, of any name, are ignored."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
UNITS = ("line", "word", "char")
#: Percent of texts that are rewritten, and of these the percent in form spm.
SEED, RATE, SPM = 7, 100, 50


def _class(members: bytes) -> bytes:
    return bytes(49 if b in members else 48 for b in range(256))


FEEDS = _class(b"\n")
BLANKS = _class(b" \t\n\x0b\x0c\r")
#: Bytes that start a code point.
LEADS = _class(bytes(b for b in range(256) if not 0x80 <= b < 0xC0))


def mask(raw: bytes, table: bytes) -> int:
    """Bit i is set if byte i is in the class."""
    return int(raw[::-1].translate(table) or b"0", 2)


def starts(raw: bytes, unit: str) -> int:
    """The mask of bytes at which units start."""
    if not raw:
        return 0
    whole = (1 << len(raw)) - 1
    if unit == "line":
        return (mask(raw, FEEDS) << 1 | 1) & whole
    if unit == "word":
        blank = mask(raw, BLANKS)
        return ~blank & (blank << 1) & whole | 1
    if unit == "char":
        return mask(raw, LEADS)
    raise ValueError(f"unknown unit {unit!r}")


def selected(bits: int, rank: int, width: int) -> int:
    """The place of the bit with `rank` set bits before it, by recursive halving."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, width, at, rank = bits >> half, width - half, at + half, rank - n
    return at


def cuts(raw: bytes, unit: str, one: int, two: int) -> tuple[int, int, int]:
    """Units, and the byte places of the two cuts that the numbers pick."""
    begin = starts(raw, unit)
    n = begin.bit_count()
    low, high = sorted((one % (n + 1), two % (n + 1)))
    place = lambda k: selected(begin, k, len(raw)) if k < n else len(raw)
    return n, place(low), place(high)


def numbers(seed: int, ident: str) -> list[int]:
    """The first four 8-digit groups of the hex digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars, output: one row per row of docs."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")

    def make():
        marks = [m.encode() for m in MARKERS]
        p, s, m = marks

        def one(ident: str, text: str) -> tuple:
            raw = text.encode()
            h = numbers(seed, ident)
            n, a, b = cuts(raw, unit, h[0], h[1])
            if not raw or any(x in raw for x in marks) or h[2] % 100 >= rate:
                return n, "plain", None, None, text
            lead = mask(raw, LEADS)
            before = (lead & ((1 << a) - 1)).bit_count()
            between = (lead & ((1 << b) - 1)).bit_count() - before
            prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
            form = "spm" if h[3] % 100 < spm else "psm"
            parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
            return n, form, before, between, b"".join(parts).decode()

        def work(batch: pa.RecordBatch):
            made = [one(i or "", t) for i, t in zip(batch.column(1).to_pylist(), texts(batch), strict=True)]
            cols = zip(*made, strict=True) if made else [[]] * 5
            yield dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), cols, strict=True)) | {"id": batch.column(0)}

        return work

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    out = map_batches(rows, make, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that was rewritten. No marker lies in the text, so the first of each is ours."""
    at = lambda mark: F.locate(mark, output)

    def between(first: Column, then: Column | None = None) -> Column:
        return F.substring(output, first + 3, F.lit(2**31 - 1) if then is None else then - first - 3)

    psm = F.concat(between(at(PREFIX), at(SUFFIX)), between(at(MIDDLE)), between(at(SUFFIX), at(MIDDLE)))
    spm = F.concat(between(at(PREFIX), at(MIDDLE)), between(at(MIDDLE)), between(at(SUFFIX), at(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the rewritten and of the restored text of every row."""
    out = rewritten(docs, id_col, text_col)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
