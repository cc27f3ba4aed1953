"""Recorded passages: what is worth recording, where it stands in texts, and blanking it out.

A passage is found word for word with any white space between its words."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: The fewest words of a passage on record, and the characters kept of it.
LEAST, KEPT = 12, 4000
#: Words of a key by which documents and passages meet; passages, and characters of them, that go out at once.
KEY, BOUND, BYTES = 5, 20_000, 16 << 20


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def record(passages: DataFrame, text_col: str = "text") -> DataFrame:
    """passages worth recording: of twelve words at least, cut to 4000 characters, each text once."""
    d = passages.withColumn(text_col, F.left(flat(F.col(text_col)), F.lit(KEPT)))
    return d.where(F.size(F.split(F.trim(text_col), " ")) >= LEAST).dropDuplicates([text_col])


def parts(passages: DataFrame, limit: int = BOUND) -> Iterator[list[tuple]]:
    """(passage_id, said) in lists of a bounded number and size; one is on the driver at a time."""
    held, size = [], 0
    for row in passages.toLocalIterator():
        if held and (len(held) >= limit or size + len(row[1]) > BYTES):
            yield held
            held, size = [], 0
        held.append(tuple(row))
        size += len(row[1])
    if held:
        yield held


def found(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BOUND) -> DataFrame:
    """(id, passage_id, at, n): the first place of each passage in each document's flat text.

    A passage may start and end inside of a document's words, but what lies between its
    first and last word are whole words: up to five of them are its key, a passage of two
    words or fewer is its own. The keys of one part of the passages are one automaton, and
    a document is searched in its row: nothing is shuffled, and each part is one pass.
    passages: passage_id, text."""
    d = docs.select(F.col(id_col).alias("id"), flat(F.col(text_col)).alias("t"))
    p = passages.select("passage_id", flat(F.col("text")).alias("said")).where("said <> ''").distinct()
    struct = d.select("id").crossJoin(p.select("passage_id").limit(0)).schema  # its types only; never run
    for c in ("at", "n"):
        struct = struct.add(c, "long")
    arrow = to_arrow_schema(struct)

    def scan(part: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys: dict[str, list[int]] = {}
            for k, (_, said) in enumerate(sent.value):
                inner = said.split(" ")[1:-1][:KEY]
                keys.setdefault(" ".join(inner) or said, []).append(k)
            tree = ahocorasick.Automaton()
            for key, own in keys.items():
                tree.add_word(key, own)
            tree.make_automaton()
            for batch in batches:
                row, hit, at = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for k in sorted({k for _, own in tree.iter(text) for k in own}):
                        if (place := text.find(sent.value[k][1])) >= 0:
                            row.append(i)
                            hit.append(k)
                            at.append(place + 1)
                cols = [batch.column(0).take(pa.array(row, pa.int64())), [sent.value[k][0] for k in hit], at, [len(sent.value[k][1]) for k in hit]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        return d.where("t <> ''").mapInArrow(run, struct)

    out = None
    for part in parts(p, limit):
        out = scan(part) if out is None else out.unionByName(scan(part))
    out = docs.sparkSession.createDataFrame([], struct) if out is None else out
    return out.distinct().withColumnRenamed("id", id_col)


def pattern(said: str) -> str:
    """A passage with any white space between its words."""
    return "\\s+".join("".join("\\" + c if c in "\\.^$|()[]{}*+?-" else c for c in w) for w in said.split())


def blanked(text: Column, said: list[str]) -> Column:
    """text with every occurrence of the passages as blanks of the same length; newlines stay."""
    for one in said:
        text = _blanked(text, pattern(one))
    return text


def _blanked(text: Column, rx: str) -> Column:
    pieces, hits = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    blank = F.transform(hits, lambda h: F.regexp_replace(h, "[^\\n]", " "))
    whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(blank, i), F.lit("")))), "")
    return F.when(text.rlike(rx), whole).otherwise(text)
