"""Where terms stand: all terms of a manuscript in one pass over each of its texts.

The terms of a manuscript make one automaton of their characters, kept by the worker for
the texts that follow; a text is read once, whatever the number of terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def lowered(text: str) -> str:
    """Lower case, one character for each: places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text), strict=True))


class Finder:
    """Whole-word places of terms, in either case; of one term, from left to right without overlap."""

    def __init__(self, names: Sequence[str]):
        import ahocorasick

        self.by_form: dict[str, list[str]] = {}
        for name in names:
            if form := lowered(name.strip()):
                self.by_form.setdefault(form, []).append(name)
        self.automaton = ahocorasick.Automaton()
        for form in self.by_form:
            self.automaton.add_word(form, form)
        if self.by_form:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int]]:
        if not self.by_form:
            return []
        own = lambda c: c.isalnum() or c == "_"
        low, found, free = lowered(text), [], dict.fromkeys(self.by_form, 0)
        for last, form in self.automaton.iter(low):
            a, b = last + 1 - len(form), last + 1
            if a < free[form] or a and own(text[a - 1]) or b < len(text) and own(text[b]):
                continue
            free[form] = b
            found += [(name, a, b) for name in self.by_form[form]]
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def found(texts: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """texts without their text, with term, from, to: a row for each place of a term.

    names: ms, name; the few terms of each manuscript go to its texts as one array, which
    is one join on ms. A place is in code points from the text's start."""
    each = names.groupBy("ms").agg(F.sort_array(F.collect_set("name")).alias("_names"))
    return _places(texts.where(F.length(text) > 0).join(each, "ms"), [c for c in texts.columns if c != text], text)


def found_all(texts: DataFrame, names: Sequence[str], text: str = "text") -> DataFrame:
    """`found` with one list of terms for all manuscripts, which goes to the texts with the plan."""
    listed = sorted({n for n in names if n.strip()})
    rows = texts.where((F.length(text) > 0) & F.lit(bool(listed)))
    if all(map(str.isascii, listed)):
        # Texts of ASCII alone that have none of the terms need not be looked through.
        some = [F.contains(F.lower(text), F.lit(n.strip().lower())) for n in listed]
        rows = rows.where(reduce(lambda a, b: a | b, some, F.octet_length(text) != F.char_length(text)))
    return _places(rows.withColumn("_names", F.array(*map(F.lit, listed)).cast("array<string>")), [c for c in texts.columns if c != text], text)


def _places(rows: DataFrame, kept: list[str], text: str) -> DataFrame:
    """The places of a row's `_names` in its text."""
    struct = rows.select(*kept, F.lit("").alias("term"), F.lit(0).alias("from"), F.lit(0).alias("to")).schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Finder] = {}
        for batch in batches:
            row, term, start, end = [], [], [], []
            for i, (said, own) in enumerate(zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True)):
                own = tuple(own)
                if own not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[own] = Finder(own)
                for name, a, b in known[own].find(said):
                    row.append(i)
                    term.append(name)
                    start.append(a)
                    end.append(b)
            at = pa.array(row, pa.int64())
            cols = [batch.column(i).take(at).cast(arrow.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(term, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=arrow)

    return rows.select(*kept, text, "_names").mapInArrow(run, struct)


def of_all(texts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(ms, name): one list of terms for every manuscript of texts."""
    listed = texts.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    return texts.select("ms").distinct().join(F.broadcast(listed))  # a project's list
