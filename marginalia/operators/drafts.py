"""Comparing drafts sentence by sentence, versions, and packing text into a token budget."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

HUNKS = "rel string, hunk int, op string, old array<string>, new array<string>, old_start int, new_start int"


def _parts(text: str) -> list[str]:
    """Sentences with the white space after them, so that joined parts are the text."""
    return re.findall(r"[^.!?…\n]*(?:[.!?…]+[\"'”’)\]]*\s*|\n\s*|$)", text)[:-1] if text else []


def hunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edit script of each file (rel, text) from old to new; files of one side are whole hunks.

    A file's two texts meet in one row by a join on its name; the edit script is made there."""
    both = old.select("rel", F.col("text").alias("a")).join(new.select("rel", F.col("text").alias("b")), "rel", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    names = [c.split()[0] for c in HUNKS.split(", ")]
    schema = pa.schema([("rel", pa.string()), ("hunk", pa.int32()), ("op", pa.string()), ("old", pa.list_(pa.string())), ("new", pa.list_(pa.string())), ("old_start", pa.int32()), ("new_start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rel, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = _parts(a or ""), _parts(b or "")
                flat = lambda parts: [" ".join(p.split()) for p in parts]
                for i, (op, i1, i2, j1, j2) in enumerate(c for c in difflib.SequenceMatcher(None, flat(x), flat(y), autojunk=False).get_opcodes() if c[0] != "equal" or x[c[1] : c[2]] != y[c[3] : c[4]]):
                    rows.append((rel, i, op if op != "equal" else "space", x[i1:i2], y[j1:j2], i1, j1))
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)}, schema=schema)

    return both.mapInArrow(run, HUNKS)


def apply(old: DataFrame, hunks_: DataFrame) -> DataFrame:
    """(rel, text): old with the given hunks applied; all of them give the new draft, none the old."""
    of_file = hunks_.groupBy("rel").agg(F.sort_array(F.collect_list(F.struct("old_start", "hunk", F.size("old").alias("n"), "new"))).alias("h"))
    rows = old.select("rel", "text").join(of_file, "rel", "full_outer").select("rel", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("h", F.array().cast("array<struct<old_start:int,hunk:int,n:int,new:array<string>>>")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rel, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, at, said = _parts(text), 0, []
                for h in own:
                    said += [*parts[at : h["old_start"]], *h["new"]]
                    at = h["old_start"] + h["n"]
                out.append((rel, "".join([*said, *parts[at:]])))
            yield pa.RecordBatch.from_pydict({"rel": [r for r, _ in out], "text": [t for _, t in out]}, schema=pa.schema([("rel", pa.string()), ("text", pa.string())]))

    return rows.mapInArrow(run, "rel string, text string")


def save_version(files: DataFrame, path: str, version: str) -> None:
    """A draft as one partition of the versions table; written as a whole or not at all."""
    files.withColumn("version_id", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)


def load_version(spark, path: str, version: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("version_id") == version).drop("version_id")


def versions(spark, path: str) -> list[str]:
    return sorted(r[0] for r in spark.read.parquet(path).select("version_id").distinct().collect())


def restore_version(spark, path: str, version: str, now: DataFrame, confirm: bool = False) -> DataFrame:
    """The files of a draft, after the present ones were saved as the version "before <it>".
    Without confirmation nothing is written and nothing returned."""
    if not confirm:
        raise ValueError("restoring replaces the present files: confirm=True")
    if version not in versions(spark, path):
        raise ValueError(f"no version {version}")
    save_version(now, path, f"before {version}")
    return load_version(spark, path, version)


def rename_version(spark, path: str, version: str, name: str) -> None:
    """A draft under another name; an existing name is refused."""
    if name in versions(spark, path):
        raise ValueError(f"{name} is taken")
    save_version(load_version(spark, path, version), path, name)
    delete_version(spark, path, version)


def delete_version(spark, path: str, version: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path, "version_id=" + jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(version))
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True):
        raise ValueError(f"no version {version}")


INLINE = "rel string, hunk int, parts array<struct<op:string,text:string>>"


def inline(hunks_: DataFrame) -> DataFrame:
    """Of each replaced hunk the words that stayed, went and came: (rel, hunk, parts)."""
    part = pa.struct([("op", pa.string()), ("text", pa.string())])
    schema = pa.schema([("rel", pa.string()), ("hunk", pa.int32()), ("parts", pa.list_(part))])

    def words(a: str, b: str) -> list[dict]:
        x, y = re.findall(r"\s+|\w+|[^\w\s]", a), re.findall(r"\s+|\w+|[^\w\s]", b)
        out = []
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if op == "equal":
                out.append({"op": "same", "text": "".join(x[i1:i2])})
            else:
                out += [{"op": k, "text": t} for k, t in (("gone", "".join(x[i1:i2])), ("new", "".join(y[j1:j2]))) if t]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, h, words("".join(a), "".join(b))) for r, h, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pydict({n: [x[k] for x in rows] for k, n in enumerate(schema.names)}, schema=schema)

    return hunks_.where("op = 'replace'").select("rel", "hunk", "old", "new").mapInArrow(run, INLINE)


def summary(hunks_: DataFrame) -> DataFrame:
    """(rel, added, removed, changed): sentences by what happened to them."""
    n = lambda op, c: F.sum(F.when(F.col("op") == op, F.size(c)).otherwise(0))
    return hunks_.groupBy("rel").agg(n("insert", "new").alias("added"), n("delete", "old").alias("removed"), n("replace", "new").alias("changed"))


def candidates(sections: DataFrame, scores: DataFrame | None = None, section_id: str = "", always: Sequence[tuple[str, str]] = (), claims: DataFrame | None = None, outline: str = "") -> DataFrame:
    """Texts for a budget: band 0 is what always goes in, 1 the section and its neighbours, 2
    claims, 3 the outline, 4 all other sections, valued by closeness or relevance."""
    spark = sections.sparkSession
    here = sections.where(F.col("id") == section_id).select(F.col("ord").alias("at"))
    d = sections.join(F.broadcast(here))  # one row
    away = F.abs(F.col("ord") - F.col("at"))
    d = d.withColumn("band", F.when(away <= 1, 1).otherwise(4))
    near = 1.0 / F.greatest(away, F.lit(1))
    if scores is not None:
        d = d.join(scores.select("id", "score"), "id", "left")
        near = F.greatest(near, F.coalesce("score", F.lit(0.0)))
    value = F.when(away == 0, 10.0).when(away == 1, 4.0).otherwise(near)
    tokens = S.token_estimate(F.col("text")).alias("tokens")
    ss = S.sentences(F.col("text"))
    short = S.let(ss, lambda x: F.when(F.size(x) > 3, F.concat(F.array_join(F.slice(x, 1, 2), " "), F.lit(" … "), F.element_at(x, -1))).otherwise(F.array_join(F.slice(x, 1, 2), " ")))
    out = d.select("id", "band", "text", value.alias("value"), tokens, short.alias("summary"))
    more = [("always:" + k, 0, t, 1.0) for k, t in always if t.strip()] + [("outline", 3, outline, 6.0)] * bool(outline.strip())
    if more:
        out = out.unionByName(spark.createDataFrame(more, "id string, band int, text string, value double").select("id", "band", "text", "value", tokens, F.lit("").alias("summary")))
    if claims is not None:
        said = F.concat(F.lit("- "), "subject", F.lit(": "), "predicate", F.lit(" = "), "value")
        c = claims.select(F.concat(F.lit("claim:"), F.col("id").cast("string")).alias("id"), F.lit(2).alias("band"), said.alias("text"), F.lit(8.0).alias("value"))
        out = out.unionByName(c.select("id", "band", "text", "value", tokens, F.lit("").alias("summary")))
    return out


def assemble(rows: Sequence, budget: int) -> list[str]:
    """Ids of candidates (a request's few) in the order taken: band by band, what doesn't fit
    goes in as its summary ("id (summary)") or is skipped. Band 0 must fit as a whole."""
    must = [r for r in rows if r["band"] == 0]
    left = budget - sum(r["tokens"] for r in must)
    if left < 0:
        raise ValueError(f"band 0 needs {budget - left} tokens of {budget}")
    gain = lambda r: r["value"] if r["band"] in (1, 4) else r["value"] / max(1, r["tokens"])
    out = [r["id"] for r in must]
    for r in sorted((r for r in rows if r["band"]), key=lambda r: (r["band"], -gain(r), str(r["id"]))):
        short = (r["summary"] if "summary" in (r.asDict() if hasattr(r, "asDict") else r) else "") or ""
        size = int(max(len(short) / 3.6, len(re.findall(S.WORD, short)) / 0.75)) + 1 if short.strip() else None
        if r["tokens"] <= left:
            out.append(r["id"])
            left -= r["tokens"]
        elif size is not None and size <= left:
            out.append(f"{r['id']} (summary)")
            left -= size
    return out


#: The headings over each band's texts, and the order in which bands give way: the last first.
HEADINGS = {0: "", 1: "## Around this section", 2: "## What is known", 3: "## Outline", 4: "## Elsewhere", 5: "## In short"}
PROMPT = "request string, text string, tokens int, carried array<string>, summarised array<string>, shortened array<string>, dropped array<string>, problem string"


def prompts(candidates_: DataFrame, requests: DataFrame) -> DataFrame:
    """One text within its budget for each request (PROMPT). candidates_: request, id, band,
    text, value, summary; requests: request, budget, ask.

    Texts are taken as `assemble` takes them. Headings, blank lines and the request cost
    tokens too, so the joined text is measured as a whole: as long as it is over, the least
    valued text of the last band gives way. It is cut after as many whole sentences as fit,
    or dropped if none does; characters and words before each sentence's end are summed up
    beforehand, so that a look-up finds the cut. Band 0 stays whole: where it doesn't fit,
    `problem` says so and the text is empty. A request has few candidates; requests are
    dealt over the cluster."""
    text, short = F.coalesce("text", F.lit("")), F.coalesce("summary", F.lit(""))
    own = F.struct(F.col("id").cast("string").alias("id"), "band", F.trim(text).alias("text"), F.coalesce("value", F.lit(0.0)).cast("double").alias("value"), F.trim(short).alias("summary"), S.sentences(text).alias("sentences"))
    every = candidates_.groupBy("request").agg(F.collect_list(own).alias("c"))
    rows = requests.select("request", "budget", F.coalesce("ask", F.lit("")).alias("ask")).join(every, "request", "left")
    lists = ("carried", "summarised", "shortened", "dropped")
    schema = pa.schema([("request", pa.string()), ("text", pa.string()), ("tokens", pa.int32()), *((x, pa.list_(pa.string())) for x in lists), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"request": r["request"], **_prompt(r["c"] or [], r["budget"], r["ask"])} for r in batch.to_pylist()], schema=schema)

    return rows.select(F.col("request").cast("string"), F.col("budget").cast("int"), "ask", "c").mapInArrow(run, PROMPT)


_WORDS = re.compile(S.WORD)


def estimated(text: str) -> int:
    """`scalar.token_estimate` of a text."""
    return int(max(len(text) / 3.6, len(_WORDS.findall(text)) / 0.75)) + 1 if text else 0


def _joined_up(taken: list[dict], ask: str) -> str:
    parts = []
    for band, heading in HEADINGS.items():
        own = [c["text"] for c in taken if c["band"] == band and c["text"]]
        parts += [heading, *own] if own else []
    return "\n\n".join(p for p in [*parts, *(["## Request", ask.strip()] if ask.strip() else [])] if p)


def _prompt(cands: list[dict], budget: int, ask: str) -> dict:
    out: dict = {"text": "", "tokens": 0, "carried": [], "summarised": [], "shortened": [], "dropped": [], "problem": None}
    must = [c for c in cands if c["band"] == 0]
    least = estimated(_joined_up(must, ask))
    if least > budget:
        return out | {"problem": f"what always goes in needs {least} tokens of {budget}"}
    left = budget - estimated(ask) - sum(estimated(c["text"]) for c in must)
    gain = lambda c: c["value"] if c["band"] in (1, 4) else c["value"] / max(1, estimated(c["text"]))
    taken = list(must)
    for c in sorted((c for c in cands if c["band"] in (1, 2, 3, 4)), key=lambda c: (c["band"], -gain(c), c["id"])):
        size, brief = estimated(c["text"]), estimated(c["summary"])
        if size <= left:
            taken.append(c)
            left -= size
        elif brief and brief <= left:
            taken.append(c | {"band": 5, "text": c["summary"], "sentences": []})
            out["summarised"].append(c["id"])
            left -= brief
        else:
            out["dropped"].append(c["id"])
    while estimated(joined := _joined_up(taken, ask)) > budget:
        last = max(c["band"] for c in taken)
        c = min((c for c in taken if c["band"] == last), key=lambda c: (c["value"], -len(c["text"]), c["id"]))
        taken.remove(c)
        if kept := _fitting(c, joined, budget):
            taken.append(c | {"text": kept, "sentences": []})
            out["shortened"].append(c["id"])
        else:
            out["dropped"].append(c["id"])
            for x in ("summarised", "shortened"):
                out[x] = [i for i in out[x] if i != c["id"]]
    order = {id(c): k for k, c in enumerate(taken)}
    taken.sort(key=lambda c: (c["band"], order[id(c)]))
    return out | {"text": joined, "tokens": estimated(joined), "carried": [c["id"] for c in taken]}


def _fitting(c: dict, joined: str, budget: int) -> str:
    """The first sentences of a text with which the whole stays within the budget; empty if none."""
    over_chars = len(joined) - 3.6 * (budget - 1e-9)
    over_words = len(_WORDS.findall(joined)) - 0.75 * (budget - 1e-9)
    chars = list(accumulate(len(s) + 1 for s in c["sentences"]))
    words = list(accumulate(len(_WORDS.findall(s)) for s in c["sentences"]))
    room = min(bisect_right(chars, len(c["text"]) - over_chars), bisect_right(words, len(_WORDS.findall(c["text"])) - over_words))
    return " ".join(c["sentences"][: min(room, len(c["sentences"]) - 1)])
