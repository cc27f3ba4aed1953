"""Benchmark decontamination with an FM-index per training shard.

Words are the maximal runs of characters outside the ASCII separators, after A-Z is
lower-cased. A window is 10 consecutive words of one benchmark item (all words of a
shorter item). Each task packs the documents it reads into shards, builds an FM-index
over the shard's words (suffix order, Burrows-Wheeler transform, wavelet matrix for
ranks, sampled suffix positions), searches every window backwards, locates its
occurrences, and merges them into removal spans.

A shard holds only stretches that can contain a window: runs of words whose every
neighbouring pair also stands in the benchmark (and single words that are windows).
An occurrence of a window lies wholly inside such a run, so nothing is lost.

The benchmark is taken in blocks of a bounded number of windows, one after another on the
driver; each block is sent to the executors and scans all documents, so its size sets the
number of scans and never the memory of a task. No row is shuffled.

Null or wordless documents have no words and are clean; null or wordless items have no
windows; repeated items are reported under each of their ids; a very long text spreads
over slices and is indexed whole. Other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, spare

WINDOW = 10
#: Words of a document cut at a time; symbols and documents of a shard; windows of a block.
SLICE, SHARD, SHARD_DOCS, BLOCK = 1 << 20, 1 << 20, 4000, 200_000
SAMPLE = 8

#: Bytes of the text after lower-casing A-Z, ASCII separators as blanks.
_KEEP = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_KEEP).split()


def word_ids(text: str | None, ids: dict[bytes, int]) -> np.ndarray:
    """Ids of a text's words, 0 for those that no item has."""
    raw = (text or "").encode("utf-8").translate(_KEEP)
    parts, at = [], 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw) and (end := raw.find(b" ", end)) < 0:
            end = len(raw)
        found = raw[at:end].split()
        parts.append(np.fromiter((ids.get(w, 0) for w in found), dtype=np.int32, count=len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


class Windows:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        pairs = set()
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            pairs.update(zip(seq, seq[1:], strict=False))
            for i in range(max(1, len(seq) - WINDOW + 1) if seq else 0):
                found.setdefault(tuple(seq[i : i + WINDOW]), set()).add(item)
        self.n = len(found)
        self.length = np.array([len(w) for w in found], dtype=np.int64)
        self.symbols = np.zeros((self.n, WINDOW), dtype=np.int64)
        for i, w in enumerate(found):
            self.symbols[i, : len(w)] = w
        names = sorted({x for s in found.values() for x in s})
        place = {x: i for i, x in enumerate(names)}
        self.items = names
        self.owner_start = np.cumsum([0, *(len(s) for s in found.values())])
        self.owner = np.array([place[x] for s in found.values() for x in sorted(s)], dtype=np.int64)
        self.base = len(self.ids) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), dtype=np.int64)
        self.single = np.zeros(self.base, dtype=bool)
        self.single[self.symbols[self.length == 1, 0]] = True
        self.shortest = int(self.length.min()) if self.n else 1

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """Which words of a document can be part of an occurrence."""
        keep = self.single[ids]
        if len(ids) > 1 and len(self.pairs):
            key = ids[:-1].astype(np.int64) * self.base + ids[1:]
            ok = (ids[:-1] > 0) & (ids[1:] > 0)
            at = np.flatnonzero(ok)
            hit = self.pairs[np.minimum(np.searchsorted(self.pairs, key[at]), len(self.pairs) - 1)] == key[at]
            linked = np.zeros(len(ids) - 1, dtype=bool)
            linked[at[hit]] = True
            keep[:-1] |= linked
            keep[1:] |= linked
        if self.shortest > 1 and keep.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
            start, end = edge[::2], edge[1::2]
            short = end - start < self.shortest
            drop = np.zeros(len(ids) + 1, dtype=np.int32)
            np.add.at(drop, start[short], 1)
            np.add.at(drop, end[short], -1)
            keep &= np.cumsum(drop[:-1]) == 0
        return keep


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level at a time."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            count = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start = np.zeros_like(end)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = ones[start], ones[end]
            start, end = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, end - b)
        return end - start


class FMIndex:
    """Over runs of symbols from 1, each closed by a 0."""

    def __init__(self, seq: np.ndarray, top: int):
        n = len(seq)
        close = seq == 0
        rank = seq.astype(np.int64) + int(close.sum())
        rank[close] = np.arange(int(close.sum()))  # every closing symbol differs: suffixes compare within runs only
        width = 1
        while True:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - width] = rank[width:] + 1 if width < n else 0
            key = rank * (n + int(top) + 2) + nxt
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, dtype=np.int64)
            new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            rank = new
            if rank[order[-1]] == n - 1 or width >= n:
                break
            width *= 2
        self.bwt = seq[order - 1].astype(np.int64)  # of the first suffix: the last symbol, which is 0
        self.tree = WaveletMatrix(self.bwt, top)
        counts = np.bincount(seq, minlength=top + 2)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        position = order
        starts = self.bwt == 0  # suffixes at the start of a run: no symbol of the run stands before
        self.sampled = (position % SAMPLE == 0) | starts
        self.slot = np.cumsum(self.sampled) - 1
        self.samples = position[self.sampled]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row range of each pattern, from its last symbol backwards."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), len(self.bwt), dtype=np.int64)
        for step in range(patterns.shape[1]):
            at = np.flatnonzero((length > step) & (low < high))
            if not len(at):
                break
            symbol = patterns[at, length[at] - 1 - step]
            low[at] = self.before[symbol] + self.tree.rank(symbol, low[at])
            high[at] = self.before[symbol] + self.tree.rank(symbol, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each row: step back until a sampled one is met."""
        rows, steps, at = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        out = np.zeros(len(rows), dtype=np.int64)
        while len(at):
            hit = self.sampled[rows[at]]
            found = at[hit]
            out[found] = self.samples[self.slot[rows[found]]] + steps[found]
            at = at[~hit]
            symbol = self.bwt[rows[at]]
            rows[at] = self.before[symbol] + self.tree.rank(symbol, rows[at])
            steps[at] += 1
        return out


def search_shard(docs: list[np.ndarray], block: Windows) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Of each document (as word ids): its merged spans of hit words, its items."""
    out: list[tuple[list, list]] = [([], []) for _ in docs]
    seqs, place, owner = [], [], []
    for d, ids in enumerate(docs):
        keep = block.runs(ids) if block.n and len(ids) else np.zeros(0, dtype=bool)
        if not keep.any():
            continue
        at = np.flatnonzero(keep)
        gap = np.flatnonzero(np.diff(at) > 1) + 1
        seqs.append(np.append(np.insert(ids[at], gap, 0), 0))
        place.append(np.append(np.insert(at, gap, -1), -1))
        owner.append(np.full(len(seqs[-1]), d))
    if not seqs:
        return out
    seq, place, owner = np.concatenate(seqs).astype(np.int64), np.concatenate(place), np.concatenate(owner)
    index = FMIndex(seq, block.base - 1)
    low, high = index.search(block.symbols, block.length)
    n = high - low
    which = np.repeat(np.arange(block.n), n)
    rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    at = index.locate(rows)
    if not len(at):
        return out
    edge = np.zeros(len(seq) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.length[which], -1)
    hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    cut = np.flatnonzero((np.diff(place[hit]) != 1) | (np.diff(owner[hit]) != 0)) + 1
    first, last = hit[np.append(0, cut)], hit[np.append(cut - 1, len(hit) - 1)]
    for d, a, b in zip(owner[first].tolist(), place[first].tolist(), place[last].tolist(), strict=True):
        out[d][0].append((a, b + 1))
    pair = np.unique(owner[at] * block.n + which)  # documents and windows, then documents and items
    d, w = pair // block.n, pair % block.n
    many = block.owner_start[w + 1] - block.owner_start[w]
    slot = np.repeat(block.owner_start[w] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    for x in np.unique(np.repeat(d, many) * len(block.items) + block.owner[slot]).tolist():
        out[x // len(block.items)][1].append(block.items[x % len(block.items)])
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Windows]:
    """Blocks of at most limit windows (or one item); one block is on the driver at a time."""
    held, size = [], 0
    for item, text in items.select(F.col(id_col).cast("string"), text_col).where(F.col(id_col).isNotNull()).toLocalIterator():
        n = len(words(text))
        if held and size + n > limit:
            yield Windows(held)
            held, size = [], 0
        if n:
            held.append((item, text))
            size += n
    if held:
        yield Windows(held)


#: What a scan finds: words of the text, starts and ends of its merged spans of hit words, its items.
FOUND = {"n_words": "long", "starts": "array<long>", "ends": "array<long>", "items": "array<string>"}


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = BLOCK) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of FOUND, and the names that these have beside docs' own."""
    spark = docs.sparkSession
    ship(spark)
    names = {c: spare(docs, f"{c}_found") for c in FOUND}
    for c, kind in FOUND.items():
        docs = docs.withColumn(names[c], F.lit(0).cast(kind) if kind == "long" else F.array().cast(kind))

    def scanned(docs: DataFrame, block: Windows) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from shards(batch, text_col, sent.value, names)

        return docs.mapInArrow(scan, docs.schema)

    pending = Windows([])
    for block in blocks(items, item_id, item_text, limit):
        if pending.items:  # written, so that no task holds two blocks
            docs = materialise(scanned(docs, pending), "scanned")
        pending = block
    return scanned(docs, pending), names


def replaced(batch: pa.RecordBatch, columns: dict[str, list]) -> pa.RecordBatch:
    """The batch with some columns exchanged; all others stay as they are."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else c for f, c in zip(batch.schema, batch.columns, strict=True)], schema=batch.schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def shards(batch: pa.RecordBatch, text_col: str, block: Windows, names: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Search a batch in shards of a bounded number of words (or one document)."""
    held, size, begin = [], 0, 0
    for i, text in enumerate(column(batch, text_col)):
        held.append(word_ids(text, block.ids))
        size += len(held[-1])
        if size >= SHARD or len(held) >= SHARD_DOCS or i == batch.num_rows - 1:
            part = batch.slice(begin, i + 1 - begin)
            found = search_shard(held, block)
            old = {c: column(part, names[c]) for c in ("starts", "ends", "items")}
            spans = [merged([*zip(a, b, strict=True), *new]) for a, b, (new, _) in zip(old["starts"], old["ends"], found, strict=True)]
            new = {
                "n_words": [len(x) for x in held],
                "starts": [[a for a, _ in s] for s in spans],
                "ends": [[b for _, b in s] for s in spans],
                "items": [sorted({*known, *more}) for known, (_, more) in zip(old["items"], found, strict=True)],
            }
            yield replaced(part, {names[c]: x for c, x in new.items()})
            held, size, begin = [], 0, i + 1


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK) -> DataFrame:
    """One row per document: counts, the digest of its items, the removal spans. Items are
    told apart by their ids as strings."""
    found, names = find(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, "text", limit=limit)
    starts, ends, own = F.col(names["starts"]), F.col(names["ends"]), F.col(names["items"])
    hit = F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(
        F.col("id").alias(id_col),
        F.col(names["n_words"]).alias("n_words"),
        hit.alias("n_hit"),
        F.size(own).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(own), ","), 256).alias("items_sha256"),
        (F.size(starts) > 0).alias("contaminated"),
        F.arrays_zip(starts.alias("start"), ends.alias("end")).alias("spans"),
    )


@lru_cache(maxsize=1)
def _lower() -> dict[int, int]:
    return {c: c + 32 for c in range(0x41, 0x5B)}


def cut_out(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(_lower()))]
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", limit: int = BLOCK) -> DataFrame:
    """docs with the removal spans cut out of their texts; their columns stay."""
    found, names = find(docs, items, text_col, limit=limit)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(column(batch, text_col), column(batch, names["starts"]), column(batch, names["ends"]), strict=True)
            yield replaced(batch, {text_col: [cut_out(t, a, b) if a else t for t, a, b in rows]})

    out = found.mapInArrow(apply, found.schema)
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.when(F.size(names["starts"]) > 0, F.char_length(text_col)).otherwise(F.col(count_col)).cast(docs.schema[count_col].dataType))
    return out.select(*docs.columns)
