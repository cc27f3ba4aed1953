"""Packing documents into training sequences by cutting-stock column generation.

1. Every text is encoded and closed by the end id. Its whole sequences are cut off the
   front; what remains is shorter than a sequence. Checksums are taken here.
2. The lengths of the remainders, rounded up to size classes, make a histogram of at
   most a hundred-odd classes. The driver solves the linear relaxation of the
   cutting-stock problem over it: the restricted master keeps a basis of patterns, and a
   knapsack dynamic programme over the dual prices brings in the next pattern.
3. A share of the remainders, chosen by a hash and sized by the linear programme's own
   waste, are fillers. Groups of a bounded number of tokens, dealt by a hash, then pack in
   parallel: the patterns, scaled to the group and rounded down, take the documents
   ranked within their size class; what rounding leaves goes in first-fit order; the
   stream of fillers is cut to fill every gap, goes on as whole sequences, and ends in
   pieces of a power of two.

Only the histogram reaches the driver. A group's size is bounded by construction.

Null text is empty and packs as its end id. Repeated rows are packed one by one (a row
key of our own tells them apart); a very long text becomes many whole sequences; an
empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, texts
from .op08_tokens import SPLIT, byte_symbols, merger, unsupported

LIMIT, END_ID = 2048, 1
#: Tokens of remainders in a group.
GROUP_TOKENS = 1 << 21
#: Characters on which regular expression engines may disagree about white space, and long runs.
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]|(?<!\\s)\\s{4000}|(?<!\\S)\\S{20000}")


class Ids:
    """Ids of texts (four bytes each, little-endian) as the tokenizers library gives them.

    Where the vocabulary file is a plain byte-level one whose ids follow its merge ranks,
    tiktoken's faster merges run over that file's own vocabulary and give the same ids;
    texts it can't take, and other vocabularies, go through the library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if unsupported(spec):
            return
        self.by = merger(path)
        back = {s: b for b, s in byte_symbols().items()}
        own = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.by.specials}
        if (np.diff(self.by.made) > 0).all() and int(self.by.made[0]) == len(back):
            ranks = {bytes(map(back.__getitem__, k)): v for k, v in own.items()}
            self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if self.fast is None or ODD.search(text):
            ids = self.slow(text)
        else:
            cut = self.by.cut
            try:
                if cut is None or not cut.search(text):
                    ids = self.fast.encode_ordinary(text)
                else:
                    ids, at = [], 0
                    for m in cut.finditer(text):
                        ids += [*self.fast.encode_ordinary(text[at : m.start()]), self.by.specials[m[0]]]
                        at = m.end()
                    ids += self.fast.encode_ordinary(text[at:])
            except ValueError:  # its pattern gives up on very long runs of white space
                ids = self.slow(text)
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


def encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc, tokens, checksums of the whole sequences, the remainder's size, checksum and ids."""

    def make():
        known = Ids(vocabulary)
        end = int(end_id).to_bytes(4, "little")
        small = known.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16

        def work(batch: pa.RecordBatch):
            rows = texts(batch)
            for at in range(0, len(rows), 500):
                out: dict = {k: [] for k in ("tokens", "whole", "rest", "rest_crc", "rest_ids")}
                for text in rows[at : at + 500]:
                    raw = memoryview(known.encode(text) + end)
                    n, step = len(raw) // 4, limit * 4
                    full = n // limit
                    rest = raw[full * step :]
                    out["tokens"].append(n)
                    out["whole"].append([zlib.crc32(raw[i * step : (i + 1) * step]) for i in range(full)])
                    out["rest"].append(n - full * limit)
                    out["rest_crc"].append(zlib.crc32(rest))
                    ids = np.frombuffer(rest, dtype="<u4")
                    out["rest_ids"].append(ids.astype("<u2").tobytes() if small else ids.tobytes())
                yield out | {"doc": batch.column(0).slice(at, len(out["rest"]))}

        return work

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return map_batches(rows, make, f"doc {kind}, tokens bigint, whole array<bigint>, rest int, rest_crc bigint, rest_ids binary")


def size_classes(limit: int) -> np.ndarray:
    """Sizes that remainders are rounded up to: steps of about an eighth to a 32nd."""
    out, at, step = [], 0, 1
    while at < limit:
        at = min(limit, at + step)
        out.append(at)
        step = max(1, 1 << max(0, at.bit_length() - 5))
    return np.array(out, dtype=np.int64)


def knapsack(sizes: np.ndarray, prices: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest price that fits, by dynamic programming."""
    best, pick = np.zeros(limit + 1), np.full(limit + 1, -1)
    order = np.argsort(sizes)
    order = order[prices[order] > 0]
    sizes_up, prices_up = sizes[order], prices[order]
    fits = np.searchsorted(sizes_up, np.arange(limit + 1), side="right").tolist()
    for w in range(1, limit + 1):
        k = fits[w]
        best[w] = best[w - 1]
        if k:
            value = best[w - sizes_up[:k]] + prices_up[:k]
            j = value.argmax()
            if value[j] > best[w] + 1e-12:
                best[w], pick[w] = value[j], order[j]
    pattern, w = np.zeros(len(sizes), dtype=np.int64), limit
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            pattern[pick[w]] += 1
            w -= sizes[pick[w]]
    return float(best[limit]), pattern


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product by plain sums: small matrices must not wake a linear algebra library's threads."""
    return (matrix * vector).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps with row pivots, for the same reason."""
    m = len(matrix)
    work = np.concatenate((matrix.astype(np.float64), np.eye(m)), axis=1)
    for c in range(m):
        p = c + int(np.abs(work[c:, c]).argmax())
        if p != c:
            work[[c, p]] = work[[p, c]]
        work[c] /= work[c, c]
        rest = work[:, c].copy()
        rest[c] = 0
        work -= np.outer(rest, work[c])
    return work[:, m:]


@dataclass
class Relaxation:
    """The solved linear programme: a basis of patterns, how often each is used, and prices
    under which no pattern costs more than one sequence, so that prices @ demand is a bound."""

    patterns: np.ndarray
    used: np.ndarray
    prices: np.ndarray


def relaxation(sizes: np.ndarray, demand: np.ndarray, limit: int, gap: float = 1e-3) -> Relaxation:
    """The linear relaxation of the cutting-stock problem, solved to within gap of its bound.

    Simplex steps run over the pool of all patterns made so far; when none improves, the
    knapsack prices a new one. It sees prices drawn towards those of the best bound, which
    keeps them from swinging; if its pattern doesn't improve at the basis' own prices, the
    draw is halved, down to none. Demands are tilted by a millionth or less so that no step
    stands still, which is what ends the loop: the cost falls with every step, and a basis
    without an improving pattern is the optimum. There is no cap on the rounds."""
    m = len(sizes)
    tilted = demand * (1 + 1e-6 * (np.arange(1, m + 1) / m))
    pool = [np.diag(limit // sizes)]
    for k in range(m):  # patterns that take each size as often as fits, then what fills the rest best
        need, room = np.zeros(m, dtype=np.int64), limit
        for c in (k, *range(m - 1, -1, -1)):
            need[c] += room // sizes[c]
            room -= sizes[c] * (room // sizes[c])
        pool.append(need[None])
    pool = np.concatenate(pool)
    basis = list(range(m))
    inverse = np.diag(1 / np.diag(pool[:m]).astype(np.float64))
    used = times(inverse, tilted)
    best, centre, draw, steps = 0.0, np.zeros(m), 0.8, 0

    def step(new: int) -> None:
        nonlocal inverse, used, steps
        way = times(inverse, pool[new])
        ok = way > 1e-9
        ratio = np.where(ok, used / np.where(ok, way, 1), np.inf)
        out = int(ratio.argmin())
        basis[out] = new
        steps += 1
        if steps % 50:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
        else:
            inverse = inverted(pool[basis].T)
        used = np.maximum(times(inverse, tilted), 0)

    while True:
        while True:  # the optimum over the pool
            price = inverse.sum(axis=0)
            worth = times(pool, price)
            new = int(worth.argmax())
            if worth[new] <= 1 + 1e-7:
                break
            step(new)
        pull = draw if best else 0.0
        while True:
            seen = pull * centre + (1 - pull) * price
            value, pattern = knapsack(sizes, seen, limit)
            said = float((np.maximum(seen, 0) * tilted).sum()) / max(value, 1e-12)
            if said > best:
                best, centre = said, np.maximum(seen, 0) / max(value, 1e-12)
            if used.sum() <= (1 + gap) * best or (pattern * price).sum() > 1 + 1e-7:
                break
            if pull == 0.0:  # no pattern improves: the optimum
                best, centre = used.sum(), price
                break
            pull = pull / 2 if pull > 0.05 else 0.0
        if used.sum() <= (1 + max(gap, 1e-7)) * best:
            found = pool[basis]
            return Relaxation(found, np.maximum(times(inverse, demand), 0), centre)
        pool = np.concatenate((pool, pattern[None]))


@dataclass
class Plan:
    sizes: np.ndarray
    patterns: np.ndarray
    used: np.ndarray
    rows: int  # remainders that the patterns were made for
    filler: float  # share of the remainders
    bound: float  # no fewer sequences hold the remainders, rounded up to their classes


def plan(lengths: dict[int, int], limit: int = LIMIT) -> Plan:
    """From the histogram of remainder lengths."""
    sizes = size_classes(limit)
    demand = np.bincount(np.searchsorted(sizes, list(lengths)), list(lengths.values()), len(sizes)) if lengths else np.zeros(len(sizes))
    have = np.flatnonzero(demand)
    out, used = np.zeros((0, len(sizes)), dtype=np.int64), np.zeros(0)
    tokens, bound = sum(k * v for k, v in lengths.items()), 0.0
    if len(have):
        solved = relaxation(sizes[have], demand[have].astype(np.float64), limit)
        used, bound = solved.used, float((solved.prices * demand[have]).sum())
        out = np.zeros((len(used), len(sizes)), dtype=np.int64)
        out[:, have] = solved.patterns
    waste = 1 - tokens / (limit * used.sum()) if used.sum() else 0
    # Fillers of that share fill the gaps of the others; a margin evens out small groups.
    return Plan(sizes, out, used, sum(lengths.values()), min(1.0, 1.25 * max(waste, 0) + 0.02), bound)


def place(rest: np.ndarray, filler: np.ndarray, by: Plan, limit: int) -> list[np.ndarray]:
    """Pieces of a group's remainders: (row, start, length, sequence, offset) arrays."""
    order = np.argsort(rest, kind="stable")
    order = order[(rest[order] > 0) & ~filler[order]]
    kind = np.searchsorted(by.sizes, rest[order])
    first = np.searchsorted(kind, np.arange(len(by.sizes) + 1))
    taken, have = first[:-1].copy(), np.diff(first)
    left = have.copy()
    row, seq, n = [], [], 0
    scale = len(order) / max(1, by.rows)
    for p in np.argsort(-by.used, kind="stable"):
        need = by.patterns[p]
        on = np.flatnonzero(need)
        times = min(int(by.used[p] * scale), int((left[on] // need[on]).min()))
        for c in on if times else ():
            k = int(times * need[c])
            row.append(order[taken[c] : taken[c] + k])
            seq.append(n + np.repeat(np.arange(times), need[c]))
            taken[c] += k
            left[c] -= k
        n += times
    gaps: list[int] = []  # of the sequences that first-fit opens, largest remainders first
    for c in range(len(by.sizes) - 1, -1, -1):
        for i in order[taken[c] : first[c + 1]]:
            size = int(rest[i])
            k = next((k for k, g in enumerate(gaps) if g >= size), len(gaps))
            if k == len(gaps):
                gaps.append(limit)
            gaps[k] -= size
            row.append(np.array([i]))
            seq.append(np.array([n + k]))
    n += len(gaps)
    row, seq = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (row, seq))
    by_seq = np.argsort(seq, kind="stable")
    row, seq = row[by_seq], seq[by_seq]
    size = rest[row].astype(np.int64)
    filled = np.bincount(seq, size, n).astype(np.int64)
    offset = np.cumsum(size) - size
    offset -= np.repeat(np.cumsum(filled) - filled, np.bincount(seq, minlength=n))
    # The stream of fillers: gaps first, then whole sequences, then powers of two.
    stream = np.flatnonzero(filler & (rest > 0))
    total = int(rest[stream].sum())
    gap = limit - filled
    at = np.flatnonzero(gap > 0)
    room, target, begin = gap[at], at, filled[at]
    over = total - int(room.sum())
    if over > 0:
        tail = [limit] * (over // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if over % limit >> b & 1]
        room, target, begin = np.append(room, tail), np.append(target, n + np.arange(len(tail))), np.append(begin, np.zeros(len(tail), dtype=np.int64))
    ends_room, ends_doc = np.cumsum(room), np.cumsum(rest[stream])
    cut = np.unique(np.concatenate((ends_room[ends_room < total], ends_doc))) if total else np.zeros(0, dtype=np.int64)
    low = np.concatenate(([0], cut[:-1])) if len(cut) else cut
    d, r = np.searchsorted(ends_doc, low, side="right"), np.searchsorted(ends_room, low, side="right")
    piece = [stream[d], low - (ends_doc - rest[stream])[d], cut - low, target[r], begin[r] + low - (ends_room - room)[r]]
    own = [row, np.zeros(len(row), dtype=np.int64), size, seq, offset]
    return [np.concatenate((a, b)).astype(np.int64) for a, b in zip(own, piece, strict=True)]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = dict(docs.dtypes)[id_col]
    rows = materialise(encoded(docs, vocabulary, id_col, text_col, limit, end_id).withColumn("row", F.monotonically_increasing_id()), "encoded")
    lengths = {r.rest: r.n for r in rows.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}  # under `limit` rows
    by = plan(lengths, limit)
    groups = max(1, -(-sum(k * v for k, v in lengths.items()) // group_tokens))
    sent = docs.sparkSession.sparkContext.broadcast(by)
    mix = 1 << 16
    filler = F.pmod(F.xxhash64("row", F.lit("filler")), F.lit(mix)) < int(by.filler * mix) + 1
    dealt = rows.select("row", "doc", "tokens", "whole", "rest", "rest_crc", F.when(filler, F.col("rest_ids")).alias("ids"), F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        rest = table["rest"].to_numpy().astype(np.int64)
        ids = table["ids"].to_pylist()
        row, start, length, seq, offset = place(rest, np.array([x is not None for x in ids], dtype=bool), sent.value, limit)
        tokens, crc = table["tokens"].to_numpy(), table["rest_crc"].to_numpy()
        width = {i: np.frombuffer(x, dtype="<u2" if len(x) == 2 * rest[i] else "<u4") for i, x in enumerate(ids) if x}
        sums = np.array([zlib.crc32(width[i][a : a + k].astype("<u4").tobytes()) if k < rest[i] else crc[i] for i, a, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)], dtype=np.int64)
        start = start + (tokens - rest)[row]
        whole = table["whole"].to_pylist()
        many = np.array([len(x) for x in whole], dtype=np.int64)
        owner = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        row, start, length = np.append(row, owner), np.append(start, nth * limit), np.append(length, np.full(len(owner), limit))
        sums = np.append(sums, np.array([x for w in whole for x in w], dtype=np.int64))
        begin = int(seq.max()) + 1 if len(seq) else 0
        seq, offset = np.append(seq, begin + np.arange(len(owner))), np.append(offset, np.zeros(len(owner), dtype=np.int64))
        group = table["group"][0].as_py()
        return pa.table({"doc": table["doc"].take(pa.array(row)), "start": start, "length": length, "ids_crc32": sums, "doc_tokens": tokens[row], "sequence_id": seq + (group << 32), "offset": offset})

    out = dealt.groupBy("group").applyInArrow(one, f"doc {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("doc", id_col)
