"""Quartile bucket digests of documents.

A window of five bytes slides over the UTF-8 text; six byte triplets of each window
are hashed into 128 buckets. The digest holds a length code and, for each bucket, in
which quartile of all bucket counts its count falls (two bits). Two digests differ by
the sum of their quartile distances (a jump over two quartiles weighs double) and of
their length codes, bounded; the likeness is 1 - difference / bound.

Null text is empty. A text of under five bytes has its bytes padded by zeros to one
window, so equal texts always have equal digests and the empty text has one too.

The neighbour of a document is the next one by descending doc_id (null ids last,
repeated ids by the first 64 characters and the digest of their text); after the last comes the first. Neighbours meet by one range
shuffle of the texts: rows stream through each sorted partition with one row of
look-ahead. The first and the last row of every partition are kept aside with their
texts, and the few last rows meet their neighbours by a join on the partition numbers.
A single document is its own neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import materialise

BUCKETS = 128
#: The triplets of a window, each led by its newest byte, with a salt.
TRIPLETS = ((0, 1, 2, 2), (0, 1, 3, 3), (0, 2, 3, 5), (0, 2, 4, 7), (0, 1, 4, 11), (0, 3, 4, 13))
#: Bytes hashed at a time.
CHUNK = 1 << 20
#: Length codes differ by this at most; weights of a distance of 0 to 3 quartiles.
LENGTH_BOUND, WEIGHT = 24, np.array([0, 1, 2, 6])
BOUND = BUCKETS * int(WEIGHT[3]) + LENGTH_BOUND


def bucket_counts(data: list[bytes]) -> np.ndarray:
    """How many triplets of each text fall in each bucket."""
    out = np.zeros((len(data), BUCKETS), dtype=np.int64)
    held, size, first = [], 0, 0
    for i, raw in enumerate(data):
        raw = raw if len(raw) >= 5 else raw.ljust(5, b"\0")
        if size + len(raw) > CHUNK and held:
            _count(held, out[first:i])
            held, size, first = [], 0, i
        if len(raw) > CHUNK:  # one long text, in slices that overlap by a window less one
            for at in range(0, len(raw) - 4, CHUNK):
                _count([raw[at : at + CHUNK + 4]], out[i : i + 1])
            first = i + 1
            continue
        held.append(raw)
        size += len(raw)
    if held:
        _count(held, out[first:])
    return out


def _count(held: list[bytes], out: np.ndarray) -> None:
    sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
    raw = np.frombuffer(b"".join(held), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(held), dtype=np.int64) * BUCKETS, sizes)[4:]
    end = np.cumsum(sizes)
    ok = np.ones(len(raw) - 4, dtype=bool)  # windows that cross into the next text don't count
    for k in range(1, 5):
        at = end[:-1] + 4 - 4 - k
        ok[at[at >= 0]] = False
    n = len(raw) - 4
    byte = [raw[4 - k : 4 - k + n] for k in range(5)]
    m1, m2, m3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    whole = bool(ok.all())
    for a, b, c, salt in TRIPLETS:
        h = byte[a] * m1 + byte[b] * m2 + byte[c] * m3 + np.uint32((salt * 0x27D4EB2F) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        slot = owner + (h >> np.uint32(25))
        out += np.bincount(slot if whole else slot[ok], minlength=len(held) * BUCKETS).reshape(out.shape)


def digests(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length code, quartile of each bucket) of each text."""
    counts = bucket_counts(data)
    cuts = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (counts[:, :, None] > cuts[:, None, :]).sum(axis=2).astype(np.uint8)
    size = np.array([len(x) for x in data], dtype=np.float64)
    return np.round(np.log1p(size) / np.log(1.2)).astype(np.int64), quartile


def likeness(a: tuple, b: tuple) -> np.ndarray:
    far = WEIGHT[np.abs(a[1].astype(np.int64) - b[1].astype(np.int64))].sum(axis=1)
    return 1 - (far + np.minimum(np.abs(a[0] - b[0]), LENGTH_BOUND)) / BOUND


def encoded(d: tuple[np.ndarray, np.ndarray]) -> list[str]:
    q = d[1].reshape(len(d[1]), BUCKETS // 4, 4)
    packed = (q[:, :, 0] << 6 | q[:, :, 1] << 4 | q[:, :, 2] << 2 | q[:, :, 3]).astype(np.uint8)
    return [f"{n:04x}{row.tobytes().hex()}" for n, row in zip(d[0].tolist(), packed, strict=True)]


def decoded(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests back from their strings."""
    packed = np.array([list(bytes.fromhex(f[4:])) for f in fingerprints], dtype=np.uint8).reshape(len(fingerprints), BUCKETS // 4)
    return np.array([int(f[:4], 16) for f in fingerprints], dtype=np.int64), np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(fingerprints), BUCKETS)


def edited(text: str, nxt: str) -> str:
    """The last third of the text replaced by as much of the next one's start."""
    k = len(text) // 3
    return text[: len(text) - k] + nxt[:k]


FIELDS = "id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def measured(part: list[tuple]) -> dict:
    """Results of the rows of part but the last; each row is followed by its neighbour."""
    edits = [edited(t, part[i + 1][1]).encode("utf-8") for i, (_, t) in enumerate(part[:-1])]
    a, b = digests([t.encode("utf-8") for _, t in part]), digests(edits)
    mine, following = (a[0][:-1], a[1][:-1]), (a[0][1:], a[1][1:])
    return {
        "id": [i for i, _ in part[:-1]],
        "n_chars": [len(t) for _, t in part[:-1]],
        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edits],
        "fingerprint": encoded(mine),
        "edited_fingerprint": encoded(b),
        "near_edited": likeness(mine, b).tolist(),
        "near_next": likeness(mine, following).tolist(),
    }


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    plain = _parse_datatype_string(FIELDS.format(kind=kind))
    marked = _parse_datatype_string(f"{FIELDS.format(kind=kind)}, part int, edge string, text string")
    arrow, arrow_marked = to_arrow_schema(plain), to_arrow_schema(marked)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, size, first = [], 0, None

        def rows(cols: dict) -> pa.RecordBatch:
            n = len(cols["id"])
            return pa.RecordBatch.from_pydict({f.name: cols.get(f.name, [None] * n) for f in arrow_marked}, schema=arrow_marked)

        def edge(row: tuple, name: str) -> pa.RecordBatch:
            return rows({"id": [row[0]], "text": [row[1]], "part": [part], "edge": [name]})

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first is None:
                    first = row
                    yield edge(row, "first")
                held.append(row)
                size += len(row[1])
                if len(held) > 1 and (size > CHUNK or len(held) > 2000):
                    yield rows(measured(held))
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield rows(measured(held))
        if held:
            yield edge(held[-1], "last")

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    by = F.col("id").desc_nulls_last()
    # Rows of one id are dealt on by their text and repeated rows by their place, so one id can fill many tasks.
    rows = rows.select("*", F.left("text", F.lit(64)).alias("head"), F.md5(F.col("text").cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("place"))
    order = (by, "head", "digest", "place")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    found = materialise(dealt.mapInArrow(stream, marked), "fingerprints")
    # Two rows for each partition; only the partition numbers come to the driver.
    order = sorted(r.part for r in found.where("edge = 'last'").select("part").collect())
    steps = docs.sparkSession.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "part int, following int")
    last = found.where("edge = 'last'").select("part", "id", "text").join(steps, "part")
    first = found.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield pa.RecordBatch.from_pydict(measured([(i, t), (None, n)]), schema=arrow)

    closed = last.join(first, "following").select("id", "text", "next_text").mapInArrow(close, plain)
    return found.where("edge is null").select(*plain.names).unionByName(closed).withColumnRenamed("id", id_col)
