"""A quality classifier learnt from preference pairs (Bradley-Terry).

Each text becomes a vector of shape measures: shares of byte classes and of single
punctuation marks, word and line statistics. Every measure is cut into bins at the
quantiles of the training rows, and a bin has a weight; a document's worth is the sum
of its bins' weights. A pair (good, bad) says that the good one's worth is higher: the
weights minimise the logistic loss of worth differences over sampled pairs. The
accepted documents are those above a quantile of the training rows' worth, namely the
one that separates the two labels best; the score is a logistic curve that passes
0.7 there, so `score >= 0.7` is that threshold.

Training rows: at most `sample` labelled rows (a documented bound, half for each label,
chosen by a hash of the id), never one of the held-out rows (crc32 of the id as text,
mod 4, is 2). Only their measures come to the driver. All documents are scored in
place, with no shuffle.

Null text is empty. Ids with both labels count by their mean (0.5 and more is good);
null labels are ignored. Without two classes to compare every score is the share of good
rows (0.5 if there are none). Very long texts are measured in slices.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship, texts

SAMPLE, PAIRS, BINS, STEPS = 20_000, 60_000, 10, 250
ACCEPT = 0.7
CHUNK = 1 << 20
#: Fixed value: the ASCII marks that get a measure each.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_counts(data: list[bytes]) -> np.ndarray:
    out = np.zeros((len(data), 256), dtype=np.int64)
    held, size, first = [], 0, 0

    def flush(end: int) -> None:
        if held:
            sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
            owner = np.repeat(np.arange(len(held)) * 256, sizes)
            out[first:end] += np.bincount(owner + np.frombuffer(b"".join(held), dtype=np.uint8), minlength=len(held) * 256).reshape(-1, 256)

    for i, raw in enumerate(data):
        if size + len(raw) > CHUNK:
            flush(i)
            held, size, first = [], 0, i
        if len(raw) > CHUNK:
            for at in range(0, len(raw), CHUNK):
                out[i] += np.bincount(np.frombuffer(raw[at : at + CHUNK], dtype=np.uint8), minlength=256)
            first = i + 1
            continue
        held.append(raw)
        size += len(raw)
    flush(len(data))
    return out


def measures(rows: list[str]) -> np.ndarray:
    """One row of measures for each text."""
    data = [t.encode("utf-8") for t in rows]
    n = byte_counts(data).astype(np.float64)
    size = np.maximum(n.sum(axis=1), 1)
    share = lambda cols: n[:, cols].reshape(len(rows), -1).sum(axis=1) / size
    upper, lower = share(slice(65, 91)), share(slice(97, 123))
    cols = [np.log1p(n.sum(axis=1)), upper, lower, share(slice(48, 58)), share(32), share(10), share(slice(128, 256)), upper / np.maximum(upper + lower, 1e-9)]
    cols += [n[:, ord(c)] / size for c in MARKS]
    more = np.zeros((len(rows), 8))
    for i, t in enumerate(rows):
        ws = t.split()
        if not ws:
            continue
        seen = Counter(ws)
        lines = t.split("\n")
        top = seen.most_common(1)[0][1]
        k = len(ws)
        more[i] = (np.log1p(k), len(t) / k, len(seen) / k, top / k, len(seen) / k**0.8, len(set(lines)) / len(lines), len(t) / len(lines), max(map(len, seen)))
    return np.column_stack([*cols, more])


def held_out(col: Column) -> Column:
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    cuts: np.ndarray  # measures x (bins - 1)
    weights: np.ndarray  # measures x bins
    threshold: float
    constant: float | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)])

    def worth(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.weights[np.arange(len(self.weights)), b].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        at = np.clip(self.worth(x) - self.threshold, -30, 30) + np.log(ACCEPT / (1 - ACCEPT))
        return np.where(self.worth(x) >= self.threshold, np.maximum(1 / (1 + np.exp(-at)), ACCEPT), 1 / (1 + np.exp(-at)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = STEPS, seed: int = 7, decay: float = 1e-4) -> Model:
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1] if x.ndim == 2 and len(x) else 1
    if not len(good) or not len(bad):
        return Model(np.zeros((width, 0)), np.zeros((width, 1)), 0.0, float(y.mean()) if len(y) else 0.5)
    # Bins at quantiles of a half-and-half mix, so that the rarer label shapes them too.
    grid = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = np.sort(np.column_stack([np.quantile(x[good], grid[::2], axis=0).T, np.quantile(x[bad], grid, axis=0).T]), axis=1)
    model = Model(cuts, np.zeros((width, cuts.shape[1] + 1)), 0.0)
    b = model.bins(x)
    slot = b + np.arange(width) * (cuts.shape[1] + 1)
    r = np.random.default_rng(seed)
    p, q = r.choice(good, pairs), r.choice(bad, pairs)
    w, m, v = np.zeros(model.weights.size), np.zeros(model.weights.size), np.zeros(model.weights.size)
    for step in range(1, steps + 1):
        s = w[slot].sum(axis=1)
        g = -1 / (1 + np.exp(np.clip(s[p] - s[q], -30, 30)))  # of the loss, by the difference
        row = np.bincount(p, g, len(x)) - np.bincount(q, g, len(x))
        grad = np.bincount(slot.ravel(), np.repeat(row, width), w.size) / pairs + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    model.weights = w.reshape(model.weights.shape)
    s = model.worth(x)
    levels = np.quantile(s, np.linspace(0, 1, 1001))
    accepted = np.searchsorted(np.sort(s[good]), levels, side="left"), np.searchsorted(np.sort(s[bad]), levels, side="left")
    gain = accepted[1] / len(bad) - accepted[0] / len(good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    model.threshold = float((levels[best[0]] + levels[best[-1]]) / 2)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    )
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample // 2)
    chosen = F.broadcast(pick(1).unionByName(pick(0)))  # at most `sample` rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("text", "y")

    def make():
        def work(batch: pa.RecordBatch):
            yield {"x": measures(texts(batch)).tolist(), "y": batch.column(1)}

        return work

    got = map_batches(rows, make, "x array<double>, y int").orderBy("y", "x").toPandas()
    return (np.array(got["x"].tolist(), dtype=np.float64) if len(got) else np.zeros((0, 1))), got["y"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    return fit(*training_rows(docs, labels, id_col, text_col, label_col, sample))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""

    def make():
        def work(batch: pa.RecordBatch):
            rows = texts(batch)
            for at in range(0, len(rows), 1000):
                s = model.score(measures(rows[at : at + 1000]))
                yield {"id": batch.column(0).slice(at, len(s)), "score": s, "predicted": (s >= ACCEPT).astype(np.int32)}

        return work

    kind = dict(docs.dtypes)[id_col]
    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The accepted rows of docs, with their columns."""

    ship(docs.sparkSession)

    def keep(batches):
        for batch in batches:
            rows = texts(batch, text_col)
            good = np.concatenate([model.score(measures(rows[at : at + 1000])) >= ACCEPT for at in range(0, len(rows), 1000)] or [np.zeros(0, dtype=bool)])
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
