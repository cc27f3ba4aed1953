"""Near-duplicate documents by consistent weighted sampling.

A text is cut into words (runs of ASCII letters and digits and of all other characters
beyond ASCII, A-Z lower-cased); every five
consecutive words are a shingle (fewer words make one). A shingle weighs its count in
the text times the mean inverse document frequency of its words. Document frequencies
cover all documents and are kept by hashed word, so the table that the executors get has
a fixed size; taking the frequency from the words keeps the weights of a group of near
copies alike, however large it is, where the frequency of whole shingles would give
nearly all weight to the edits.

Improved consistent weighted sampling draws, for each of K functions, one shingle of a
document with a chance in proportion to its weight, the same for both documents with a
chance of their weighted Jaccard similarity. The gamma and uniform variables come from
random tables indexed by slices of the shingle's hash. R samples form a band; documents
that share a band are candidates.

Equal texts are one text from the start. A bucket of a band is dealt by a hash into
chunks of bounded size; within a chunk all pairs are estimated by their samples. In a
first round each text is paired with its likeliest partner of all its chunks and with
the most central text of its largest bucket, so that chunks meet; the pairs are verified
by the weighted Jaccard similarity of the whole sets, and the texts linked so far form
classes, found by spreading the lowest key with shortcuts. A second round pairs each text
with its likeliest partners in other classes. The last two take the buckets that still
hold two classes: the bucket's largest class and the rest of it are cut into chunks, and
a task has two chunks of the rest, or one of the rest and one of the largest class (pairs
inside of one class are never needed). The third round pairs each class with its
likeliest partner there. The last one verifies every pair of a bucket that still stands
in two classes, unless the weights summed by bins of the shingles' hashes prove it below
the threshold. That bound is never wrong, so no pair that shares a band is lost. A text
has few pairs however large its group is; the comparisons by bound inside of a task grow
with the texts of a bucket outside of its largest class times the texts of the bucket.

Null text is empty; texts without words are equal to each other. Repeated rows and ties
join one class, named by its lowest doc_id (null ids come last). Very long texts are
shingled whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, spare, texts

WORDS, THRESHOLD = 5, 0.8
#: Bands of samples: a pair at the threshold shares one with a chance of over 0.999.
BANDS, ROWS = 12, 3
#: Word frequencies are kept by 16 bits of the word's hash.
TABLE = 1 << 16
#: Texts of a bucket that are compared at once.
CHUNK = 512
#: In the first rounds, pairs whose samples agree less often wait for the last one, which takes every pair.
LIKELY = 0.58
#: Bins of a text's outline.
BINS = 256
#: Shingles hashed at a time; bytes of a text cut into words at a time; characters of texts held as sets at a time.
PART, SLICE, HELD = 1 << 15, 1 << 20, 1 << 20

#: Bytes of a text with A-Z lower-cased and all other ASCII but letters and digits as blanks.
_KEEP = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    raw, parts, at = text.encode("utf-8").translate(_KEEP), [], 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw) and (end := raw.find(b" ", end)) < 0:
            end = len(raw)
        found = raw[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def weighted(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes, weights) of a text."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    h, w = np.full(n, 1469598103934665603 + k, dtype=np.uint64), np.zeros(n)
    rare = idf[(words & np.uint64(TABLE - 1)).astype(np.int64)]
    for i in range(k):
        h = (h ^ words[i : i + n]) * _MIX
        h ^= h >> np.uint64(32)
        w += rare[i : i + n]
    own, at, count = np.unique(mixed(h), return_index=True, return_counts=True)
    return own, count * w[at] / k


@lru_cache(maxsize=2)
def tables(k: int, seed: int = 11) -> tuple[np.ndarray, ...]:
    """Of each function: r (gamma 2,1) and its inverse, ln c (c gamma 2,1), beta (uniform)."""
    g = np.random.default_rng(seed)
    r = g.gamma(2.0, 1.0, (k, 1 << 16)).astype(np.float32) + np.float32(1e-6)
    return r, 1 / r, np.log(g.gamma(2.0, 1.0, (k, 1 << 16)) + 1e-12).astype(np.float32), g.random((k, 1 << 16), dtype=np.float32)


def samples(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """k sampled tokens (32 bits each) of each weighted set; zeros for empty ones."""
    out = np.zeros((len(sets), k), dtype=np.uint32)
    held, size = [], 0
    for i, (h, _) in enumerate(sets):
        if held and size + len(h) > PART:
            _draw(sets, held, k, out)
            held, size = [], 0
        if len(h):
            held.append(i)
            size += len(h)
    if held:
        _draw(sets, held, k, out)
    return out


def _draw(sets: list, held: list[int], k: int, out: np.ndarray) -> None:
    h = np.concatenate([sets[i][0] for i in held])
    log_w = np.log(np.concatenate([sets[i][1] for i in held])).astype(np.float32)
    starts = np.cumsum([0, *(len(sets[i][0]) for i in held[:-1])])
    a, b, c = ((h >> np.uint64(s) & np.uint64(0xFFFF)).astype(np.int64) for s in (0, 16, 32))
    name = (h >> np.uint64(20)).astype(np.uint32)
    r_all, inverse, ln_c, beta = tables(k)
    for f in range(k):
        r, u = r_all[f][a], beta[f][b]
        t = np.floor(log_w * inverse[f][a] + u)
        ln_a = ln_c[f][c] - r * (t - u + np.float32(1))
        bits = ln_a.view(np.int32)
        bits = bits ^ (bits >> 31 & 0x7FFFFFFF)  # integers in the order of the floats
        token = name ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        key = bits.astype(np.int64) << 32 | token.astype(np.int64)
        low = np.minimum.reduceat(key, starts)
        out[held, f] = (low & 0xFFFFFFFF).astype(np.uint32)


def outline(h: np.ndarray, w: np.ndarray) -> bytes:
    """The total weight (8 bytes) and the weight in each bin of the hashes, rounded up to 16 bits."""
    sums = np.bincount((h >> np.uint64(56)).astype(np.int64), w, BINS)
    with np.errstate(over="ignore"):
        up = sums.astype("<f2")
        up = np.where(up.astype(np.float64) < sums, np.nextafter(up, np.float16(np.inf)), up)
    return np.array([w.sum()], dtype="<f8").tobytes() + up.astype("<f2").tobytes()


def possible(total: np.ndarray, bins: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of rows can reach the threshold. Two texts share no more weight in a bin
    than the lighter one has there, so a pair that is refused is below it for certain."""
    out = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 8_000):
        x, y = a[at : at + 8_000], b[at : at + 8_000]
        low = np.minimum(bins[x], bins[y]).sum(axis=1, dtype=np.float64)
        out[at : at + 8_000] = low * (1 + threshold) >= threshold * (total[x] + total[y]) * (1 - 1e-6)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: summed minima over summed maxima. Two empty sets are equal."""
    total = a[1].sum() + b[1].sum()
    if total == 0:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (total - low))


def idf_table(docs: DataFrame, text_col: str) -> np.ndarray:
    """ln(1 + N / df) by hashed word, over all documents; at most TABLE rows reach the driver."""

    def make():
        known = WordHashes()

        def work(batch: pa.RecordBatch):
            rows = texts(batch)
            count = np.zeros(TABLE, dtype=np.int64)
            for t in rows:
                count[np.unique(word_hashes(t, known) & np.uint64(TABLE - 1)).astype(np.int64)] += 1
            at = np.flatnonzero(count)
            yield {"slot": [*at.tolist(), -1], "n": [*count[at].tolist(), len(rows)]}

        return work

    got = map_batches(docs.select(F.col(text_col).alias("text")), make, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TABLE)
    rows = 0
    for r in got:
        if r.slot < 0:
            rows = r.n
        else:
            df[r.slot] = r.n
    return np.log1p(rows / np.maximum(df, 1))


def bounded(rows: list[str], at: int) -> list[str]:
    """At most 500 of the texts from a place on, and at most HELD characters of them (or one text)."""
    end, size = at, 0
    while end < len(rows) and end < at + 500 and (end == at or size + len(rows[end]) <= HELD):
        size += len(rows[end])
        end += 1
    return rows[at:end]


def signatures(docs: DataFrame, idf, id_col: str, text_col: str) -> DataFrame:
    """id, row and text keys, bands, samples (16 bits of each), outline of every document."""
    k = BANDS * ROWS

    def make():
        known = WordHashes()
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX

        def work(batch: pa.RecordBatch):
            rows, at = texts(batch), 0
            while at < len(rows):
                part = bounded(rows, at)
                sets = [weighted(word_hashes(t, known), idf.value) for t in part]
                drawn = samples(sets, k)
                bands = np.broadcast_to(salt, (len(part), BANDS)).copy()
                for j in range(ROWS):
                    bands = mixed((bands ^ drawn[:, j::ROWS].astype(np.uint64)) * _MIX)
                keys = [k if len(s[0]) else b"" for k, s in zip(batch.column(3).slice(at, len(part)).to_pylist(), sets, strict=True)]
                yield {
                    "id": batch.column(0).slice(at, len(part)),
                    "row": batch.column(2).slice(at, len(part)),
                    "key": keys,
                    "bands": [b.tolist() if len(s[0]) else [] for b, s in zip(bands.view(np.int64), sets, strict=True)],
                    "drawn": [d.tobytes() for d in (drawn & np.uint32(0xFFFF)).astype("<u2")],
                    "fine": [outline(*x) for x in sets],
                }
                at += len(part)

        return work

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"), text_key(text_col).alias("key"))
    return map_batches(rows, make, f"id {kind}, row binary, key binary, bands array<bigint>, drawn binary, fine binary")


def row_key(id_col: str, text_col: str):
    """A digest of id and text: rows that agree in both are repeats."""
    return F.unhex(F.md5(F.concat_ws("|", F.hex(text_key(text_col)), F.col(id_col).cast("string")).cast("binary")))


def text_key(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def estimated(drawn: np.ndarray) -> np.ndarray:
    """Share of equal samples of every two rows; 0 of a row with itself."""
    near = np.zeros((len(drawn), len(drawn)), dtype=np.float32)
    for column in drawn.T:
        near += column[:, None] == column[None, :]
    np.fill_diagonal(near, 0)
    return near / np.float32(drawn.shape[1])


def partners(keys: list[bytes], drawn: np.ndarray) -> list[tuple]:
    """(key, partner, estimate, is_centre): of each text its likeliest partner, and the chunk's centre."""
    near = estimated(drawn)
    best, centre = near.argmax(axis=1), int(near.sum(axis=1).argmax())
    out = [(keys[i], keys[j], float(near[i, j]), False) for i, j in enumerate(best.tolist()) if near[i, j] >= LIKELY]
    return [*out, (keys[centre], keys[centre], float(len(keys)), True)]


def read_outlines(fine: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(total weights, weights by bin)."""
    total = np.array([np.frombuffer(x, dtype="<f8", count=1)[0] for x in fine])
    return total, np.array([np.frombuffer(x, dtype="<f2", offset=8) for x in fine], dtype=np.float32)


def across(keys: list[bytes], drawn: np.ndarray, fine: list[bytes], classes: list[bytes], most: int, threshold: float) -> list[tuple]:
    """The likely pairs of two classes, of each text its likeliest ones."""
    if len(set(classes)) < 2:
        return []
    own = np.unique(np.array([c.hex() for c in classes]), return_inverse=True)[1]
    near = estimated(drawn) * (own[:, None] != own[None, :])
    most = min(most, len(keys) - 1)
    a, b = np.repeat(np.arange(len(keys)), most), np.argpartition(-near, most - 1, axis=1)[:, :most].ravel()
    likely = near[a, b] >= LIKELY
    a, b = a[likely], b[likely]
    ok = possible(*read_outlines(fine), a, b, threshold)
    return [(keys[i], keys[j], 1.0, False) for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True)]


def still_possible(keys: list[bytes], drawn: np.ndarray, fine: list[bytes], classes: list[bytes], sides: list[int], bands: np.ndarray, this: int, threshold: float, each: bool) -> list[tuple]:
    """Every pair of two classes that the bound allows; rows of two sides pair across only. A
    pair counts in the first band that it shares. With `each`, of each class its likeliest pair."""
    own = np.unique(np.array([c.hex() for c in classes]), return_inverse=True)[1]
    side = np.array(sides)
    if len(set(classes)) < 2:
        return []
    total, bins = read_outlines(fine)
    apart = len(set(sides)) > 1
    left, right = [], []
    for i in range(len(keys) - 1):
        j = np.arange(i + 1, len(keys))
        high = np.maximum(total[j], total[i])
        j = j[(own[j] != own[i]) & (np.minimum(total[j], total[i]) >= threshold * high * (1 - 1e-6)) & ((side[j] != side[i]) if apart else True)]
        if len(j):
            j = j[possible(total, bins, np.full(len(j), i), j, threshold)]
        if len(j):
            j = j[bands[j, (bands[j] == bands[i]).argmax(axis=1)] == this]
            left.append(np.full(len(j), i))
            right.append(j)
    if not left:
        return []
    a, b = np.concatenate(left), np.concatenate(right)
    if each and len(a):
        near = np.concatenate([(drawn[a[at : at + 50_000]] == drawn[b[at : at + 50_000]]).mean(axis=1) for at in range(0, len(a), 50_000)])
        order = np.argsort(-near, kind="stable")
        a, b = a[order], b[order]
        best = np.union1d(np.unique(own[a], return_index=True)[1], np.unique(own[b], return_index=True)[1])
        a, b = a[best], b[best]
    return [(keys[i], keys[j], 1.0, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def by_chunk(members: DataFrame, step: str, threshold: float = THRESHOLD, most: int = 3) -> DataFrame:
    """Pairs of the members (band, chunk, other, key, drawn, class, fine, bands). A task is a
    band's chunk, or two of its chunks. step: "first", "likeliest", "each" or "all"."""
    two = step in ("each", "all")

    def pairs(held: list[list], band: int) -> list[tuple]:
        if len(held) < 2:
            return []
        drawn = np.frombuffer(b"".join(x[1] for x in held), dtype="<u2").reshape(len(held), -1)
        keys = [x[0] for x in held]
        if step == "first":
            found = partners(keys, drawn)
        elif step == "likeliest":
            found = across(keys, drawn, [x[3] for x in held], [x[2] for x in held], most, threshold)
        else:
            found = still_possible(keys, drawn, [x[3] for x in held], [x[2] for x in held], [x[4] for x in held], np.array([x[5] for x in held]), band, threshold, step == "each")
        return [(band, *f) for f in found]

    def run(batches):
        held: list[list] = []
        last = None
        out: list[tuple] = []
        for batch in batches:
            for band, low, high, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, low, high) != last:
                    out += pairs(held, last[0]) if last else []
                    held, last = [], (band, low, high)
                    if len(out) > 10_000:
                        yield rows(out)
                        out = []
                held.append(row)
        out += pairs(held, last[0]) if last else []
        yield rows(out)

    kinds = {"band": pa.int64(), "key": pa.binary(), "partner": pa.binary(), "near": pa.float64(), "centre": pa.bool_()}

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], type=t) for i, t in enumerate(kinds.values())], names=list(kinds))

    other = F.col("other") if two else F.col("chunk")
    columns = ["key", "drawn"] + ["class", "fine"] * (step != "first") + ["chunk", "bands"] * two
    dealt = members.select("band", F.least("chunk", other).alias("low"), F.greatest("chunk", other).alias("high"), *columns)
    dealt = dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "key")
    return dealt.mapInArrow(run, "band bigint, key binary, partner binary, near double, centre boolean")


def divided(members: DataFrame) -> DataFrame:
    """The members of the buckets that hold more than one class."""
    kept = members.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("band")
    return members.join(kept, "band", "left_semi")


def paired_chunks(members: DataFrame) -> DataFrame:
    """members of divided buckets once for each pair of chunks (chunk, other) that they are
    in: a bucket's largest class and the rest of it are cut apart, and only pairs with a
    chunk of the rest are made. A bucket of up to CHUNK texts is one chunk."""
    sizes = members.groupBy("band", "class").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("band").agg(F.max_by("class", F.struct("n", "class")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n_all"), F.count("*").alias("n_classes")).where("n_classes > 1")
    rest = F.when(F.col("n_all") <= CHUNK, 1).otherwise(F.ceil((F.col("n_all") - F.col("n_top")) / CHUNK))
    top = F.when(F.col("n_all") <= CHUNK, 0).otherwise(F.ceil(F.col("n_top") / CHUNK))
    m = members.drop("chunk", "n").join(bands.select("band", "top", rest.cast("long").alias("rest"), top.cast("long").alias("tops")), "band")
    leads = (F.col("class") == F.col("top")) & (F.col("tops") > 0)
    h = F.xxhash64("key", "band")
    m = m.withColumn("leads", leads).withColumn("chunk", F.when(leads, F.col("rest") + F.pmod(h, F.col("tops"))).otherwise(F.pmod(h, F.col("rest"))))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("leads"), F.col("rest")).otherwise(F.col("rest") + F.col("tops")) - 1)
    return m.withColumn("other", F.explode(others)).drop("top", "rest", "tops", "leads")


def ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def first_pairs(members: DataFrame) -> DataFrame:
    """Of each text its likeliest partner, and the centre of its largest bucket of several chunks."""
    found = materialise(by_chunk(members, "first"), "partners")
    best = found.where("not centre").groupBy("key").agg(F.max_by("partner", F.struct("near", "partner")).alias("partner"))
    middle = found.where("centre").groupBy("band").agg(F.max_by("partner", F.struct("near", "partner")).alias("partner"))
    largest = members.join(middle, "band").where("key <> partner").groupBy("key").agg(F.max_by("partner", F.struct("n", "partner")).alias("partner"))
    return ordered(best.union(largest), "key", "partner").distinct()


def packed(own: tuple[np.ndarray, np.ndarray]) -> bytes:
    """A weighted set: the hashes (8 bytes each), then the weights (4 bytes each)."""
    return own[0].astype("<u8").tobytes() + own[1].astype("<f4").tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, dtype="<u8", count=n), np.frombuffer(raw, dtype="<f4", offset=8 * n).astype(np.float64)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose weighted sets reach the threshold. sets: key, own of each text with a partner."""
    rows = pairs.join(sets.select(F.col("key").alias("b"), F.col("own").alias("own_b")), "b")
    rows = rows.join(sets.select(F.col("key").alias("a"), F.col("own").alias("own_a")), "a").select("a", "b", "own_a", "own_b")

    def make():
        def work(batch: pa.RecordBatch):
            near = [similarity(unpacked(x.as_py()), unpacked(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array([i for i, s in enumerate(near) if s >= threshold], type=pa.int64())
            yield {"a": batch.column(0).take(keep), "b": batch.column(1).take(keep), "similarity": [near[i] for i in keep.to_pylist()]}

        return work

    return map_batches(rows, make, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(key, class): the lowest key of each connected group of links (a, b)."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("key"), F.least("a", "low").alias("class")), "labels")
    while True:
        # The lowest class among a text and its neighbours, then a shortcut over that class's own class.
        around = both.join(label.select(F.col("key").alias("b"), F.col("class")), "b").groupBy("a").agg(F.min("class").alias("low"))
        lower = label.join(around.withColumnRenamed("a", "key"), "key").select("key", F.least("class", "low").alias("class"), F.col("class").alias("was"))
        jump = label.select(F.col("key").alias("class"), F.col("class").alias("next"))
        new = materialise(lower.join(jump, "class").select("key", F.least("class", "next").alias("class"), "was"), "labels")
        if new.where("class <> was").isEmpty():
            return new.select("key", "class")
        label = new.select("key", "class")


def joined_classes(label: DataFrame, links: DataFrame) -> DataFrame:
    """(key, class) after more links: the classes that a link joins become one. Only classes
    are linked up anew, and those are few after the first round."""
    ends = links.select("a", "b").join(label.select(F.col("key").alias("a"), F.col("class").alias("x")), "a", "left").join(label.select(F.col("key").alias("b"), F.col("class").alias("y")), "b", "left")
    ends = materialise(ends.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")), "links")
    new = components(ordered(ends, "x", "y").where("a <> b").distinct()).select(F.col("key").alias("class"), F.col("class").alias("new"))
    alone = ends.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(label, "key", "left_anti").select("key", F.col("key").alias("class"))
    return materialise(label.unionByName(alone).join(new, "class", "left").select("key", F.coalesce("new", "class").alias("class")), "labels")


def weighted_sets(docs: DataFrame, signed: DataFrame, members: DataFrame, idf, id_col: str, text_col: str) -> DataFrame:
    """(key, own): the weighted set of each key of members, from one of its rows."""
    first = signed.join(members.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.join(first, "row").select("key", "text")

    def make():
        known = WordHashes()

        def work(batch: pa.RecordBatch):
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                yield {"key": [key.as_py()], "own": [packed(weighted(word_hashes(text.as_py(), known), idf.value))]}

        return work

    # Rows that agree in id and text have one key and equal sets.
    return map_batches(rows, make, "key binary, own binary").dropDuplicates(["key"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, row, class) of every document; class is the key of one of its texts."""
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(docs, text_col))
    signed = materialise(signatures(docs, idf, id_col, text_col), "signatures")
    # Of equal texts one counts: the copies of a band's rows are dropped before any grouping.
    bands = signed.select("key", F.explode("bands").alias("band")).distinct()
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    drawn = signed.groupBy("key").agg(F.min(F.struct("drawn", "fine", "bands")).alias("s")).select("key", "s.drawn", "s.fine", "s.bands")
    chunks = F.ceil(F.col("n") / CHUNK)
    chunk = F.pmod(F.xxhash64("key", "band"), chunks).alias("chunk")
    members = materialise(bands.join(shared, "band").select("band", "key", chunk, "n").join(drawn, "key"), "members")
    sets = materialise(weighted_sets(docs, signed, members, idf, id_col, text_col), "sets")
    tested = materialise(first_pairs(members), "pairs")
    links = materialise(verified(tested, sets, threshold), "links")
    label = components(links)
    for step in ("likeliest", "each", "all"):
        known = members.join(label, "key", "left").withColumn("class", F.coalesce("class", "key"))
        found = by_chunk(divided(known) if step == "likeliest" else paired_chunks(known), step, threshold)
        fresh = materialise(ordered(found, "key", "partner").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = materialise(verified(fresh, sets, threshold), "links")
        tested = tested.union(fresh)
        if not more.isEmpty():
            label = joined_classes(label, more)
    return signed.select("id", "row", "key").join(label, "key", "left").select("id", "row", F.coalesce("class", "key").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id (lowest id of its class), class_size, is_first."""
    named = materialise(classes(docs, id_col, text_col, threshold), "named")
    # Written before the join, so that both sides of it are plain exchanges and a large class can be split.
    size = materialise(named.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "sizes")
    out = named.join(size, "class")
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("is_first"))


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the lowest id, with the columns of docs."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    row = spare(docs, "row")
    kept = classes(docs, id_col, text_col, threshold).groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    found = docs.withColumn(row, row_key(id_col, text_col)).join(kept, row, "left_semi")
    return found.dropDuplicates([row]).select(*docs.columns)
