"""Classes against all pairs compared by plain weighted Jaccard."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import op01_minhash as op


def plain_words(text):
    return op._KEEP and [w.decode() for w in (text or "").encode().translate(op._KEEP).split()]


def plain_sets(texts):
    """Weighted shingles with document frequencies counted word by word (no two words of the tests share a slot)."""
    cut = [plain_words(t) for t in texts]
    df = Counter(w for ws in cut for w in set(ws))
    idf = {w: np.log1p(len(texts) / n) for w, n in df.items()}
    out = []
    for ws in cut:
        k = min(5, len(ws))
        found = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else Counter()
        out.append({s: n * sum(idf[w] for w in s) / k for s, n in found.items()})
    return out


def plain_similarity(a, b):
    keys = {*a, *b}
    high = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / high if high else 1.0


def plain_classes(texts, ids):
    sets, parent = plain_sets(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    margin = []
    for i in range(len(texts)):
        for j in range(i):
            s = plain_similarity(sets[i], sets[j])
            margin.append(abs(s - 0.8))
            if s >= 0.8:
                parent[root(i)] = root(j)
    low = {}
    for i, x in enumerate(ids):
        low[root(i)] = min(low.get(root(i), x), x)
    return [low[root(i)] for i in range(len(texts))], min(margin)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = text(25)
    docs = []
    for _ in range(12):
        base = text(r.choice([3, 8, 60, 200]))
        docs.append(base)
        for _ in range(r.choice([0, 1, 4])):
            edit = list(base)
            for _ in range(r.choice([0, 1, 2])):
                edit[r.randrange(len(edit))] = r.choice(vocab)
            docs.append(edit)
        docs.append(text(30) + shared)
    rows = [" ".join(d) for d in docs] + ["", "?!", None, docs[0][0].upper()]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    want, margin = plain_classes(rows, range(len(rows)))
    assert margin > 1e-6
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(rows)], "doc_id long, text string, class int")
    got = {r.doc_id: r for r in op.near_duplicates(docs).collect()}
    assert [got[i].class_id for i in range(len(rows))] == want
    assert {i: r.class_size for i, r in got.items()} == {i: want.count(c) for i, c in enumerate(want)}
    kept = op.firsts(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_large_bucket_in_chunks(spark, monkeypatch):
    """Near copies of one text over many chunks, and repeated rows, make one class."""
    r = random.Random(5)
    base = [f"w{r.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(90):
        edit = list(base)
        edit[r.randrange(120)] = f"e{i}"
        rows.append(" ".join(edit))
    monkeypatch.setattr(op, "CHUNK", 8)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, *rows[:3], "other words"])] + [(0, rows[0])], "doc_id long, text string")
    got = op.near_duplicates(docs).collect()
    assert Counter(x.class_id for x in got) == {0: 94, 93: 1}
    assert sorted(x.doc_id for x in op.firsts(docs).collect()) == [0, 93]


def test_samples_agree_as_often_as_sets_are_alike():
    r = np.random.default_rng(3)
    h = np.sort(r.integers(0, 2**63, 300).astype(np.uint64))
    w = r.random(300) + 0.1
    a, b = (h[:250], w[:250]), (h[40:], w[40:] * np.where(np.arange(260) % 5 == 0, 2, 1))
    got = op.samples([a, b], 3000)
    assert abs((got[0] == got[1]).mean() - op.similarity(a, b)) < 0.03
    parts = op.samples([a, b, (h[:0], w[:0])], 36)
    assert (parts[2] == 0).all()


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None), (9, "x")], "doc_id long, text string")
    got = op.near_duplicates(docs).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [(r.doc_id, r.class_id, r.class_size) for r in got[:2]] == [(4, 4, 2), (9, 9, 1)]
    assert op.firsts(docs).count() == 3
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_lines_are_not_refused(spark):
    """Alike by weight but not by distinct shingles, with the likeliest partner elsewhere."""
    line, own = [f"l{i}" for i in range(10)], [f"u{i}" for i in range(40)]
    edit = [f"e{i}" if i % 9 == 4 else w for i, w in enumerate(own)]
    idf = np.ones(op.TABLE)
    known = op.WordHashes()
    a, b = (op.weighted(op.word_hashes(" ".join(line * 30 + x), known), idf) for x in (own, edit))
    assert op.similarity(a, b) > 0.8 and len(np.intersect1d(a[0], b[0])) / len(np.union1d(a[0], b[0])) < 0.6
    drawn, bands = np.zeros((2, 36), dtype="<u2"), np.zeros((2, 12), dtype=np.int64)
    for each in (True, False):
        assert len(op.still_possible([b"a", b"b"], drawn, [op.outline(*a), op.outline(*b)], [b"x", b"y"], [0, 0], bands, 0, 0.8, each)) == 1


def test_no_pair_at_the_threshold_is_refused():
    r = np.random.default_rng(6)
    h = np.sort(r.integers(0, 2**63, 3000).astype(np.uint64) << np.uint64(1))
    sets = []
    for _ in range(60):
        keep = r.random(3000) < r.choice([0.05, 0.9, 0.99])
        sets.append((h[keep], np.exp(r.normal(0, 2, keep.sum())) if r.random() < 0.1 else np.where(np.arange(3000) % 50 == 0, 70_000.0, 1.0)[keep]))
    fine = [op.outline(*x) for x in sets]
    total, bins = op.read_outlines(fine)
    a, b = np.triu_indices(60, 1)
    may = op.possible(total, bins, a, b, 0.8)
    near = np.array([op.similarity(sets[i], sets[j]) for i, j in zip(a, b, strict=True)])
    assert may[near >= 0.8].all() and (near >= 0.8).any() and not may.all()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y")], "doc_id long, text string, row int, _ROW string")
    kept = op.firsts(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 5, "x")]


def test_batches_are_cut_by_bytes(spark):
    from marginalia.llm import common

    def make():
        def work(batch):
            yield {"n": [batch.nbytes]}

        return work

    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 4 << 20).alias("text"))
    sizes = [r.n for r in common.map_batches(rows, make, "n long").collect()]
    assert len(sizes) > 5 and max(sizes) < 2 * common.BATCH_BYTES


def test_star_of_chunks_equals_all_pairs(spark, monkeypatch):
    """Near copies of a text at about the threshold from each other, a few to a chunk: no link is lost."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(90):
        edit = list(base)
        for at in r.sample(range(150), r.choice([2, 3, 3])):
            edit[at] = r.choice(base)
        rows.append(" ".join(edit))
    want, _ = plain_classes(rows, range(len(rows)))
    assert len(set(want)) > 30 and max(Counter(want).values()) > 30
    monkeypatch.setattr(op, "CHUNK", 4)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in op.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_batches_without_links(spark):
    """Likely partners that verification refuses leave batches with no row."""
    sets = [(np.sort(np.arange(100, dtype=np.uint64) * 7 + k), np.ones(100)) for k in range(3)]
    table = spark.createDataFrame([(bytes([i]), op.packed(x)) for i, x in enumerate(sets)], "key binary, own binary")
    pairs = spark.createDataFrame([(b"\x00", b"\x01"), (b"\x01", b"\x02")], "a binary, b binary")
    assert op.verified(pairs, table, 0.8).count() == 0
    assert [r.similarity for r in op.verified(pairs.limit(1), table.withColumn("own", F.lit(op.packed(sets[0]))), 0.8).collect()] == [1.0]
