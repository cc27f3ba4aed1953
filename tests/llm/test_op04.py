"""Digests and neighbours against plain versions."""

import hashlib
import random

import numpy as np

from marginalia.llm import op04_fingerprint as op


def plain_counts(raw):
    raw = raw if len(raw) >= 5 else raw.ljust(5, b"\0")
    out = [0] * op.BUCKETS
    for i in range(4, len(raw)):
        for a, b, c, salt in op.TRIPLETS:
            h = (raw[i - a] * 0x9E3779B1 + raw[i - b] * 0x85EBCA77 + raw[i - c] * 0xC2B2AE3D + salt * 0x27D4EB2F) % 2**32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            out[h >> 25] += 1
    return out


def test_counts_equal_plain(monkeypatch):
    r = random.Random(1)
    data = [bytes(r.randrange(97, 110) for _ in range(n)) for n in (0, 1, 4, 5, 6, 50, 0, 300, 3, 64, 65, 128, 700)]
    want = [plain_counts(x) for x in data]
    for chunk in (64, 1 << 20):
        monkeypatch.setattr(op, "CHUNK", chunk)
        assert op.bucket_counts(data).tolist() == want


def test_digest_strings_and_likeness():
    data = [b"some longer text about things " * 9, b"some longer text about thinks " * 9, b"", b"other words"]
    d = op.digests(data)
    back = op.decoded(op.encoded(d))
    assert (back[0] == d[0]).all() and (back[1] == d[1]).all()
    near = op.likeness(tuple(x[[0, 0, 0]] for x in d), tuple(x[[0, 1, 2]] for x in d))
    assert near[0] == 1 and 1 > near[1] > near[2] >= 0
    assert np.unique(op.encoded(op.digests([b"same", b"same"]))).size == 1


def test_neighbours(spark):
    r = random.Random(2)
    rows = [(i * 7 % 101, "".join(r.choice("ab é🙂") for _ in range(r.choice([0, 2, 5, 90]))), "z") for i in range(101)]
    rows += [(5, "repeated id", "z"), (None, "no id", "z"), (7, None, "z")]
    got = op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert len(got) == len(order)
    want = {}
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        k3 = len(t) // 3
        e = t[: len(t) - k3] + n[:k3]
        a, b, c = (op.digests([x.encode()]) for x in (t, e, n))
        want.setdefault(i, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), op.encoded(a)[0], op.encoded(b)[0], float(op.likeness(a, b)[0]), float(op.likeness(a, c)[0])))
    for i, own in want.items():
        assert sorted(tuple(x)[1:] for x in got if x.doc_id == i) == sorted(own)


def test_single_and_empty(spark):
    one = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert op.fingerprints(one).collect()[0].near_next == 1
    assert op.fingerprints(one.limit(0)).count() == 0


def test_one_id_for_many_rows(spark):
    """A hot id and repeated rows spread over partitions; every row has its neighbour."""
    rows = [(7, f"text {i % 50} of one id", i) for i in range(400)] + [(9, "before", 0), (1, "after", 0)]
    got = op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(4)).collect()
    assert len(got) == len(rows)
    texts = ["before", *sorted((t for i, t, _ in rows if i == 7), key=lambda t: (t[:64], t)), "after"]
    want = sorted(hashlib.sha256(op.edited(t, n).encode()).hexdigest() for t, n in zip(texts, texts[1:] + texts[:1], strict=True))
    assert sorted(r.edited_sha256 for r in got) == want
