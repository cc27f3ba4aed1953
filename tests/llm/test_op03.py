"""Packing: every id in one piece, little padding, whole pieces of a power of two."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marginalia.llm import op03_packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, pieces, limit):
    """rows: (doc, ids); documents with equal ids may have equal names."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    pad = 0
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
    for own in seqs.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= limit
        pad += 0 if at & (at - 1) == 0 else limit - at
    for doc, ids in rows:
        own = sorted(by_doc[doc], key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert len(by_doc) == len(rows)
    return pad


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    t = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, t.encode(r.text, add_special_tokens=False).ids + [1]) for r in docs.collect()]
    for group in (1 << 21, 1 << 17):
        pad = check(rows, op.pack(docs, PATH, group_tokens=group).collect(), 2048)
        assert pad < 0.002 * sum(len(x) for _, x in rows)


def test_odd_rows(spark):
    r = random.Random(4)
    texts = ["", None, "a", "x  y", " lead", "trail ", "a\n b", "a\n \nb", "<|endoftext|>", "a <|endoftext|> b", "c\n <|endoftext|>d", "w " * 9000, "é　 ü\xa0 z", "q \x85b", "u \x1cb ​z"]
    texts += ["".join(r.choice(["a", " ", "\n", "  ", "b1", "\t", "<|endoftext|>", "'s", "é"]) for _ in range(r.randrange(40))) for _ in range(300)]
    t = Tokenizer.from_file(PATH)
    rows = [(i if i else None, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in enumerate(texts)]
    docs = spark.createDataFrame([(i if i else None, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, start int")
    check(rows, op.pack(docs, PATH, limit=64).collect(), 64)
    assert op.pack(docs.limit(0), PATH).count() == 0
    twice = op.pack(docs.limit(5).union(docs.limit(5)), PATH).collect()
    assert sum(p.length for p in twice) == 2 * sum(len(x) for _, x in rows[:5])


def solved(sizes, demand, limit, gap):
    """The programme's answer is right if its prices prove it."""
    found = op.relaxation(sizes, demand, limit, gap)
    assert (found.patterns @ sizes <= limit).all() and np.allclose(found.patterns.T @ found.used, demand, rtol=1e-4, atol=1e-4)
    assert op.knapsack(sizes, found.prices, limit)[0] <= 1 + 1e-6  # no pattern is worth more than a sequence
    assert found.used.sum() <= (1 + gap + 1e-5) * (found.prices @ demand)
    assert found.used.sum() >= (demand @ sizes) / limit - 1e-3


@pytest.mark.parametrize("seed", range(3))
def test_linear_programme(seed):
    r = np.random.default_rng(seed)
    sizes = np.unique(r.integers(20, 90, 8))
    solved(sizes, r.integers(1, 60, len(sizes)).astype(float), 100, 0)


def test_linear_programme_of_a_table(spark):
    """All classes of a large table's histogram, with a session up: solved, and soon."""
    r = np.random.default_rng(5)
    rest = np.concatenate((r.integers(1, 2048, 3000), (r.lognormal(5.5, 1, 7000).astype(int) % 2047) + 1))
    by = op.plan({int(k): int(v) for k, v in zip(*np.unique(rest, return_counts=True), strict=True)})
    assert len(by.used) > 100 and by.bound <= by.used.sum() <= 1.0011 * by.bound
    sizes = op.size_classes(2048)
    solved(sizes, np.bincount(np.searchsorted(sizes, rest), minlength=len(sizes)).astype(float)[: len(sizes)] + 1, 2048, 1e-3)


def test_ids_equal_the_library():
    r = random.Random(6)
    known = op.Ids(PATH)
    odd = ["", "\x1c \x1d\x85 x", " 　 ​a", "a" * 5000, " " * 9000 + "x", "\n" * 5000, "x" * 120_000, "<|endoftext|><|endoftext|> x", "don't I'LL 're's", "²½Ⅷ١٢ 한국어 🙂👍🏽"]
    for t in [*odd, *("".join(chr(r.choice([r.randrange(32, 600), r.randrange(0x2000, 0x3100), 32, 10, 9, 97, 0x4E2D])) for _ in range(60)) for _ in range(2000))]:
        assert known.encode(t) == np.array(known.slow(t), dtype="<u4").tobytes(), t[:80]
