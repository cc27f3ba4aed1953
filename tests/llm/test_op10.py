"""The FM-index search against a plain scan."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import op10_decontaminate as op


def plain(docs, items):
    """(n_words, n_hit, items) of each document by comparing every window."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    windows = {}
    for i, t in items:
        ws = cut(t)
        for k in range(max(1, len(ws) - 9) if ws else 0):
            windows.setdefault(tuple(ws[k : k + 10]), set()).add(str(i))
    for t in docs:
        ws = cut(t)
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if own := windows.get(tuple(ws[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((len(ws), len(hit), sorted(found)))
    return out


def cases(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "É", "c9", "d"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 14, 40]) if seed % 2 else r.choice([10, 12, 30]))) for i in range(6)] + [(90, None), (91, " ?! ")]
    items += [(50, items[0][1])]
    docs = [text(r.randrange(60)) for _ in range(30)] + [None, "", "--"]
    docs += [text(5) + t.upper() + text(4) + (t or "") for _, t in items[:6] if t]
    return docs, items


@pytest.mark.parametrize("seed", range(8))
def test_search_equals_plain_scan(seed):
    docs, items = cases(seed)
    block = op.Windows([(str(i), t) for i, t in items if op.words(t)])
    got = op.search_shard([op.word_ids(t, block.ids) for t in docs], block)
    for (n, hit, found), t, (spans, own) in zip(plain(docs, items), docs, got, strict=True):
        assert n == len(op.words(t))
        assert hit == sum(b - a for a, b in op.merged(spans))
        assert found == own


@pytest.mark.parametrize("limit", [5, 1000])
def test_report_and_removal(spark, limit):
    docs, items = cases(3)
    rows = [(i if i else None, t, i) for i, t in enumerate(docs)]
    left = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = {(r.doc_id): r for r in op.report(left, right, limit=limit).collect()}
    for i, (n, hit, found) in enumerate(plain(docs, items)):
        r = got[i or None]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    clean = op.remove(left, right, limit=limit)
    assert clean.columns == left.columns
    for r in clean.collect():
        n, hit, _ = plain(docs, items)[r.item_id]
        assert len(op.words(r.text)) == n - hit
        if not hit:
            assert r.text == docs[r.item_id]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.report(docs, none).collect()[0].n_words == 3
    assert op.report(docs.limit(0), none).count() == 0


def test_names_of_items_and_clashing_columns(spark):
    long = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"so {long} it is", "a", 5, [7], "z"), (2, None, "b", 6, None, None), (1, f"so {long} it is", "a", 5, [7], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _items string, n_words int, starts_found array<int>, ITEMS_found string")
    items = spark.createDataFrame([("q1", long), ("q10", long), ("q2", "so"), (None, long)], "item_id string, text string")
    for limit in (1, 1000):
        got = op.report(docs, items, limit=limit).collect()
        assert {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got} == {(1, 14, 12, 3), (2, 0, 0, 0)} and len(got) == 3
        assert {r.items_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"q1,q10,q2").hexdigest()}
        clean = op.remove(docs, items, limit=limit)
        assert clean.columns == docs.columns
        assert sorted(map(str, clean.collect())) == sorted(map(str, spark.createDataFrame([(i, t and " it is", *r) for i, t, *r in rows], docs.schema).collect()))
