"""The classifier on held-out rows, against a plain pair loss, and on odd inputs."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import op02_quality as op

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = op.train(docs, labels)
    got = {r.doc_id: r for r in op.scores(docs, model).collect()}
    assert len(got) == docs.count()
    truth = [(got[r.doc_id], r.quality) for r in labels.collect()]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) and g.predicted == (g.score >= 0.7) for g, _ in truth)
    held = [(g.predicted, q) for g, q in truth if g.held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95
    kept = op.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_worth_lowers_pair_loss():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * r.normal(size=400) > 0.8).astype(int)
    m = op.fit(x, y, pairs=4000)
    s = m.worth(x)
    loss = np.mean(np.log1p(np.exp(-(s[y == 1][:, None] - s[y == 0][None, :]))))
    assert loss < 0.3 < np.log(2)
    assert ((m.score(x) >= op.ACCEPT) == (s >= m.threshold)).all()


def test_byte_counts_in_slices(monkeypatch):
    data = [b"abc" * 5, b"", b"zz", b"q" * 40, b"ab"]
    want = [np.bincount(np.frombuffer(d, dtype=np.uint8), minlength=256).tolist() for d in data]
    for chunk in (7, 1 << 20):
        monkeypatch.setattr(op, "CHUNK", chunk)
        assert op.byte_counts(data).tolist() == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (None, None, 3), (2, "", 4), (3, "x " * 50_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert len(op.scores(docs, op.train(docs, labels)).collect()) == 5
    assert op.scores(docs, op.train(docs, labels.limit(0))).where("score <> 0.5").count() == 0
    assert op.scores(docs.limit(0), op.train(docs, labels.limit(0))).count() == 0
    two = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    got = op.scores(docs.withColumn("x", F.lit(1)), op.train(docs, two)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
