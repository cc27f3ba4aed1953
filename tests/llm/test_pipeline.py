"""The pipeline stage by stage against the operators' results and brute force."""

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import op01_minhash, op02_quality
from marginalia.llm.common import materialise, table

from .test_op06 import plain
from .test_op10 import plain as plain_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "near duplicates", "decontamination", "personal data", "packing"]
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before = rows(docs)
    good = materialise(steps["quality classifier"](spark, docs, SF), "t")
    model = op02_quality.train(docs, table(spark, SF, "labels"))
    want = {i for i, r in before.items() if model.score(op02_quality.measures([r.text]))[0] >= 0.7}
    assert set(rows(good)) == want and good.columns == docs.columns
    first = materialise(steps["near duplicates"](spark, good, SF), "t")
    left = rows(first)
    assert set(left) == {r.class_id for r in op01_minhash.near_duplicates(good).collect()} and first.columns == docs.columns
    texts = [r.text for r in left.values()]
    assert len(set(texts)) == len(texts)
    clean = materialise(steps["decontamination"](spark, first, SF), "t")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hits = dict(zip(left, plain_hits(texts, items), strict=True))
    after = rows(clean)
    assert clean.columns == docs.columns and set(after) == set(left)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)
    for i, (n, hit, _) in hits.items():
        assert len(cut(after[i].text)) == n - hit and (hit or after[i] == left[i])
        assert after[i].n_chars == len(after[i].text) or not hit
    masked = materialise(steps["personal data"](spark, clean, SF), "t")
    done = rows(masked)
    assert masked.columns == docs.columns and set(done) == set(after)
    assert not any(plain(r.text) for r in done.values())
    assert all(done[i].text == r.text for i, r in after.items() if not plain(r.text) and "[ID]" not in done[i].text)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for p in steps["packing"](spark, masked, SF).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == set(done)
    for i, own in pieces.items():
        ids = np.array([*lib.encode(done[i].text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
