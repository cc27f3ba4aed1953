"""Token counts against the tokenizers library."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from marginalia.llm import op08_tokens as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_library(spark):
    r = random.Random(2)
    rows = ["", None, "a" * 3000 + " x", "<|endoftext|>a<|endoftext|><|endoftext|> b", "  \x1c\x1d x\x85y   z\n\n  q", "don't I'LL ''s", "²½x١٢ 한국어 中文  \t\t\n", "🙂👍🏽 é"]
    rows += ["".join(r.choice(["th", "e", " ", "\n", "é", "9", "!", "ing", "  ", "X"]) for _ in range(60)) for _ in range(200)]
    lib = Tokenizer.from_file(PATH)
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in rows]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_tokens string")
    got = {x.doc_id: x for x in op.token_counts(docs, PATH, limit=30).collect()}
    assert [got[i].n_tokens for i in range(len(rows))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 30) for i, t in enumerate(rows))
    assert op.token_counts(docs.limit(0), PATH).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import public_tokenizers
    import pytest

    from marginalia.llm import op03_packing, op08_tokens

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert not op08_tokens.unsupported(spec)
    spec["added_tokens"] = [{**t, "lstrip": True} for t in spec["added_tokens"]] or [{"content": "<x>", "id": 3, "lstrip": True}]
    assert op08_tokens.unsupported(spec) and op08_tokens.unsupported({**spec, "added_tokens": [], "normalizer": {"type": "NFC"}})
    path = tmp_path / "other.json"
    path.write_text(json.dumps({**spec, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}))
    with pytest.raises(ValueError):
        op08_tokens.RankMerger(str(path))
    ids = op03_packing.Ids(str(path))
    assert ids.fast is None and len(ids.encode("some words")) == 4 * len(ids.slow("some words"))
