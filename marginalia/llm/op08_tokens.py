"""Token counts by rank-synchronous array merging.

A text is cut at the special strings of the vocabulary file, each piece is cut into
pre-tokens, and the pre-tokens of a batch that are not known yet are held as one
ragged array of symbols. In each round every sequence applies its own lowest-ranked
pair, at all of that pair's places at once; when no sequence has a mergeable pair
left, the surviving symbols are counted (or returned as ids).

Within one sequence the lowest-ranked pair cannot be undercut by a pair that its own
merge creates, since a merge is always learnt after its parts; so merging all its
places together, left to right without overlap, gives what merging them one by one
gives.

Null texts are empty and have 0 tokens; repeated rows are counted each; very long
pre-tokens are merged like the others but not remembered. Other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, texts

#: Fixed value: the byte-level split of the vocabulary file's pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of more characters are not remembered; as many others are, at most.
LONG, REMEMBER = 64, 1_000_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def unsupported(spec: dict) -> str:
    """Why a vocabulary file can't be read here; empty if it can: byte-level merges, the
    split above, no normaliser, special strings that take no white space with them."""
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return "its pre-tokens aren't those of plain byte-level merges"
    if spec.get("normalizer") is not None:
        return "it normalises texts"
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        return "its special strings depend on what stands beside them"
    return ""


class RankMerger:
    """Merges of one vocabulary file, applied to ragged arrays of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if why := unsupported(spec):
            raise ValueError(f"{path}: {why}")
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.width = 1 << max(vocab.values()).bit_length()
        self.of_byte = np.array([vocab[s] for _, s in sorted(byte_symbols().items())], dtype=np.int64)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.split = regex.compile(SPLIT)
        self.none = len(pairs)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, number of ids of each word)."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ids = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(raw)), sizes)
        done_ids, done_seq = [], []
        while len(ids):
            pair = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (seq[:-1] == seq[1:]), self.ranks[at], self.none)
            rank = np.append(rank, self.none)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = lowest == self.none
            if over.any():  # whole sequences that are finished
                done_ids.append(ids[over])
                done_seq.append(seq[over])
                keep = ~over
                ids, seq, rank, lowest = ids[keep], seq[keep], rank[keep], lowest[keep]
                if not len(ids):
                    break
            hit = rank == lowest
            # In a run of neighbouring hits (one repeated symbol) every second one counts.
            place = np.arange(len(ids))
            run_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, -1))
            hit &= (place - run_start) % 2 == 0
            ids[hit] = self.made[rank[hit]]
            keep = np.append(True, ~hit[:-1])
            ids, seq = ids[keep], seq[keep]
        if not done_ids:
            return np.zeros(0, dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
        ids, seq = np.concatenate(done_ids), np.concatenate(done_seq)
        order = np.argsort(seq, kind="stable")
        return ids[order], np.bincount(seq, minlength=len(raw))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special strings come as pieces of their own."""
        if self.cut is None or not self.cut.search(text):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.split.findall(text, at, m.start()) if at == m.start() else self.split.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.split.findall(text[at:])


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


class Counts(dict):
    """Token counts by pre-token."""

    def __init__(self, path: str):
        super().__init__()
        self.by = merger(path)

    def learn(self, lists: list[list[str]]) -> None:
        if len(self) > REMEMBER:
            self.clear()
        new = [w for w in set().union(*lists).difference(self) if w not in self.by.specials]
        if new:
            self.update(zip(new, self.by.merge(new)[1].tolist(), strict=True))
        self.update(dict.fromkeys(self.by.specials, 1))

    def forget(self) -> None:
        for w in [w for w in self if len(w) > LONG]:
            del self[w]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row."""

    def make():
        known = Counts(vocabulary)

        def work(batch: pa.RecordBatch):
            rows = texts(batch, "text")
            ids = batch.column(0)
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                lists = [known.by.pieces(t) for t in part]
                known.learn(lists)
                n = [sum(map(known.__getitem__, ws)) for ws in lists]
                known.forget()
                yield {"id": ids.slice(at, len(part)), "n_bytes": [len(t.encode("utf-8")) for t in part], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_batches(rows, make, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
