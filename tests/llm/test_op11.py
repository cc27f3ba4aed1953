"""Repair against an enumeration of all edits, and blocks against whole conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from marginalia.llm import op11_repair as op

GRAMMAR = re.compile("(s?(ua)+)?")
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def spoiled(rows):
    """The damage, row by row, from the contract."""
    said = lambda x: " " if x is None else str(x)
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        own = out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(rows, faults):
    """All label strings that cost no more than deleting everything, cheapest and least first."""
    best = (4 * len(rows), "D" * len(rows), ())

    def go(i, cost, labels, made):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and GRAMMAR.fullmatch("".join(x[0][:1] for x in made)):
            best = min(best, (cost, labels, made))
        for role in ("user", "assistant"):
            go(i, cost + 3, labels + "I", (*made, (role, "")))
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, cost + 4, labels + "D", made)
        if faults[i] in ("blank", "duplicate"):
            return
        more = 3 * (faults[i] == "truncated")
        if role[:1] in ("s", "u", "a"):
            go(i + 1, cost + more, labels + "K", (*made, (role, text)))
        for new in ("user", "assistant"):
            go(i + 1, cost + 3 + more, labels + "R", (*made, (new, text)))

    go(0, 0, "", ())
    return best


def search_edits(rows, faults):
    """The same by uniform-cost search over (rows read, last initial)."""
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, labels, i, made = heapq.heappop(heap)
        last = made[-1][0][:1] if made else ""
        if i == len(rows) and last in ("", "a"):
            return cost, labels, made
        if (i, last) in done:
            continue
        done.add((i, last))
        more = []
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, labels + "D", i + 1, made))
            if faults[i] not in ("blank", "duplicate"):
                add = 3 * (faults[i] == "truncated")
                more += [(add, "K", i + 1, (role, text)), *((3 + add, "R", i + 1, (x, text)) for x in ("user", "assistant"))]
        more += [(3, "I", i, (x, "")) for x in ("user", "assistant")]
        for add, label, at, line in more:
            if last + line[0][:1] in ("s", "u", "su", "ua", "au") and line[0]:
                heapq.heappush(heap, (cost + add, labels + label, at, (*made, line)))


def expected(rows, best_edits=search_edits):
    faults = faults_of(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, labels, made = best_edits(rows, faults)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, labels, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def conversations(n, longest, seed):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for _ in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sam"])
            rows.append((conv if conv else None, r.choice([None, *range(7)]), role, r.choice(["Hi.", "So é?", "no end", " \t", "", None, "a.\n", "b", "c! "])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, piece int, gone boolean").repartition(3)


def test_report_equals_enumeration(spark):
    rows = conversations(150, 8, 3)
    own = spoiled(rows)
    got = op.report(frame(spark, rows)).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        rest = own.get(r.conv_id, [])
        assert tuple(r[c] for c in FACTS) == expected(rest), (r, rest)
        if len(rest) <= 3:
            assert expected(rest) == expected(rest, best_edits)
    assert any(not own.get(r.conv_id) for r in got)
    assert op.report(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 4])
def test_blocks_equal_whole_conversations(spark, block, monkeypatch):
    rows = conversations(25, 30, block)
    docs = frame(spark, rows).cache()
    order = lambda d: sorted((tuple(r[c] for c in ("conv_id", *FACTS)) for r in d.collect()), key=repr)
    whole = order(op.report(docs))
    lines = lambda: [(r.role, r.text) for r in op.turns(docs).orderBy("conv", "piece", "place").collect()]
    plain = lines()
    monkeypatch.setattr(op, "BLOCK", block)
    assert order(op.report(docs)) == whole
    assert lines() == plain and plain


def test_table(spark):
    chats = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in chats.select("conv_id", "turn", "role", "text").collect()]
    own = spoiled(rows)
    got = {r.conv_id: r for r in op.report(chats).collect()}
    assert set(got) == {r[0] for r in rows} and len({r.audit for r in got.values()}) > 10
    for conv, r in got.items():
        assert tuple(r[c] for c in FACTS) == expected(own.get(conv, []))


def test_report_equals_sql(spark, tmp_path):
    frame(spark, conversations(200, 9, 8)).write.parquet(f"{tmp_path}/c.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/c.parquet/*.parquet'")
    want = con.sql(op.oracle())
    got = op.report(spark.read.parquet(f"{tmp_path}/c.parquet")).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
