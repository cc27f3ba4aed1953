"""Repair of a conversation's structure by weighted finite-state composition.

Three machines are composed: an acceptor of the conversation's rows, an edit transducer
(keep, rerole, delete, insert, each with its cost) and an acceptor of the role grammar
(s?(ua)+)?. The composition is lazy: arcs of a pair of states are made, and kept, when a
path first reaches it. Weights are (cost, labels), compared in that order; the paths of
one pair of states never have labels of which one begins the other at the same cost, so the
smaller weight stays the smaller one whatever follows, and one pass over the rows in order
(the composition's topological order; insertions of one place in the order of GRAMMAR) gives
the shortest path. Its labels fix the result: after a kept system row come user and
assistant in turn.

A row's first fault counts: blank, duplicate (an earlier row of the conversation has the
same role and text), truncated (its last character that isn't blank ends no sentence). Blank
rows and duplicates must go.

Rows stand in the order of turn (nulls first), role and text. Conversations of up to
BLOCK rows and BYTES bytes are streamed conversation by conversation through sorted
partitions. A larger one is ranked by a range sort and cut into blocks of BLOCK rows, and no
task holds more than a block's rows: duplicates come from an aggregation; each block gives
the shortest paths between all pairs of grammar states; a conversation's blocks are chained
from these, which fixes each block's labels; blocks are then rewritten in parallel. Its
digest is one pass over its lines, a batch at a time, as a digest of one string must be.

Null roles and texts are one space (such a text is blank, such a role can't be kept); an
empty role can't be kept either. The rows of null conversations form one conversation.
Repeated rows are duplicates. An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .op09_chat import ranked

START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> initial of a role -> state. In this order every insertion leads to a later state, but for the one that no cheapest path takes.
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, ASSISTANT: {"u": USER}, USER: {"a": ASSISTANT}}
FINAL = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 3, 4, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = {"u": "user", "a": "assistant"}
#: A conversation with more rows or bytes of text is cut into blocks of so many rows.
BLOCK, BYTES = 4096, 32 << 20
WHITE = " \t\n\x0b\x0c\r"

Weights = dict[int, tuple[int, str]]


@lru_cache(maxsize=1 << 14)
def arcs(state: int, initial: str, fault: int) -> tuple[tuple[int, str, int], ...]:
    """(state, label, cost) of the composed machine for a row with this initial and fault."""
    out = [(state, "D", DELETE)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        follow = GRAMMAR[state]
        if initial in follow:
            out.append((follow[initial], "K", KEEP + more))
        out += [(follow[r], "R", REROLE + more) for r in NAMES if r in follow]
    return tuple(out)


def put(weights: dict[int, tuple], state: int, weight: tuple) -> None:
    if state not in weights or weight[:2] < weights[state][:2]:
        weights[state] = weight


def inserted(weights: Weights) -> Weights:
    """The weights after the insertions that may stand here."""
    for state, follow in GRAMMAR.items():
        if state in weights:
            cost, labels = weights[state]
            for role in NAMES:
                if role in follow:
                    put(weights, follow[role], (cost + INSERT, labels + "I"))
    return weights


def paths(symbols: Iterable[tuple[str, int]], state: int = START) -> Weights:
    """The least weight to each state after the rows, which are (initial, fault)."""
    weights = inserted({state: (0, "")})
    for initial, fault in symbols:
        after: Weights = {}
        for at, (cost, labels) in weights.items():
            for to, label, more in arcs(at, initial, fault):
                put(after, to, (cost + more, labels + label))
        weights = inserted(after)
    return weights


def lines(labels: str, rows: Iterable[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows."""
    rows = iter(rows)
    for label in labels:
        role, text = ("", "") if label == "I" else next(rows)
        if label == "D":
            continue
        initial = role[:1] if label == "K" else "a" if state == USER else "u"
        state = GRAMMAR[state][initial]
        yield (role if label == "K" else NAMES[initial]), text


def fault_of(text: str, seen: bool) -> int:
    body = text.rstrip(WHITE)
    return BLANK if not body else DUPLICATE if seen else FINE if body[-1] in ".!?" else TRUNCATED


class Facts:
    """What is counted over the rows of a conversation, or of a part of it, in order."""

    def __init__(self):
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None  # initials and turns at the ends

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        part = Facts()
        part.faults[fault] = 1
        part.first = part.last = initial
        part.low = part.high = turn
        part.turns = turn is not None
        self.join(part)

    def join(self, then: Facts) -> None:
        self.faults = [a + b for a, b in zip(self.faults, then.faults, strict=True)]
        self.illegal += then.illegal
        if then.first is not None:
            self.illegal += self.last is not None and self.last + then.first not in ("su", "ua", "au")
            self.first = then.first if self.first is None else self.first
            self.last = then.last
        if then.low is not None:
            self.turns += then.turns - (self.high == then.low)
            self.low = then.low if self.low is None else self.low
            self.high = then.high

    def said(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal}


def cheapest(weights: Weights) -> tuple[int, str, int]:
    """(cost, labels, state) of the best path that ends where the grammar may."""
    return min((*weights[s], s) for s in FINAL if s in weights)


def keyed(chats: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """key (never null), conv, turn, role, text, gone."""
    gone = F.col(gone) if gone else F.lit(False)
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    key = F.when(F.col(conv).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(conv).cast("string")))
    return chats.select(key.alias("key"), F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), gone.alias("gone"))


_PIECE = "key string, conv {kind}, piece bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, lines array<struct<role:string,text:string>>"


def arrow_of(df: DataFrame, schema: str) -> tuple[object, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = df.sparkSession.range(0).select(F.from_json(F.lit("{}"), schema).alias("x")).schema["x"].dataType
    return struct, to_arrow_schema(struct)


def streamed(rows: DataFrame, order: list[Column], make, schema: str) -> DataFrame:
    """make(key, conv, rows) -> dicts, for each key's rows in order as an iterator of tuples of
    the columns after key and conv; results leave as they come."""
    ship(rows.sparkSession)
    struct, arrow = arrow_of(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out, size = [], 0
        for (key, conv), own in groupby(each, lambda r: r[:2]):
            for made in make((r[2:] for r in own)):
                out.append({"key": key, "conv": conv, **made})
                size += 200 + sum(len(x["text"]) for x in made.get("lines", ()))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(run, struct)


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def small(rows: DataFrame, kind: str) -> DataFrame:
    """A piece for each conversation."""

    def one(own: Iterator[tuple]) -> Iterator[dict]:
        facts, seen, symbols, kept = Facts(), set(), [], []
        for turn, role, text, gone in own:
            if gone:
                continue
            fault = fault_of(text, (role, text) in seen)
            seen.add((role, text))
            facts.add(turn, role[:1], fault)
            symbols.append((role[:1], fault))
            kept.append((role, text))
        cost, labels, _ = cheapest(paths(symbols))
        yield facts.said() | {"piece": 0, "cost": cost, "audit": labels, "lines": [{"role": r, "text": t} for r, t in lines(labels, kept)]}

    return streamed(rows.select("key", "conv", "turn", "role", "text", "gone"), in_order(), one, _PIECE.format(kind=kind))


def large(rows: DataFrame, kind: str) -> DataFrame:
    """A piece for each block of a conversation; piece 0 has the counts and the cost of all."""
    spark = rows.sparkSession
    ship(spark)
    ends = rows.where("gone").select("key", "conv").distinct()  # a conversation may lose all its rows
    placed = ranked(rows.where("NOT gone").drop("gone"), ["key", "turn", "role", "text"])
    first = placed.groupBy("key").agg(F.min("rank").alias("first"))
    placed = materialise(placed.join(first, "key").withColumn("rank", F.col("rank") - F.col("first")).drop("first").withColumn("block", F.floor(F.col("rank") / BLOCK)), "blocks")
    # The earliest row of each role and text; the others are duplicates.
    fresh = placed.groupBy("key", "role", F.sha2("text", 256).alias("digest")).agg(F.min("rank").alias("rank")).select("key", "rank", F.lit(False).alias("seen"))
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(body == "", BLANK).when(F.col("seen"), DUPLICATE).when(body.rlike(r"[.!?]\z"), FINE).otherwise(TRUNCATED)
    flagged = placed.join(fresh, ["key", "rank"], "left").withColumn("seen", F.coalesce("seen", F.lit(True)))
    symbols = flagged.select("key", "conv", "block", "rank", "turn", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))

    block = f"key string, conv {kind}, block bigint, counts array<bigint>, initials string, low bigint, high bigint, paths array<struct<from:int,to:int,cost:bigint,labels:string>>"
    _, arrow = arrow_of(rows, block)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        facts = Facts()
        own = list(zip(table["turn"].to_pylist(), table["initial"].to_pylist(), table["fault"].to_pylist(), strict=True))
        for turn, initial, fault in own:
            facts.add(turn, initial, fault)
        found = [{"from": a, "to": b, "cost": w[0], "labels": w[1]} for a in GRAMMAR for b, w in paths([x[1:] for x in own], a).items()]
        ends = [facts.illegal, facts.turns, *facts.faults]
        same = {c: table[c][0].as_py() for c in ("key", "conv", "block")}
        return pa.Table.from_pylist([same | {"counts": ends, "initials": facts.first + "\0" + facts.last, "low": facts.low, "high": facts.high, "paths": found}], schema=arrow)

    parts = symbols.groupBy("key", "block").applyInArrow(one, block)

    def chain(own: Iterator[tuple]) -> Iterator[dict]:
        facts, best, many = Facts(), {START: (0, "", None)}, 0
        for _, counts, initials, low, high, found in own:
            part = Facts()
            part.illegal, part.turns, *part.faults = counts
            part.first, part.last = initials.split("\0")
            part.low, part.high = low, high
            facts.join(part)
            many += 1
            after: dict = {}
            for x in found:
                if x["from"] in best:
                    cost, labels, _ = best[x["from"]]
                    put(after, x["to"], (cost + x["cost"], labels + x["labels"], (best[x["from"]][2], x["from"], x["labels"])))
            best = after
        cost, _, state = min((best[s][0], best[s][1], s) for s in FINAL if s in best)
        step, steps = best[state][2], []
        while step:
            steps.append(step)
            step = step[0]
        for k, (_, begin, labels) in enumerate(reversed(steps)):
            yield (facts.said() if k == 0 else {}) | {"block": k, "cost": cost if k == 0 else None, "begin": begin, "labels": labels}

    chosen = streamed(parts, [F.col("block")], chain, f"key string, conv {kind}, block bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, begin int, labels string")
    chosen = materialise(chosen, "labels")
    _, final = arrow_of(rows, _PIECE.format(kind=kind))

    def write(table: pa.Table, by: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        x = by.to_pylist()[0]
        made = lines(x["labels"], zip(table["role"].to_pylist(), table["text"].to_pylist(), strict=True), x["begin"])
        facts = {k: x[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        return pa.Table.from_pylist([{"key": x["key"], "conv": x["conv"], "piece": x["block"], **facts, "audit": x["labels"], "lines": [{"role": r, "text": t} for r, t in made]}], schema=final)

    out = placed.select("key", "block", "rank", "role", "text").groupBy("key", "block").cogroup(chosen.groupBy("key", "block")).applyInArrow(write, _PIECE.format(kind=kind))
    zero = [F.lit(0).cast("long").alias(c) for c in ("piece", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = ends.join(first, "key", "left_anti").select("key", "conv", *zero, F.lit("").alias("audit"), F.array().cast("array<struct<role:string,text:string>>").alias("lines"))
    return out.unionByName(none)


def repaired(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of repaired conversations: those with one piece, and those in blocks (None if
    there are none). A row marked in the column `gone` only names its conversation."""
    kind = dict(chats.dtypes)[conv]
    rows = keyed(chats, conv, turn, role, text, gone)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    # Fewer than one in BLOCK rows is a key here, or one for each BYTES; usually none.
    crowds = materialise(sizes.where((F.col("n") > BLOCK) | (F.col("bytes") > BYTES)).select("key"), "crowds")
    if crowds.isEmpty():
        return small(rows, kind), None
    return small(rows.join(crowds, "key", "left_anti"), kind), large(rows.join(crowds, "key", "left_semi"), kind)


def turns(chats: DataFrame, **columns) -> DataFrame:
    """The repaired conversations row by row: conv, piece, place, role, text."""
    one, many = repaired(chats, **columns)
    pieces = one if many is None else one.unionByName(many)
    return pieces.select("conv", "piece", F.posexplode("lines").alias("place", "line")).select("conv", "piece", "place", "line.role", "line.text")


_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digested(pieces: DataFrame, kind: str) -> DataFrame:
    """One row per conversation of many pieces: their labels, and the digest of their lines."""

    def one(own: Iterator[tuple]) -> Iterator[dict]:
        made, labels, sha, begun = None, [], hashlib.sha256(), False
        for piece, *facts, audit, text in own:
            made = made or dict(zip(_FACTS, facts, strict=True))
            labels.append(audit)
            for x in text:
                sha.update(f"{'\n' if begun else ''}{x['role']}:{x['text']}".encode())
                begun = True
        yield made | {"audit": "".join(labels), "repaired_sha256": sha.hexdigest()}

    schema = f"key string, conv {kind}, {', '.join(f'{c} bigint' for c in _FACTS)}, audit string, repaired_sha256 string"
    return streamed(pieces.select("key", "conv", "piece", *_FACTS, "audit", "lines"), [F.col("piece")], one, schema).drop("key")


def damaged(chats: DataFrame) -> DataFrame:
    """The rows of conversations as the query's contract spoils them, by a checksum of
    conversation and turn; dropped rows are marked `gone`."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return chats.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), times.alias("_")).drop("_")


def report(chats: DataFrame) -> DataFrame:
    """What the damage left and what its cheapest repair gives, for every conversation."""
    kind = dict(chats.dtypes)["conv_id"]
    one, many = repaired(damaged(chats), gone="gone")
    joined = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    out = one.select("conv", *_FACTS, "audit", F.sha2(joined.cast("binary"), 256).alias("repaired_sha256"))
    if many is not None:
        out = out.unionByName(digested(many, kind))
    return out.withColumnRenamed("conv", "conv_id")


def _crc_table() -> list[int]:
    """The checksum's remainders of the sixteen half bytes."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def oracle() -> str:
    """The report in SQL. The checksum folds half bytes of an ASCII string; weights are
    strings of a padded cost and the labels; two recursions find and then walk the best path."""
    table = f"[{', '.join(map(str, _crc_table()))}]"
    half = lambda acc, x: f"xor(({acc}) >> 4, {table}[1 + ((xor({acc}, {x})) & 15)])"
    step = half(half("acc", "x"), "(x >> 4)")
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda acc, x: {step}), 4294967295)"
    add = lambda w, cost, label: f"lpad(CAST(CAST(substr({w}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({w}, 10) || '{label}'"
    told = lambda cond, w, cost, label: f"CASE WHEN {cond} THEN {add(w, cost, label)} END"
    free, more = "fault NOT IN ('blank', 'duplicate')", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    enter = lambda w, c: f"{told(f'{free} AND initial = {c!r}', w, more, 'K')}, {told(free, w, f'3 + {more}', 'R')}"
    blank = "\\x20\\x09-\\x0D"
    return f"""
    WITH RECURSIVE
    raw AS (SELECT coalesce('+' || conv_id, '-') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
    hit AS (SELECT *, {crc} % 20 AS kind FROM raw),
    hurt AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM hit WHERE kind <> 0),
    placed AS (SELECT key, turn, role, text, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
    rows AS (
      SELECT *, substr(role, 1, 1) AS initial, CASE
        WHEN NOT regexp_matches(text, '[^{blank}]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN regexp_extract(text, '([^{blank}])[{blank}]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
    pairs AS (SELECT key, lag(initial) OVER (PARTITION BY key ORDER BY i) || initial AS pair FROM rows),
    facts AS (
      SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, max(i) AS n FROM rows GROUP BY 1),
    wrong AS (SELECT key, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1),
    best AS (
      SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, '000000000' AS w0, CAST(NULL AS VARCHAR) AS w1, '000000003I' AS w2, '000000006II' AS w3 FROM rows
      UNION ALL
      SELECT key, i, n0, n1, m2, least(n3, {add('m2', 3, 'I')}) FROM (
        SELECT *, least(n2, {add('n0', 3, 'I')}, {add('n1', 3, 'I')}, {add('n3', 3, 'I')}) AS m2 FROM (
          SELECT key, rows.i AS i, {add('w0', 4, 'D')} AS n0, least({add('w1', 4, 'D')}, {told(f"{free} AND initial = 's'", 'w0', more, 'K')}) AS n1,
                 least({add('w2', 4, 'D')}, {enter('w0', 'u')}, {enter('w1', 'u')}, {enter('w3', 'u')}) AS n2, least({add('w3', 4, 'D')}, {enter('w2', 'a')}) AS n3
          FROM best JOIN rows USING (key) WHERE rows.i = best.i + 1))),
    chosen AS (SELECT key, least(w0, w3) AS w FROM best JOIN facts USING (key) WHERE i = n),
    walk AS (
      SELECT key, substr(w, 10) AS labels, CAST(0 AS BIGINT) AS i, '' AS last, CAST([] AS VARCHAR[]) AS lines FROM chosen
      UNION ALL
      SELECT key, substr(labels, 2), CASE WHEN label = 'I' THEN i ELSE i + 1 END, CASE label WHEN 'D' THEN last WHEN 'K' THEN initial ELSE new END,
             CASE label WHEN 'D' THEN lines ELSE list_append(lines, CASE WHEN label = 'K' THEN role WHEN new = 'a' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN label = 'I' THEN '' ELSE text END) END
      FROM (SELECT walk.*, substr(labels, 1, 1) AS label, CASE WHEN last = 'u' THEN 'a' ELSE 'u' END AS new, role, text, initial
            FROM walk LEFT JOIN rows ON rows.key = walk.key AND rows.i = walk.i + 1 WHERE labels <> '')),
    ended AS (SELECT key, lines FROM walk WHERE labels = '')
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(CAST(substr(w, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(w, 10), '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT key, conv_id FROM raw) AS c LEFT JOIN facts USING (key) LEFT JOIN wrong USING (key) LEFT JOIN chosen USING (key) LEFT JOIN ended USING (key)"""
