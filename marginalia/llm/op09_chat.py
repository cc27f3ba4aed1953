"""Chat formatting by perspective rotation.

Every participant of a conversation (each role but the system's) gets a rendering of
the dialogue in which its turns are the assistant's and all others' are a named user's;
the mask marks the characters of the assistant's turns.

A conversation is rendered in blocks of 64 turn numbers (a short one is one block), so
the rows that meet in one place are bounded however long it is. A crowded turn, with over
64 rows of one number, cuts its block into segments: the turns before it, the turn itself
and the turns after it. Its rows are ranked over the whole table by a range sort and cut
into parts of 64 in that order. The pieces of a rendering in the order of block, segment
and part, one after another, are the rendering of the whole conversation; the places of a
mask count from the start of its piece.

Repeated rows (equal conversation, turn, role and text) are one turn. Ties of a turn
stand in the order of role and text. Null roles are the participant "unknown", null
texts are empty, null turns count as -1, rows of null conversations form one
conversation. Marker strings inside texts are broken by a blank. Conversations with the
system alone have no rendering. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 64
OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>", "system"


def escaped(text: Column) -> Column:
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "<| ")))
    return text


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `rank`, their place in the order of the columns: a sort by ranges, and the
    rows of all ranges before one's own. Only a count for each range is gathered."""
    order = [F.col(c).asc_nulls_first() for c in by]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = F.monotonically_increasing_id()
    dealt = materialise(dealt.select("*", F.shiftright(placed, 33).alias("range"), placed.bitwiseAND((1 << 33) - 1).alias("place")), "ranked")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range of the sort
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return dealt.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("place")).drop("range", "place", "before")


def turns(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns with their block, segment and part."""
    rows = chats.select(
        F.col(conv).alias("conv"), F.coalesce(turn, F.lit(-1)).cast("long").alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), escaped(F.coalesce(text, F.lit(""))).alias("text")
    ).distinct()
    block = F.floor(F.col("turn") / BLOCK)
    crowd = materialise(rows.groupBy("conv", "turn").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("conv").alias("_c"), F.col("turn").alias("_t")), "crowds")
    inside = crowd.groupBy("_c", F.floor(F.col("_t") / BLOCK).alias("_b")).agg(F.sort_array(F.collect_list("_t")).alias("crowds"))  # at most BLOCK of them
    rows = rows.withColumn("block", block).join(inside, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left").drop("_c", "_b")
    earlier = F.size(F.filter("crowds", lambda t: t < F.col("turn")))
    alone = F.array_contains("crowds", F.col("turn"))
    rows = rows.select("conv", "turn", "role", "text", "block", F.coalesce(2 * earlier + alone.cast("int"), F.lit(0)).cast("long").alias("segment"), F.coalesce(alone, F.lit(False)).alias("crowded"))
    calm = rows.where(~F.col("crowded")).drop("crowded").withColumn("part", F.lit(0).cast("long"))
    if crowd.isEmpty():
        return calm
    full = ranked(rows.where("crowded").drop("crowded"), ["conv", "turn", "role", "text"])
    # Written, so that the join's sides are plain exchanges and the rows of one turn can be split.
    first = materialise(full.groupBy("conv", "turn").agg(F.min("rank").alias("first")), "firsts").select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "first")
    full = full.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")))
    return calm.unionByName(full.select("conv", "turn", "role", "text", "block", "segment", F.floor((F.col("rank") - F.col("first")) / BLOCK).alias("part")))


def rendered(turns_: Column, who: Column) -> tuple[Column, Column]:
    """(text, mask): the turns as the participant sees them; array<struct<start, end>>."""

    def head(x: Column) -> Column:
        return F.when(x["role"] == who, F.lit(f"{OPEN}assistant\n")).when(x["role"] == SYSTEM, F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), x["role"], F.lit("\n")))

    parts = F.transform(turns_, lambda x: F.struct((x["role"] == who).alias("own"), head(x).alias("head"), F.concat(x["text"], F.lit(CLOSE)).alias("body")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["head"])
        end = start + F.char_length(x["body"])
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.array_append(acc["mask"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["mask"]).alias("mask"))

    text = F.array_join(F.transform(parts, lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    return text, F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("mask")), add, lambda acc: acc["mask"])


def perspectives(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation, participant and block: rendered text and mask."""
    rows = turns(chats, conv, turn, role, text)
    who = rows.where(F.col("role") != SYSTEM).select(F.col("conv").alias("_conv"), F.col("role").alias("participant")).distinct()
    blocks = rows.groupBy("conv", "block", "segment", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # at most BLOCK^2 turns
    out = blocks.join(who, F.col("conv").eqNullSafe(F.col("_conv")))
    said, mask = rendered(F.col("turns"), F.col("participant"))
    own = F.size(F.filter("turns", lambda x: x["role"] == F.col("participant")))
    return out.select(F.col("conv").alias(conv), "participant", "block", "segment", "part", F.size("turns").alias("n_turns"), own.alias("n_own"), said.alias("rendered"), mask.alias("mask"))


def report(chats: DataFrame) -> DataFrame:
    """perspectives() with the mask as start:end, comma-joined."""
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return perspectives(chats).withColumn("mask", spans).select(
        "conv_id", "participant", "block", "segment", "part", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_own").cast("long").alias("n_own"), "rendered", "mask"
    )


ORACLE = f"""
    WITH t AS (
        SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role,
               replace(replace(coalesce(text, ''), '{OPEN}', '<| im_start|>'), '{CLOSE}', '<| im_end|>') AS text
        FROM conversations),
    who AS (SELECT DISTINCT conv_id AS c, role AS participant FROM t WHERE role <> '{SYSTEM}'),
    many AS (SELECT *, CAST(floor(turn / {BLOCK}.0) AS BIGINT) AS block, count(*) OVER (PARTITION BY conv_id, turn) > {BLOCK} AS crowded,
                    row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) - 1 AS place FROM t),
    cut AS (SELECT a.*, CASE WHEN crowded THEN place // {BLOCK} ELSE 0 END AS part,
                   (SELECT 2 * count(DISTINCT b.turn) FROM many b WHERE b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.block = a.block AND b.crowded AND b.turn < a.turn) + CAST(crowded AS INT) AS segment FROM many a),
    seg AS (
        SELECT conv_id, participant, block, segment, part, turn, role, text, role = participant AS own,
               '{OPEN}' || CASE WHEN role = participant THEN 'assistant' WHEN role = '{SYSTEM}' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
               text || '{CLOSE}' AS body
        FROM cut JOIN who ON conv_id IS NOT DISTINCT FROM c),
    placed AS (
        SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, block, segment, part ORDER BY turn, role, text) - length(body) - 1 AS start
        FROM seg)
    SELECT conv_id, participant, block, CAST(segment AS BIGINT) AS segment, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
           count(*) FILTER (own) AS n_own,
           string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS rendered,
           coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY turn, role, text) FILTER (own), '') AS mask
    FROM placed GROUP BY conv_id, participant, block, segment, part
"""
