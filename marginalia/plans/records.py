"""Queries over ordered records, findings, quantities, drafts and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, influence, narrative, retrieval, sequences, units
from . import runner

#: Pairs of quantities that line items give, in turn: (name, value, unit, value, unit, whether they clash), as SQL
#: that Spark and DuckDB both read. q is the quantity, 1 to 50; e is 0, 1 or 2 and puts the second value off.
_TENTHS = "CAST(floor(({0}) / 10) AS INT) || '.' || ({0}) % 10"
PAIRS = [
    ("power", "q", "MW", "q * 1000 + 600 * e", "kW", "e > 0"), ("small power", "q", "mW", "q", "MW", "true"), ("volts", "q", "V", "q || '.' || 3 * e", "V", "e > 0"),
    ("torque", "q", "Nm", _TENTHS.format("CAST(floor((7376 * q + 500) / 1000) AS INT) + 10 * e"), "lb-ft", "e > 0"), ("range", "q || '–' || (q + 10)", "Nm", "q + 7 * e", "Nm", "e = 2"),
    ("temperature", "q", "°C", "q + e", "C", "e > 0"), ("two scales", "q", "°C", _TENTHS.format("18 * q + 320 + 20 * e"), "°F", "false"), ("mixed", "q", "kg", "q + e", "m", "false"), ("unknown", "q", "foo", "q + e", "foo", "false"), ("thousands", "'1,' || (500 + 2 * q)", "mm", "'1.5'", "m", "q > 25"),
]
#: A register of pressures in bar and kilopascals, by part and way of shipping; some lines name no part.
REGISTER = (
    "CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'part ' || l_partkey END AS component", "lower(l_returnflag) AS quantity", "l_linenumber % 2 = 1 AS bar",
    "CAST(l_quantity AS INT) * CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 100 END + CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE 30 * (l_orderkey % 3) END AS x",
)
STATES = ("proposed", "accepted", "rejected", "superseded")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs_sql(*extra: str) -> list[str]:
    """Columns name, a, a_unit, b, b_unit and those of extra, each chosen by i."""
    cols = ["name", "a", "a_unit", "b", "b_unit", "clash"]
    quoted = lambda c, x: f"'{x}'" if c in ("name", "a_unit", "b_unit") else x if c == "clash" else f"CAST({x} AS VARCHAR(99))"
    pick = lambda c: "CASE i " + " ".join(f"WHEN {i} THEN {quoted(c, p[cols.index(c)])}" for i, p in enumerate(PAIRS)) + " END"
    return [f"{pick(c)} AS {c}" for c in ("name", "a", "a_unit", "b", "b_unit", *extra)]


_LINES = ("l_orderkey", "l_linenumber", f"(l_orderkey + l_linenumber) % {len(PAIRS)} AS i", "CAST(l_quantity AS INT) AS q", "CAST(l_suppkey % 3 AS INT) AS e")


def activity_streaks(spark, sf_dir):
    return sequences.streaks(_read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


def event_runs(spark, sf_dir):
    return sequences.runs(_read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", 3)


def reversals(spark, sf_dir):
    """Events whose id order goes back in time."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return sequences.reversals(e, "user_id", ["event_id"], "at").select("user_id", "event_id", "at", "before")


def order_gaps(spark, sf_dir):
    days = _read(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("long").alias("day"))
    return sequences.gaps(days, "user_id", "day")


def presence(spark, sf_dir):
    """Users as cast and days as chapters."""
    days = _read(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    return sequences.presence(days.select("user_id", (F.col("day") - first).cast("long").alias("c")), "user_id", "c", last - first + 1)


def thread_ends(spark, sf_dir):
    """Roles of conversations as threads over turns."""
    chats = _read(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id") % 97, "role").alias("name"), "turn")
    total = int(chats.agg(F.max("turn")).first()[0]) + 1
    return sequences.dropped(chats, "name", "turn", total).select("name", "mentions", "first", "last", "sections", F.col("tail").cast("long").alias("tail"))


def _findings(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("check"), F.col("user_id").cast("string").alias("subject"), F.lit("").alias("identity"),
        F.concat(F.lit("Event  "), F.col("event_id").cast("string"), F.lit(" of "), F.col("event_type")).alias("title"), F.col("props").alias("evidence"), F.col("event_id").alias("seq"),
    )


def finding_keys(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.select("seq", findings.key(*[F.col(c) for c in ("check", "subject", "identity", "title", "evidence")]).alias("key"))


def finding_caps(spark, sf_dir):
    return findings.capped(_findings(spark, sf_dir).select("check", "title", "seq"), 100)


def triage(spark, sf_dir):
    """Users' purchases of two halves of the events as two runs; some users are dismissed."""
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id")
    return findings.triage(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), e.where("event_id % 7 = 0"))


def unit_truths(spark, sf_dir):
    """Two values that each line item gives for one thing, in ten kinds of quantity, and whether they clash."""
    rows = _read(spark, sf_dir, "lineitem").selectExpr(*_LINES).selectExpr("l_orderkey", "l_linenumber", *_pairs_sql())
    return rows.select("*", units.conflict(F.col("a"), F.col("a_unit"), F.col("b"), F.col("b_unit")).alias("conflict"))


def spec_register(spark, sf_dir):
    """Values that line items state for a part, with the pairs that clash. Equal values are summed up before they meet."""
    rows = _read(spark, sf_dir, "lineitem").selectExpr(*REGISTER).select("component", "quantity", F.col("x").cast("string").alias("value"), F.when(F.col("bar"), "bar").otherwise("kPa").alias("unit"))
    n = rows.groupBy("component", "quantity", "value", "unit").agg(F.count("*").alias("n"))
    bad = units.conflicts(n, ["component", "quantity"]).groupBy("component", "quantity").agg(F.count("*").alias("conflicts"))
    out = n.groupBy("component", "quantity").agg(F.sum("n").alias("uses"), F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "value", "unit"))), "; ").alias("values"))
    named = F.when(F.col("component") == "", "(not named)").otherwise(F.col("component"))
    return out.join(bad, ["component", "quantity"], "left").select(named.alias("component"), "quantity", "uses", "values", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def claim_states(spark, sf_dir):
    """Orders as claims: the latest event of a journal gives the state; every state has a row."""
    journal = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("seq"), F.element_at(F.array(*map(F.lit, STATES)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("action"))
    now = journal.groupBy("claim_id").agg(F.max_by("action", "seq").alias("state"))
    every = spark.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(now.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def version_delta(spark, sf_dir):
    """Two drafts that drop and edit some files: what was added, removed, changed."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel"), F.md5(F.col("text").cast("binary")).alias("h"))
    old, new = d.where("rel % 10 <> 1").select("rel", F.col("h").alias("a")), d.where("rel % 10 <> 2").select("rel", F.when(F.col("rel") % 10 == 3, F.reverse("h")).otherwise(F.col("h")).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return old.join(new, "rel", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("rel", change.alias("change"))


def bm25(spark, sf_dir):
    """The ten best documents of each benchmark item."""
    q = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = retrieval.search(_read(spark, sf_dir, "documents"), q, 10)
    return out.select("query_id", F.col("id").alias("doc_id"), F.round(F.col("score") * 1000).cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def passages(spark, sf_dir):
    """Benchmark items that stand in a document word for word, white space aside."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), "text")
    out = influence.found(_read(spark, sf_dir, "documents"), items)
    return out.select("doc_id", F.col("passage_id").alias("item_id"), "at", "n")


def _manuscripts(spark, sf_dir):
    """Every document as a manuscript of one file, written before the checks read it."""
    files = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ms"), F.lit("text.md").alias("rel"), F.lit(0).alias("file_order"), "text")
    return runner.context(files)


def check_pass(spark, sf_dir):
    """The technical checks over every document, capped per document and check. A check that
    failed would be missing from the rows, so it ends the query with its name. Quotes are no
    column of it, so none are looked up."""
    report = runner.run(_manuscripts(spark, sf_dir), quotes=False)
    if report.failed:
        raise RuntimeError("; ".join(f"{name}: {why}" for name, why in report.failed.items()))
    return report.findings.select("ms", "check", "severity", "title", "section_id", "key")


def time_markers(spark, sf_dir):
    """Time markers of every document in reading order."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ms"), F.lit("").alias("rel"), F.lit("").alias("section_id"), F.lit(0).alias("ord"), F.lit(0).alias("start"), F.coalesce("text", F.lit("")).alias("text"))
    return narrative.moments(d).select(F.col("ms").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), "kind", "text")


def band_order(spark, sf_dir):
    """Candidates of a token budget in the order they are tried: bands 1 and 4 by value, others by value per token."""
    d = _read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("band"), ((F.col("doc_id") * 37) % 101).alias("value"), F.col("n_chars").alias("tokens"))
    from pyspark.sql import Window

    gain = F.when(F.col("band").isin(1, 4), F.col("value").cast("double")).otherwise(F.col("value") / F.greatest("tokens", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("band").orderBy(gain.desc(), "doc_id"))
    return d.select("doc_id", "band", rank.cast("long").alias("rank"))


QUERIES = {
    "activity_streaks": activity_streaks, "event_type_runs": event_runs, "timeline_order_reversals": reversals, "order_gaps": order_gaps, "presence_gaps": presence, "thread_ends": thread_ends,
    "finding_keys": finding_keys, "finding_caps": finding_caps, "triage_delta": triage, "unit_conflict_truth_table": unit_truths, "spec_register": spec_register, "claim_state_counts": claim_states,
    "version_file_delta": version_delta, "check_pass": check_pass, "time_markers": time_markers, "bm25_topk": bm25, "benchmark_passages": passages, "band_order": band_order,
}

_KEY = """substr(sha1(event_type || '|' || user_id || '||' || regexp_replace(trim(regexp_replace(lower('Event  ' || event_id || ' of ' || event_type), '\\s+', ' ', 'g')), '[0-9]', '#', 'g')
    || '|' || regexp_replace(trim(regexp_replace(lower(coalesce(props, '')), '\\s+', ' ', 'g')), '[0-9]', '#', 'g')), 1, 12)"""

_MARKS = " UNION ALL ".join(f"SELECT doc_id, text, {i} AS rank, '{kind}' AS kind, regexp_split_to_array(t, '(?i){rx}') AS p, regexp_extract_all(t, '(?i){rx}') AS h FROM x" for i, (kind, rx) in enumerate(narrative.MARKS))

ORACLES = {
    "time_markers": f"""
        WITH x AS (SELECT doc_id, text, regexp_replace(text, '[À-ɏ]', 'x', 'g') AS t FROM documents), m AS ({_MARKS}),
        u AS (SELECT doc_id, text, rank, kind, unnest(h) AS hit, unnest(p[1 : len(h)]) AS piece, generate_subscripts(h, 1) AS k FROM m WHERE len(h) > 0),
        s AS (SELECT *, CAST(sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY k) - length(hit) AS BIGINT) AS start FROM u),
        f AS (SELECT doc_id, start, arg_min(kind, rank) AS kind, arg_min(substr(text, start + 1, length(hit)), rank) AS said FROM s GROUP BY 1, 2)
        SELECT doc_id, start, kind, trim(said) AS text FROM f""",
    "activity_streaks": """
        WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
        g AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM d),
        s AS (SELECT user_id, g, count(*) AS n, max(day) AS last FROM g GROUP BY 1, 2)
        SELECT user_id, max(n) AS longest, arg_max(n, last) AS current, max(last) AS last_day FROM s GROUP BY 1""",
    "event_type_runs": """
        WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
        SELECT user_id, event_type, min(rn) AS first, max(rn) AS last, count(*) AS n FROM r GROUP BY user_id, event_type, g HAVING count(*) >= 3""",
    "timeline_order_reversals": """
        SELECT * FROM (SELECT user_id, event_id, epoch_us(ts) AS "at", lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE "at" < before""",
    "order_gaps": """
        WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS after FROM events),
        l AS (SELECT *, lead(after) OVER (PARTITION BY user_id ORDER BY after) AS before FROM d)
        SELECT user_id, after, before, before - after - 1 AS missing FROM l WHERE before - after > 1""",
    "presence_gaps": """
        WITH d AS (SELECT user_id, date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS c, count(*) AS n FROM events GROUP BY 1, 2),
        t AS (SELECT max(c) + 1 AS chapters FROM d),
        l AS (SELECT *, lead(c) OVER (PARTITION BY user_id ORDER BY c) - c - 1 AS gap FROM d),
        p AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS uses, min(c) AS first, max(c) AS last, coalesce(max(gap), 0) AS inside FROM l GROUP BY 1 HAVING sum(n) >= 6)
        SELECT user_id, uses, first, last, inside, chapters - 1 - last AS after, inside >= greatest(4, chapters // 3) AS absent, chapters - 1 - last >= greatest(4, chapters // 3) AND uses >= 10 AS gone FROM p, t""",
    "thread_ends": """
        WITH c AS (SELECT (conv_id % 97) || ':' || role AS name, turn FROM conversations), t AS (SELECT max(turn) + 1 AS total FROM c),
        d AS (SELECT name, count(*) AS mentions, min(turn) AS first, max(turn) AS last, count(DISTINCT turn) AS sections FROM c GROUP BY 1)
        SELECT name, mentions, first, last, sections, total - 1 - last AS tail FROM d, t WHERE last < total * 0.82 AND sections >= 2 AND total - 1 - last >= greatest(3, total // 4)""",
    "finding_keys": f"SELECT event_id AS seq, {_KEY} AS key FROM events",
    "finding_caps": """
        WITH f AS (SELECT event_type AS "check", 'Event  ' || event_id || ' of ' || event_type AS title, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT "check", title, seq, CAST(0 AS BIGINT) AS overflow FROM f WHERE rn <= 100
        UNION ALL SELECT "check", NULL, max(seq) + 1, count(*) FROM f GROUP BY 1 HAVING count(*) > 100""",
    "triage_delta": """
        WITH n AS (SELECT DISTINCT user_id AS key FROM events WHERE event_id % 2 = 0), p AS (SELECT DISTINCT user_id AS key FROM events WHERE event_id % 3 = 0), d AS (SELECT DISTINCT user_id AS key FROM events WHERE event_id % 7 = 0)
        SELECT key, CASE WHEN NOT key IN (FROM n) THEN 'gone' WHEN key IN (FROM d) THEN 'hidden' WHEN NOT key IN (FROM p) THEN 'fresh' ELSE 'shown' END AS state FROM (FROM n UNION FROM p)""",
    "unit_conflict_truth_table": f"""
        WITH l AS (SELECT {", ".join(_LINES)} FROM lineitem), p AS (SELECT l_orderkey, l_linenumber, {", ".join(_pairs_sql("clash"))} FROM l)
        SELECT l_orderkey, l_linenumber, name, a, a_unit, b, b_unit, clash AS conflict FROM p""",
    "spec_register": f"""
        WITH l AS (SELECT {", ".join(REGISTER)} FROM lineitem), v AS (SELECT component, quantity, bar, x, count(*) AS n, CASE WHEN bar THEN 100 * x ELSE x END AS p, CASE WHEN bar THEN 50 ELSE 0.5 END AS half FROM l GROUP BY 1, 2, 3, 4),
        c AS (SELECT component, quantity, count(*) AS conflicts FROM v a JOIN v b USING (component, quantity) WHERE (a.p, a.bar) < (b.p, b.bar) AND CASE WHEN a.bar = b.bar THEN a.p <> b.p ELSE abs(a.p - b.p) > a.half + b.half END GROUP BY 1, 2),
        g AS (SELECT component, quantity, CAST(sum(n) AS BIGINT) AS uses, string_agg(x || CASE WHEN bar THEN ' bar' ELSE ' kPa' END, '; ' ORDER BY x || CASE WHEN bar THEN ' bar' ELSE ' kPa' END) AS "values" FROM v GROUP BY 1, 2)
        SELECT CASE WHEN component = '' THEN '(not named)' ELSE component END AS component, quantity, uses, "values", coalesce(conflicts, 0) AS conflicts FROM g LEFT JOIN c USING (component, quantity)""",
    "claim_state_counts": f"""
        WITH s(state, k) AS (VALUES {", ".join(f"('{s}', {i})" for i, s in enumerate(STATES))}), n AS (SELECT o_custkey, arg_max(o_orderkey % 4, o_orderkey) AS k FROM orders GROUP BY 1)
        SELECT state, count(n.k) AS n FROM s LEFT JOIN n USING (k) GROUP BY 1""",
    "version_file_delta": """
        SELECT doc_id AS rel, CASE doc_id % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'changed' END AS change FROM documents
        WHERE doc_id % 10 IN (1, 2) OR (doc_id % 10 = 3 AND md5(text) <> reverse(md5(text)))""",
    "bm25_topk": r"""
        WITH d AS (SELECT doc_id, [lower(x) for x in regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]+')] AS w FROM documents), z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
        t AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, unnest(w) AS term, len(w) AS l FROM d) GROUP BY 1, 2),
        f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
        q AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]+'))) AS term FROM benchmark),
        s AS (SELECT item_id AS query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))) AS score
              FROM q JOIN t USING (term) JOIN f USING (term), z GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
        SELECT query_id, doc_id, CAST(round(score * 1000) AS BIGINT) AS score, rank FROM r WHERE rank <= 10""",
    "benchmark_passages": r"""
        WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS item FROM benchmark)
        SELECT doc_id, item_id, strpos(t, item) AS at, length(item) AS n FROM d, b WHERE contains(t, item)""",
    "band_order": """
        WITH d AS (SELECT doc_id, doc_id % 5 AS band, (doc_id * 37) % 101 AS value, n_chars AS tokens FROM documents)
        SELECT doc_id, band, row_number() OVER (PARTITION BY band ORDER BY CASE WHEN band IN (1, 4) THEN value::DOUBLE ELSE value / greatest(tokens, 1) END DESC, doc_id) AS rank FROM d""",
}
