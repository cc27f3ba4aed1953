"""Secrets by patterns, told apart by who owns them, in DataFrame functions only.

Base spans come from three fixed patterns (assign, access, hex), each read from left to right
without overlap; a match that fails its length is dropped. They stay as they are.

Candidates are the values on base spans (an assigned value, an access key, a hexadecimal run
with a letter), wherever they stand, and bare tokens of 20 or more letters, digits, "_" and
"-" outside of base spans that mix cases and digits or are upper-case hexadecimal. A digest
of each value is counted over the whole corpus: distinct repositories, then distinct owners.
A value of EXAMPLE_OWNERS owners or more is a widely copied example; one with a single
owner that looks alive (at least DISTINCT different characters) is a credential of that
owner, and each place of it becomes a span of kind "live". Values in between are left alone.

In `documents` the owner is the source and the repository the document.

Counting is in steps, (value, owner, repository), (value, owner), (value), each summed up
before its shuffle, so no group is ever gathered. Verdicts go back to the places by a join;
values with over a HOT-th of all places are fewer than HOT, so they go by broadcast and no
key of the shuffled rest has more than a HOT-th of the rows.

Null text is empty; a null owner or repository counts as one of its own, named by nothing;
repeated rows get equal spans and count once as a repository; an empty table gives no
rows; columns of any name may stand beside. Offsets are code points. Letters of the keywords match in
either case, as ASCII letters only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .op06_pii import let, matches, text_of

KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
#: Owners that make a value an example; different characters of a live one; share of a hot value.
EXAMPLE_OWNERS, DISTINCT, HOT = 3, 8, 1000


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEY = "(" + "|".join(map(either_case, KEYWORDS)) + ")"
HEAD = KEY + r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = HEAD + "([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX, BARE = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}", "[A-Za-z0-9_-]{20,}"

_NONE = "array<struct<start:int,end:int,hit:string>>"


def _found(text: Column, gate: str, pattern: str, keep) -> Column:
    return F.when(text.rlike(gate), F.filter(matches(text, pattern), keep)).otherwise(F.array().cast(_NONE))


def value_of(hit: Column) -> Column:
    """The assigned value of a match."""
    return F.regexp_extract(hit, f"^{ASSIGN}$", 2)


def found(text: Column) -> Column:
    """array<struct<start, order, end, kind, value>> of base spans, by start, then kind as listed."""
    assign = _found(text, KEY, ASSIGN, lambda x: F.length(value_of(x["hit"])) >= 12)
    # Runs are whole whatever their length is, so the least length can stand in the pattern.
    access = _found(text, "AKIA", ACCESS, lambda x: F.lit(True))
    run = _found(text, HEX, HEX, lambda x: F.lit(True))

    def named(k: int, spans: Column) -> Column:
        value = lambda x: value_of(x["hit"]) if KINDS[k] == "assign" else x["hit"]
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("order"), x["end"].alias("end"), F.lit(KINDS[k]).alias("kind"), value(x).alias("value")))

    return F.array_sort(F.concat(*(named(k, s) for k, s in enumerate((assign, access, run)))))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, digest, alive>>: values on base spans and bare tokens, each place once."""
    mixed = lambda t: t.rlike("[0-9].*[0-9].*[0-9]") & t.rlike("[a-z]") & t.rlike("[A-Z]")
    looks = lambda t: mixed(t) | t.rlike("^[0-9A-F]{32,}$") & t.rlike("[A-F]") & t.rlike("[0-9]")
    free = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    bare = _found(text, BARE, BARE, lambda x: looks(x["hit"]) & free(x))

    def place(value: Column, end: Column) -> Column:
        alive = F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT
        return F.struct((end - F.char_length(value)).alias("start"), end.alias("end"), F.unhex(F.sha2(value.cast("binary"), 256)).alias("digest"), alive.alias("alive"))

    valued = F.filter(base, lambda b: (b["kind"] != "hex") | b["value"].rlike("[a-f]"))
    return F.array_distinct(F.concat(F.transform(valued, lambda b: place(b["value"], b["end"])), F.transform(bare, lambda x: place(x["hit"], x["end"]))))


def scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> DataFrame:
    """_row, id, owner, repo, base spans and candidates of every row, written to the shared folder."""
    named = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), named(owner_col).alias("owner"), named(repo_col).alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_base", found(F.col("_text")))
    rows = rows.withColumn("_cands", candidates(F.col("_text"), F.col("_base"))).drop("_text")
    return materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "secrets")


def owned(rows: DataFrame) -> DataFrame:
    """digest, n (places), repos, owners: over the whole corpus."""
    each = rows.select("owner", "repo", F.explode("_cands.digest").alias("digest"))
    by_repo = each.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def judged(rows: DataFrame) -> DataFrame:
    """(_row, live, n_example): the places of credentials, and how many places hold examples."""
    verdicts = materialise(owned(rows).withColumn("verdict", F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(F.col("owners") == 1, "live").otherwise("shared")), "owned")
    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))  # one row
    hot = materialise(verdicts.crossJoin(F.broadcast(total.withColumnRenamed("n", "all"))).where(F.col("n") * HOT > F.col("all")).select("digest", "verdict"), "hot")  # fewer than HOT rows
    cold = verdicts.select("digest", "verdict").join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    each = rows.select("_row", F.explode("_cands").alias("x")).select("_row", "x.*")
    told = each.join(F.broadcast(hot), "digest").unionByName(each.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest"))
    live = F.when((F.col("verdict") == "live") & F.col("alive"), F.struct("start", F.lit("live").alias("kind"), "end"))
    return told.groupBy("_row").agg(F.sort_array(F.collect_list(live)).alias("live"), F.sum((F.col("verdict") == "example").cast("long")).alias("n_example"))  # of one document


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id") -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans, and how many places are live or examples."""
    rows = scanned(docs, id_col, text_col, owner_col, repo_col)
    out = rows.select("_row", "_id", "_base").join(judged(rows), "_row", "left")
    live = F.coalesce("live", F.array().cast("array<struct<start:int,kind:string,end:int>>"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    plain = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["order"] if k is None else F.lit(k)).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    both = F.array_sort(F.concat(plain("_base", None), plain(live, len(KINDS))))
    return out.select(
        F.col("_id").alias(id_col),
        *map(count, KINDS),
        F.sha2(text_of(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        let(both, text_of).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle() -> str:
    """The same rows in SQL: matches are numbered and their lengths summed up by windows."""
    kinds = [(k, ASSIGN if k == "assign" else ACCESS if k == "access" else HEX) for k in KINDS] + [("bare", BARE)]
    cut = " UNION ALL ".join(f"SELECT r, {i} AS k, '{kind}' AS kind, regexp_split_to_array(t, {_quoted(rx)}) AS p, regexp_extract_all(t, {_quoted(rx)}) AS h FROM d" for i, (kind, rx) in enumerate(kinds))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
    m AS ({cut}),
    u AS (SELECT r, k, kind, unnest(h) AS hit, unnest(p[1 : len(h)]) AS piece, generate_subscripts(h, 1) AS i FROM m WHERE len(h) > 0),
    s AS (SELECT r, k, kind, hit, CAST(sum(length(piece) + length(hit)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS b FROM u),
    f AS (SELECT r, k, kind, b - length(hit) AS a, b, CASE kind WHEN 'assign' THEN regexp_extract(hit, {_quoted("^" + ASSIGN + "$")}, 2) ELSE hit END AS value FROM s),
    base AS (SELECT * FROM f WHERE kind <> 'bare' AND (kind <> 'assign' OR length(value) >= 12)),
    loose AS (
      SELECT r, a, b, value FROM f WHERE kind = 'bare'
        AND (regexp_matches(value, '[0-9].*[0-9].*[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
             OR regexp_matches(value, '^[0-9A-F]{{32,}}$') AND regexp_matches(value, '[A-F]') AND regexp_matches(value, '[0-9]'))
        AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = f.r AND base.a < f.b AND f.a < base.b)),
    c AS (SELECT r, b - length(value) AS a, b, value FROM base WHERE kind <> 'hex' OR regexp_matches(value, '[a-f]') UNION SELECT * FROM loose),
    o AS (SELECT value, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners FROM c JOIN d USING (r) GROUP BY 1),
    j AS (SELECT r, a, b, owners, owners = 1 AND len(list_distinct(string_split(value, ''))) >= {DISTINCT} AS live FROM c JOIN o USING (value)),
    n AS (SELECT r, count(*) FILTER (live) AS n_live, count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_example FROM j GROUP BY 1),
    x AS (SELECT r, a, k, b, kind FROM base UNION ALL SELECT r, a, {len(KINDS)}, b, 'live' FROM j WHERE live),
    g AS (
      SELECT r, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (k < {len(KINDS)}) AS own,
             {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)} FROM x GROUP BY 1)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM d LEFT JOIN g USING (r) LEFT JOIN n USING (r)"""
