"""The claim store: an append-only journal from which the current claims follow.

claims: id, subject, predicate, value, unit, section_id, quote, origin.
journal: claim_id, seq, action, detail. Verbs give new journal rows (and claims); a verb
that a claim's state doesn't allow gives none, and names the claim in `refused`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import influence, units

#: What each verb makes of a claim, and from which states.
VERBS = {"accept": ("accepted", ("proposed", "rejected", "accepted")), "reject": ("rejected", ("proposed", "accepted", "rejected")), "supersede": ("superseded", ("accepted", "proposed")), "revise": ("proposed", ("proposed",))}
STATES = ("proposed", "accepted", "rejected", "superseded")


def current(claims: DataFrame, journal: DataFrame) -> DataFrame:
    """claims with state and the claim that replaced them."""
    last = journal.groupBy(F.col("claim_id").alias("id")).agg(F.max_by(F.struct("action", "detail"), "seq").alias("x"))
    return claims.join(last, "id", "left").select(*claims.columns, F.coalesce("x.action", F.lit("proposed")).alias("state"), F.when(F.col("x.action") == "superseded", F.col("x.detail")).alias("replaced_by"))


def chosen(now: DataFrame, state: str | None = None, kind: str | None = None, subject: str | None = None, key: tuple[str, str] | None = None, ids: Sequence[int] | None = None) -> DataFrame:
    """Claims by state, kind, subject (in either case), key (subject and predicate) or ids; all that is given must hold. Ordered by id."""
    plain = lambda c: F.lower(F.trim(c))
    for want, have in ((state, F.col("state")), (kind, F.col("kind")), (subject and subject.strip().lower(), plain("subject"))):
        now = now if want is None else now.where(have == want)
    if key is not None:
        now = now.where((plain("subject") == key[0].strip().lower()) & (plain("predicate") == key[1].strip().lower()))
    return (now if ids is None else now.where(F.col("id").isin(list(ids)))).orderBy("id")


def act(now: DataFrame, requests: DataFrame, after: int) -> tuple[DataFrame, DataFrame]:
    """(new journal rows, refused requests). requests: claim_id, verb, detail; after: the journal's last seq."""
    table = requests.sparkSession.createDataFrame([(v, to, list(of)) for v, (to, of) in VERBS.items()], "verb string, becomes string, allowed array<string>")
    r = requests.join(F.broadcast(table), "verb", "left").join(now.select(F.col("id").alias("claim_id"), "state"), "claim_id", "left")
    ok = F.coalesce(F.array_contains("allowed", F.col("state")), F.lit(False))
    rows = r.where(ok).select("claim_id", (F.row_number().over(Window.orderBy("claim_id", "verb")) + after).alias("seq"), F.col("becomes").alias("action"), "detail")  # an author's few requests
    return rows, r.where(~ok).select("claim_id", "verb", "state")


def counts(now: DataFrame) -> DataFrame:
    every = now.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(now.groupBy("state").agg(F.count("*").alias("n")), "state", "left").na.fill(0, ["n"])


def for_sweep(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Readings to compare: those the author rejected are left out, known ones count as stored, accepted claims always count."""
    key = lambda d: F.sha1(F.concat_ws("|", F.lower("subject"), F.lower("predicate"), F.lower("value")).cast("binary"))
    cols = ["subject", "predicate", "value", "unit", "section_id", "quote"]
    old = stored.withColumn("_k", key(stored))
    new = fresh.withColumn("_k", key(fresh)).join(old.where("state = 'rejected'").select("_k").distinct(), "_k", "left_anti")
    kept = new.join(old.where("state in ('accepted', 'proposed')").select("_k").distinct(), "_k", "left_anti").select(*cols, F.lit("proposed").alias("state"))
    known = old.join(new.select("_k").distinct(), "_k", "left_semi").where("state = 'proposed'").select(*cols, "state")
    return kept.unionByName(known).unionByName(old.where("state = 'accepted'").select(*cols, "state"))


def governing(now: DataFrame, section_id: str, text: str, limit: int = 24) -> DataFrame:
    """Accepted claims that bear on a section: of it (3), named in it (4), measured or timed (1)."""
    named = F.contains(F.lit(text.lower()), F.lower("subject")) & (F.length("subject") > 0)
    kind = F.col("kind").isin("numeric", "temporal") if "kind" in now.columns else F.lit(False)
    score = 3 * (F.col("section_id") == section_id).cast("int") + 4 * named.cast("int") + kind.cast("int")
    return now.where("state = 'accepted'").withColumn("score", F.coalesce(score, F.lit(0))).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def corrected(now: DataFrame, claim_id: int, new: dict, new_id: int, after: int) -> tuple[DataFrame, DataFrame]:
    """(claims, journal rows) of a correction: the old claim is rejected and names the new one,
    which takes over its place, quote and origin, and its state where that was accepted."""
    old = now.where(F.col("id") == claim_id)
    base = [c for c in now.columns if c not in ("state", "replaced_by")]
    claim = old.select(*[(F.lit(new_id) if c == "id" else F.lit(new[c]) if c in new else F.col(c)).cast(now.schema[c].dataType).alias(c) for c in base])
    gone = old.select("id", F.lit(after + 1).alias("seq"), F.lit("rejected").alias("action"), F.lit(str(new_id)).alias("detail"))
    kept = old.select(F.lit(new_id).alias("id"), F.lit(after + 2).alias("seq"), F.when(F.col("state") == "accepted", "accepted").otherwise("proposed").alias("action"), F.lit("").alias("detail"))
    return claim, gone.unionByName(kept).withColumnRenamed("id", "claim_id")


def authored(spark, claim: dict, columns: str, claim_id: int, after: int) -> tuple[DataFrame, DataFrame]:
    """(claims, journal rows) of a fact that the author states: accepted from the start."""
    names = [c.split()[0] for c in columns.split(", ")]
    row = {"origin": "author", **claim, "id": claim_id}
    journal = spark.createDataFrame([(claim_id, after + 1, "accepted", "")], "claim_id long, seq int, action string, detail string")
    return spark.createDataFrame([tuple(row.get(n) for n in names)], columns), journal


def bearing(now: DataFrame, sections: DataFrame, hits: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(section_id, id, rank): the claims each section has to agree with: accepted before
    proposed, the author's and measured ones before others, those whose subject the section
    names before those that a search found for it. sections: section_id, text; hits:
    section_id, id, rank. Sections and claims meet on the subject's words, and each pair is then
    tested on the whole subject."""
    live = now.where(~F.col("state").isin("rejected", "superseded") & (F.length(F.trim("subject")) >= 2))
    subject = F.lower(F.trim("subject"))
    first = F.element_at(F.split(subject, "[^\\p{L}\\p{N}]+"), 1)
    c = live.select("id", "state", "origin", subject.alias("s"), first.alias("w")).where("w <> ''")
    ws = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"))
    near = sections.select("section_id", F.explode(ws).alias("w")).join(c, "w").join(sections.select("section_id", F.lower("text").alias("t")), "section_id")
    whole = F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), F.col("s"), F.lit("\\E(?![\\p{L}\\p{N}_])"))
    found = near.withColumn("rx", whole).where(F.expr("t rlike rx")).select("section_id", "id", "state", "origin", F.lit(0).alias("how"), F.col("id").cast("long").alias("place"))
    if hits is not None:
        more = hits.join(live.select("id", "state", "origin"), "id").select("section_id", "id", "state", "origin", F.lit(1).alias("how"), F.col("rank").cast("long").alias("place"))
        found = found.unionByName(more.join(found.select("section_id", "id"), ["section_id", "id"], "left_anti"))
    order = [F.col("state") != "accepted", ~F.col("origin").isin("author", "measured"), F.col("how"), F.col("place")]
    rank = F.row_number().over(Window.partitionBy("section_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("section_id", "id", "rank")


def register(now: DataFrame) -> DataFrame:
    """The sheet of measured values: component, quantity, values with their uses, earlier
    values, and whether two of them can't both hold. What nothing names comes last."""
    d = now.where("kind = 'numeric' and state <> 'rejected'")
    bare = F.col("predicate") == "value"
    d = d.withColumn("component", F.when(bare, "").otherwise(F.lower(F.trim("subject")))).withColumn("quantity", F.lower(F.trim(F.when(bare, F.col("subject")).otherwise(F.col("predicate")))))
    said = F.concat_ws(" ", "value", "unit")
    live = d.where("state <> 'superseded'")
    bad = units.conflicts(live, ["component", "quantity"]).groupBy("component", "quantity").agg(F.count("*").alias("conflicts"))
    g = d.groupBy("component", "quantity").agg(
        F.count_if(F.col("state") != "superseded").alias("uses"), F.sort_array(F.collect_set(F.when(F.col("state") != "superseded", said))).alias("values"), F.sort_array(F.collect_set(F.when(F.col("state") == "superseded", said))).alias("history")
    )
    g = g.join(bad, ["component", "quantity"], "left")
    name = F.when(F.col("component") == "", "(not named)").otherwise(F.col("component"))
    return g.select(name.alias("component"), "quantity", "uses", "values", "history", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), (F.col("component") == "").alias("last"))


def dependents(paragraphs: DataFrame, subject: str, value: str, unit: str = "", limit: int = 50) -> DataFrame:
    """Paragraphs to reconsider when a value changes: 3 if one carries it, 2 if its section does, 1 if it names the subject.

    Numbers are carried by overlapping intervals of one dimension, other values by their words."""
    p = paragraphs.where(F.contains(F.lower("prose"), F.lit(subject.lower())))
    if unit:
        meant, of = units.reading(F.lit(value), F.lit(unit)), units.dimension(F.lit(unit))
        meets = lambda r: (r["from"] <= meant["to"]) & (r["to"] >= meant["from"])
        over = lambda q: (q["dimension"] == of) & S.let(units.reading(q["value"], q["unit"]), meets)
        carries = F.exists(units.quantities(F.col("prose")), over)
    else:
        carries = F.exists(S.keys(F.col("prose")), lambda w: w.isin([x for x in value.lower().split() if len(x) > 2]))
    p = p.withColumn("here", F.coalesce(carries, F.lit(False)))
    near = F.max("here").over(Window.partitionBy("section_id"))
    p = p.withColumn("strength", F.when(F.col("here"), 3).when(near, 2).otherwise(1))
    return p.orderBy(F.desc("strength"), "rel", "start").select("rel", "start", "section_id", "strength", "prose").limit(limit)


def arcs(claims: DataFrame) -> DataFrame:
    """Runs of equal values of a subject and predicate in reading order, over its own claims only."""
    key = F.concat_ws("|", F.lower("subject"), F.lower("predicate"))
    d = claims.select(key.alias("key"), F.lower("value").alias("value"), "ord", "start")
    by, same = Window.partitionBy("key").orderBy("ord", "start"), Window.partitionBy("key", "value").orderBy("ord", "start")
    d = d.withColumn("g", F.row_number().over(by) - F.row_number().over(same))
    return d.groupBy("key", "value", "g").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("n")).drop("g")


def model_claims(raw: DataFrame, text_col: str = "reply") -> DataFrame:
    """Claims in a model's reply: the JSON array between the first [ and the last ]; anything else gives none."""
    body = F.regexp_extract(text_col, "(?s)(\\[.*\\])", 1)
    schema = "array<struct<subject:string,kind:string,predicate:string,value:string,quote:string>>"
    return raw.select(*[c for c in raw.columns if c != text_col], F.explode(F.from_json(body, schema)).alias("c")).select(*[c for c in raw.columns if c != text_col], "c.*").where("subject is not null and value is not null")


def located_claims(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Model claims whose quote stands in their section (white space aside), has three words and carries the value."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    d = claims.join(sections.select("section_id", flat(F.col("text")).alias("_t")), "section_id")
    return d.where(F.contains("_t", flat(F.col("quote"))) & F.contains(flat(F.col("quote")), flat(F.col("value"))) & (F.size(S.words(F.col("quote"))) >= 3)).drop("_t")


def record(influences: Sequence[str], passages: DataFrame) -> DataFrame:
    """passages with recorded texts blanked out at the same length, so that borrowed prose isn't measured as the author's."""
    return passages.withColumn("text", influence.blanked(F.col("text"), list(influences)))
