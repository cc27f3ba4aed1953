"""Checks over manuscripts' located blocks: rules, terms, acronyms, steps, chapters, scenes.

Input tables are those of `structure`: located blocks, sections, paragraphs, scenes. Their
column ms tells manuscripts apart; what a check counts, it counts within one manuscript."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalar as S
from . import craft, terms, units
from .structure import PROSE, roots, scene_blocks, section_texts


def _prose(located: DataFrame) -> DataFrame:
    return located.where(F.col("kind").isin(*PROSE))


def rules(located: DataFrame, rules_: DataFrame, limit: int = 40) -> DataFrame:
    """Project rules: (id, pattern, scope, files, cased); scope is prose, headings, steps or raw.

    Rules are a short table that a project writes; each block meets the rules of its scope.
    Lists at most `limit` hits per rule, and the count of all in `total`."""
    scope = F.when(F.col("kind") == "heading", F.array(F.lit("headings"), F.lit("raw"))).when(F.col("number") > 0, F.array(F.lit("steps"), F.lit("prose"), F.lit("raw"))).when(F.col("kind").isin(*PROSE), F.array(F.lit("prose"), F.lit("raw"))).otherwise(F.array(F.lit("raw")))
    b = located.select("ms", "rel", "file_order", "start", "section_id", F.when(F.col("kind").isin(*PROSE), F.col("prose")).otherwise(F.col("text")).alias("body"), F.explode(scope).alias("scope"))
    r = rules_.select("id", "scope", F.when(F.col("cased"), F.col("pattern")).otherwise(F.concat(F.lit("(?i)"), F.col("pattern"))).alias("rx"), F.coalesce("files", F.lit("*")).alias("files"))
    like = F.replace(F.replace(F.col("files"), F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))
    hits = b.join(F.broadcast(r.withColumn("like", like)), "scope").where(F.expr("rel LIKE like"))
    # Lengths of what stands before a hit, summed up, are its place.
    hits = hits.withColumn("_said", F.expr("regexp_extract_all(body, rx, 0)")).where(F.size("_said") > 0).withColumn("_between", F.expr("split(body, rx, -1)"))
    ends = S.running(F.zip_with(F.slice("_between", F.lit(1), F.size("_said")), "_said", lambda p, h: F.char_length(p) + F.char_length(h)))
    each = S.let(ends, lambda e: F.zip_with("_said", e, lambda h, end: F.struct(h.alias("said"), (end - F.char_length(h)).alias("off"))))
    hits = hits.select("ms", "id", "rel", "file_order", "start", "section_id", F.posexplode(each).alias("hit", "x"))
    hits = hits.select("ms", "id", "rel", "file_order", "start", "section_id", "hit", "x.said", (F.col("start") + F.col("x.off")).alias("at"))
    by = Window.partitionBy("ms", "id").orderBy("file_order", "rel", "start", "hit")
    total = hits.groupBy("ms", "id").agg(F.count("*").alias("total"))
    return hits.withColumn("n", F.row_number().over(by)).where(F.col("n") <= limit).join(total, ["ms", "id"])


def phrase(text: str, whole_word: bool = True) -> str:
    """The pattern of a plain phrase."""
    body = "".join("\\" + c if c in "\\.^$|()[]{}*+?-" else c for c in text.strip()).replace(" ", "\\s+")
    return f"(?<![\\p{{L}}\\p{{N}}_]){body}(?![\\p{{L}}\\p{{N}}_])" if whole_word else body


def definitions(located: DataFrame) -> DataFrame:
    """(key, term, rel, start): bold or quoted terms at the start of a list item, and "X is defined as"."""
    item = "^\\s*(?:[-*+]|\\d+[.)])?\\s*(?:\\*\\*|__|\")([A-Za-z][\\w \\-/]{1,40}?)(?:\\*\\*|__|\")?\\s*(?:\\*\\*|__)?\\s*(?:[:—–]|-\\s)"
    inline = "\\b([A-Z][\\w\\- ]{2,40}?)\\s+(?:is|are)\\s+(?:defined as|known as|called|termed)\\b"
    b = _prose(located).select("ms", "rel", "start", F.array(F.regexp_extract("text", item, 1), F.regexp_extract("text", inline, 1)).alias("t"))
    d = b.select("ms", "rel", "start", F.explode(F.filter("t", lambda x: x != "")).alias("term"))
    return d.select(S.term_key(F.regexp_replace("term", "^(?i:the|a|an)\\s+", "")).alias("key"), F.trim("term").alias("term"), "ms", "rel", "start")


def undefined_terms(located: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Project terms that are used and never defined, or used before their definition."""
    # A project's term list is short and part of the plan, so no job has to send it out.
    used = [F.when(F.col("prose").rlike(f"(?i){phrase(x)}"), F.struct(F.lit(x).alias("term"), S.term_key(F.lit(x)).alias("key"))) for x in terms]
    none = F.array().cast("array<struct<term:string,key:string>>")
    use = _prose(located).select("ms", "section_id", "file_order", "start", F.inline(F.array_compact(F.array(*used)) if used else none))
    at = F.struct("file_order", "start")
    first = use.groupBy("ms", "term", "key").agg(F.min(at).alias("used"), F.min_by("section_id", at).alias("section_id"), F.count("*").alias("blocks"))
    d = definitions(located).join(located.select("ms", "rel", "file_order").distinct(), ["ms", "rel"]).groupBy("ms", "key").agg(F.min(at).alias("defined"))
    state = F.when(F.col("defined").isNull(), "never defined").when(F.col("used") < F.col("defined"), "used before it is defined")
    return first.join(d, ["ms", "key"], "left").select("ms", "term", "blocks", "section_id", F.col("used.file_order").alias("file_order"), F.col("used.start").alias("start"), state.alias("state")).where("state is not null")


def acronyms(located: DataFrame, least: int = 2) -> DataFrame:
    """Acronyms without an expansion, expanded after their first use, or expanded in several ways.

    An expansion stands before the brackets or inside them: "Anti Lock (AL)", "AL (anti lock)"."""
    rx = craft.ACRONYM
    b = _prose(located).select("ms", "section_id", "file_order", "start", "prose")
    # The ends of the text before a match and the start of the text after it hold its expansion. The
    # pieces between matches and their places are made once for a block, not again for each match.
    b = S.once(b, _hits=F.regexp_extract_all("prose", F.lit(rx), F.lit(0))).where(F.size("_hits") > 0)
    b = S.once(b, _pieces=S.between(F.col("prose"), rx)).drop("prose")
    b = S.once(b, _ends=S.running(F.zip_with(F.slice("_pieces", F.lit(1), F.size("_hits")), "_hits", lambda p, h: F.char_length(p) + F.char_length(h))))
    near = F.transform("_hits", lambda h, i: F.struct(h.alias("acronym"), F.right(F.get("_pieces", i), F.lit(90)).alias("before"), F.left(F.get("_pieces", i + 1), F.lit(90)).alias("after"), i.alias("i"), (F.get("_ends", i) - F.char_length(h)).alias("off")))
    u = b.select("ms", "section_id", "file_order", "start", F.explode(near).alias("x")).select("ms", "section_id", "file_order", "start", "x.*").where(~F.col("acronym").isin(L.ACRONYM_SKIP))
    n = F.length("acronym")
    inside = F.regexp_extract("after", "^\\s*\\(([^)]{2,80})\\)", 1)
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    initials = lambda ws: F.array_join(F.transform(ws, lambda w: F.left(w, F.lit(1))), "")
    ahead = F.when(F.col("before").rlike("\\(\\s*$"), F.slice(words(F.col("before")), -F.least(n, F.size(words(F.col("before")))), n)).otherwise(F.array().cast("array<string>"))
    said = F.when(initials(words(inside)) == F.lower("acronym"), F.array_join(words(inside), " ")).when((F.size(ahead) > 0) & (initials(ahead) == F.lower("acronym")), F.array_join(ahead, " "))
    u = u.withColumn("said", said)
    place = F.struct("file_order", "start", "i")
    told = F.min(F.when(F.col("said").isNotNull(), place)).alias("told")
    g = u.groupBy("ms", "acronym").agg(F.count("*").alias("uses"), F.min(place).alias("used"), F.min_by(F.col("start") + F.col("off"), place).alias("at"), F.min_by("section_id", place).alias("section_id"), told, F.sort_array(F.collect_set("said")).alias("expansions"))
    state = F.when(F.col("told").isNull(), "never expanded").when(F.col("used") < F.col("told"), "expanded late").when(F.size("expansions") > 1, "several expansions")
    g = g.where(F.col("uses") >= least).select("ms", "acronym", "uses", "expansions", "section_id", F.col("used.file_order").alias("file_order"), F.col("used.start").alias("start"), "at", state.alias("state"))
    return g.where("state is not null")


def long_steps(located: DataFrame, warn: int = 30, defect: int = 40) -> DataFrame:
    """Sentences inside numbered steps that are too long to follow."""
    s = located.where("number > 0").select("ms", "rel", "file_order", "section_id", "start", "number", F.explode(S.sentences(F.col("prose"))).alias("sentence"))
    s = s.withColumn("words", F.size(S.words(F.col("sentence")))).where(F.col("words") >= warn)
    return s.withColumn("severity", F.when(F.col("words") >= defect, "defect").otherwise("warn"))


def pacing(sections: DataFrame, least: int = 4) -> DataFrame:
    """Chapters over 2.2 times or under 0.35 times the median of all; none for fewer than four."""
    s = sections.withColumnRenamed("root_id", "root") if "root_id" in sections.columns else sections.join(roots(sections), "id")
    words = s.groupBy("ms", "root").agg(F.sum("words").alias("words"), F.min("file_order").alias("file_order"), F.min("start").alias("start"))
    mid = words.groupBy("ms").agg(F.percentile("words", 0.5).alias("median"), F.count("*").alias("chapters"))
    out = words.join(mid, "ms").where(F.col("chapters") >= least)
    kind = F.when(F.col("words") > 2.2 * F.col("median"), "long").when((F.col("words") < 0.35 * F.col("median")) & (F.col("words") > 0), "short")
    return out.select("ms", "root", "words", "median", "file_order", "start", kind.alias("kind")).where("kind is not null")


def dialogue_shares(located: DataFrame, sections: DataFrame, least: int = 100, apart: float = 0.30) -> DataFrame:
    """Chapters of 100 words and more with the share of their words in quotes, their manuscript's share, and whether they are far from it. located: or `whole`."""
    d = section_texts(located)
    if "top" in d.columns:
        d = d.where("top")
    else:
        d = S.once(d, words=F.size(S.words(F.col("text")))).join(sections.where("parent_id is null").select(F.col("id").alias("section_id")), "section_id", "left_semi")
    q = F.aggregate(F.transform(craft.quoted(F.col("text")), lambda x: F.size(S.words(x))), F.lit(0), lambda a, b: a + b)
    # Counted where the text is; only counts are shuffled.
    d = S.once(d.where(F.col("words") >= least), quoted=q).drop("text")
    d = d.withColumn("overall", F.sum("quoted").over(Window.partitionBy("ms")) / F.sum("words").over(Window.partitionBy("ms")))
    share = F.round(F.col("quoted") / F.col("words"), 3)
    return d.select("ms", "section_id", "file_order", "start", "words", "quoted", share.alias("share"), "overall", (F.abs(share - F.col("overall")) > apart).alias("apart"))


#: Fixed value: the word after a closing quote, and an adverb after that.
TAG_VERB = "[\"”'’]\\s*,?\\s*(?:[A-Z][a-z]+\\s+)?([a-z]{3,15})(ed|s)?\\b(\\s+[\\p{L}\\p{N}_]+ly)?"


def _tags(located: DataFrame, common: Sequence[str] = L.STOPWORDS) -> DataFrame:
    """(ms, section_id, file_order, start, tags): of each block the verbs after a closing quote, with
    their adverbs. Common words count if they are "said" words or have the form of a verb."""
    hits = F.regexp_extract_all("prose", F.lit(TAG_VERB), F.lit(0))
    marked = F.contains("prose", F.lit('"')) | F.contains("prose", F.lit("”")) | F.contains("prose", F.lit("'")) | F.contains("prose", F.lit("’"))
    own = F.transform(hits, lambda h: F.struct(S.normalise(F.concat(F.regexp_extract(h, TAG_VERB, 1), F.regexp_extract(h, TAG_VERB, 2))).alias("verb"), F.trim(F.regexp_extract(h, TAG_VERB, 3)).alias("adverb")))
    kept = F.filter(own, lambda t: t["verb"].isin(L.SAID) | t["verb"].rlike("(ed|s)$") | ~t["verb"].isin([*L.STOPWORDS, *common]))
    return S.once(_prose(located).where(marked), tags=kept).where(F.size("tags") > 0).select("ms", "section_id", "file_order", "start", "tags")


def tag_verbs(located: DataFrame, common: Sequence[str] = L.STOPWORDS) -> DataFrame:
    """(ms, section_id, file_order, start, verb, adverb): a row for each of `_tags`."""
    return _tags(located, common).select("ms", "section_id", "file_order", "start", F.inline("tags"))


def dialogue_tags(located: DataFrame, least: int = 20, common: Sequence[str] = L.STOPWORDS) -> DataFrame:
    """Verbs after a closing quote, with their uses, whether they are plain "said" words, and whether another one is frequent; none under 20 tags."""
    # Equal verbs of a block leave it as one row.
    verbs = S.once(_tags(located, common), verbs=F.transform("tags", lambda t: t["verb"]))
    each = F.transform(F.array_distinct("verbs"), lambda v: F.struct(v.alias("verb"), F.size(F.filter("verbs", lambda w: w == v)).alias("n")))
    n = verbs.select("ms", "file_order", "start", F.inline(each)).groupBy("ms", "verb").agg(F.sum("n").alias("uses"), F.min(F.struct("file_order", "start")).alias("at"))
    plain, of_ms = F.col("verb").isin(L.SAID), Window.partitionBy("ms")
    d = n.withColumns({"total": F.sum("uses").over(of_ms), "said": F.sum(F.when(plain, F.col("uses")).otherwise(0)).over(of_ms)}).where(F.col("total") >= least)
    return d.select("ms", "verb", "uses", plain.alias("plain"), (~plain & (F.col("uses") >= F.greatest(F.lit(4), F.floor(F.col("total") / 25)))).alias("frequent"), (F.col("said") / F.col("total")).alias("said_share"), F.col("at.file_order").alias("file_order"), F.col("at.start").alias("start"))


def adverbial_tags(located: DataFrame, least: int = 4) -> DataFrame:
    """(ms, tags): manuscripts with four and more tag verbs that carry an adverb."""
    d = S.once(_tags(located), n=F.size(F.filter("tags", lambda t: t["adverb"] != ""))).where("n > 0")
    d = d.groupBy("ms").agg(F.sum("n").alias("tags"), F.min(F.struct("file_order", "start")).alias("at"))
    return d.where(F.col("tags") >= least).select("ms", "tags", "at.*")


def points_of_view(located: DataFrame, names: Sequence[str], least: int = 150) -> DataFrame:
    """Scenes of 150 words and more in which two heads are looked into: holders of interior verbs, twice each. located: or `whole`."""
    who = "|".join([*map(phrase_body, names), "he", "she", "they", "i"])
    rx = f"(?i)\\b({who})\\s+({'|'.join(L.INTERIOR)})\\b"
    seen = lambda prose: F.transform(F.regexp_extract_all(prose, F.lit(rx), F.lit(1)), F.lower)
    if "parts" in located.columns:
        # No scene of a section has two heads if the whole section hasn't: most are done with in the file's row.
        heads = lambda p: F.size(F.array_distinct(F.flatten(F.transform(F.filter(p["blocks"], lambda b: b["kind"].isin(*PROSE)), lambda b: seen(b["prose"])))))
        located = S.once(located, parts=F.filter("parts", lambda p: heads(p) >= 2)).where(F.size("parts") > 0)
    p = scene_blocks(located)
    by = ["ms", "section_id", "scene"]
    words = F.col("words") if "words" in p.columns else F.size(S.words(F.col("prose")))
    # Of each block only its counts leave its row: its words, and the uses of each head.
    b = p.select(*by, "file_order", "start", words.alias("words"), seen(F.col("prose")).alias("who"))
    g = b.groupBy(*by).agg(F.sum("words").alias("words"), F.min("file_order").alias("file_order"), F.min("start").alias("start"), F.flatten(F.collect_list("who")).alias("who")).where(F.col("words") >= least)
    twice = F.filter(F.array_distinct("who"), lambda w: F.size(F.filter("who", lambda x: x == w)) >= 2)
    return S.once(g, holders=F.sort_array(twice)).where(F.size("holders") >= 2).select(*by, "file_order", "start", "holders")


def phrase_body(name: str) -> str:
    return "".join("\\" + c if c in "\\.^$|()[]{}*+?-" else c for c in name)


def mentions(located: DataFrame, sections: DataFrame, names: Sequence[str]) -> DataFrame:
    """(ms, name, chapter, n): whole-word mentions per chapter, for presence and threads."""
    order = sections.where("parent_id is null").select(F.col("id").alias("root"), (F.row_number().over(Window.partitionBy("ms").orderBy("ord")) - 1).alias("chapter"))
    at = roots(sections).join(order, "root").select(F.col("id").alias("section_id"), "chapter")
    rows = _prose(located).select("ms", "section_id", F.col("prose").alias("text"))
    # Counted by section before chapters are looked up, so that no text is shuffled.
    hits = terms.found_all(rows, names).groupBy("ms", "section_id", F.col("term").alias("name")).agg(F.count("*").alias("n"))
    return hits.join(at, "section_id").groupBy("ms", "name", "chapter").agg(F.sum("n").alias("n"))


def presence(located: DataFrame, sections: DataFrame, names: Sequence[str], least: int = 6, gap: int | None = None) -> DataFrame:
    """Cast members with six mentions and more that are away for long: between two chapters, or from the last one on."""
    chapters = sections.where("parent_id is null").groupBy("ms").agg(F.count("*").alias("chapters")).where("chapters >= 3")
    m = mentions(located, sections, names)
    by = Window.partitionBy("ms", "name").orderBy("chapter")
    d = m.withColumn("away", F.lead("chapter").over(by) - F.col("chapter") - 1)
    d = d.groupBy("ms", "name").agg(F.sum("n").alias("uses"), F.max("chapter").alias("last"), F.coalesce(F.max("away"), F.lit(0)).alias("inside")).join(chapters, "ms")
    limit = F.lit(gap) if gap else F.greatest(F.lit(4), F.floor(F.col("chapters") / 3))
    d = d.withColumn("after", F.col("chapters") - 1 - F.col("last")).where(F.col("uses") >= least)
    state = F.when((F.col("after") >= limit) & (F.col("uses") >= 10), "gone").when(F.col("inside") >= limit, "absent")
    return d.withColumn("state", state).where("state is not null")


def unit_spellings(located: DataFrame, least: int = 4) -> DataFrame:
    """Units of one meaning that are written in several ways."""
    q = _prose(located).where(F.col("prose").rlike("\\d")).select("ms", F.explode(units.measures(F.col("prose"))).alias("q")).select("ms", "q.unit", "q.dimension", units.factor(F.col("q.unit")).alias("factor"))
    g = q.where("dimension is not null").groupBy("ms", "dimension", "factor", "unit").agg(F.count("*").alias("n")).groupBy("ms", "dimension", "factor").agg(F.sort_array(F.collect_set("unit")).alias("units"), F.sum("n").alias("uses"))
    return g.where((F.size("units") >= 2) & (F.col("uses") >= least) & (F.col("dimension") != "temperature"))


def mixed_thousands(located: DataFrame) -> DataFrame:
    """(ms, grouped, plain): manuscripts that write numbers over 999 with and without a separator."""
    # A block without digits has no numbers; those of the others are read once.
    rows = S.once(_prose(located).where(F.col("prose").rlike("\\d")), _values=F.transform(units.measures(F.col("prose")), lambda q: q["value"]))
    grouped = F.size(F.filter("_values", lambda v: v.contains(",")))
    plain = F.size(F.filter("_values", lambda v: v.rlike("^[-−]?\\d{4,}") & ~v.contains(",")))
    d = rows.select("ms", grouped.alias("grouped"), plain.alias("plain")).groupBy("ms").agg(F.sum("grouped").alias("grouped"), F.sum("plain").alias("plain"))
    return d.where("grouped > 0 and plain > 0")


def read_aloud(paragraphs: DataFrame, limit: int = 900) -> DataFrame:
    """Passages of whole sentences, at most `limit` characters unless one sentence is longer."""
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        joined = F.concat_ws(" ", F.nullif(acc["held"], F.lit("")), s)
        fits = (acc["held"] == "") | (F.char_length(joined) <= limit)
        return F.struct(F.when(fits, acc["out"]).otherwise(F.array_append(acc["out"], acc["held"])).alias("out"), F.when(fits, joined).otherwise(s).alias("held"))

    flat = F.transform(S.sentences(F.col("prose")), lambda s: F.regexp_replace(s, "\\s+", " "))
    packed = F.aggregate(flat, F.struct(none.alias("out"), F.lit("").alias("held")), step, lambda acc: F.when(acc["held"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["held"])))
    return paragraphs.select("section_id", "idx", F.posexplode(packed).alias("passage", "text"))
