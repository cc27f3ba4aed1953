"""Facts and continuity: claims with their places, contradictions, names, time markers.

All work on passages (rel, section_id, ord, start, text): prose in reading order. Passages
of many manuscripts have a column ms; each manuscript is compared with itself only. Claims
are read sentence by sentence inside a row; what is compared meets on its key after equal
values were counted together."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalar as S
from . import terms, units

ADJECTIVES = {**dict.fromkeys(L.MATERIALS, "material"), **dict.fromkeys(L.COLOURS, "colour"), **dict.fromkeys(L.SIZES, "size"), **dict.fromkeys(L.AGES, "age")}


def _predicate(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in (("material", L.MATERIALS), ("colour", L.COLOURS), ("size", L.SIZES), ("age", L.AGES)):
        out = F.when(word.isin(words), name).otherwise(out)
    return out


PLACE = ("ms", "rel", "section_id", "ord", "start")


def placed(passages: DataFrame) -> DataFrame:
    return passages if "ms" in passages.columns else passages.withColumn("ms", F.lit(""))


def sentence_rows(passages: DataFrame) -> DataFrame:
    return placed(passages).select(*PLACE, F.posexplode(S.sentences(F.col("text"))).alias("sent_idx", "quote"))


def _claims(rows: DataFrame, hits: Column, subject, predicate, value, kind: str, unit=None) -> DataFrame:
    d = rows.select(*PLACE, "sent_idx", "quote", F.posexplode(hits).alias("hit_no", "h"))
    unit_ = unit or (lambda h: F.lit(""))
    return d.select(
        *PLACE, "sent_idx", "hit_no", "quote", F.lit(kind).alias("kind"), F.lit("proposed").alias("state"), F.lit("measured").alias("origin"),
        subject(F.col("h")).alias("subject"), predicate(F.col("h")).alias("predicate"), value(F.col("h")).alias("value"), unit_(F.col("h")).alias("unit"),
    )


def numeric_claims(passages: DataFrame) -> DataFrame:
    """What is measured, of what: the object that the clause names, else the quantity. Numbers
    that no quantity word, verb or object names are left out."""
    found = F.filter(units.quantities(F.col("quote")), lambda q: q["dimension"].isNotNull() & (q["quantity"] != ""))
    # Most sentences hold no number; those that do are read once.
    rows = S.once(sentence_rows(passages).where(F.col("quote").rlike("\\d")), hits=found)
    d = rows.select(*PLACE, "sent_idx", "quote", F.posexplode("hits").alias("hit_no", "h"))
    owned = F.col("h.object") != ""
    return d.select(
        *PLACE, "sent_idx", "hit_no", "quote", F.lit("numeric").alias("kind"), F.lit("proposed").alias("state"), F.lit("measured").alias("origin"),
        F.when(owned, F.col("h.object")).otherwise(F.col("h.quantity")).alias("subject"), F.when(owned, F.col("h.quantity")).otherwise("value").alias("predicate"), F.col("h.value").alias("value"), F.col("h.unit").alias("unit"),
    )


def temporal_claims(passages: DataFrame) -> DataFrame:
    when = "|".join([*L.WEEKDAYS, *L.MONTHS]) + "|\\d{1,2}\\s*(?:minutes|minute|hours|hour|days|day|weeks|week)|\\d{4}-\\d{2}-\\d{2}"
    rx = f"(?i)\\b([A-Za-z][\\w' -]{{2,30}}?)\\s+(?:is|was|will be|takes|took|happens|happened|falls|fell)\\s+(?:on\\s+|in\\s+|at\\s+)?({when})\\b"
    hits = F.regexp_extract_all("quote", F.lit(rx), F.lit(0))
    out = _claims(sentence_rows(passages), hits, lambda h: F.trim(F.regexp_replace(F.regexp_extract(h, rx, 1), "(?i)^(the|a|an) ", "")), lambda h: F.lit("when"), lambda h: F.lower(F.regexp_extract(h, rx, 2)), "temporal")
    return out.where((F.length("subject") >= 3) & ~F.lower("subject").isin(L.STOPWORDS))


def attribute_claims(passages: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """Materials, colours, sizes and ages of known subjects, and what they are said to be."""
    rows = sentence_rows(passages)
    names = "|".join(sorted(map(_quote, subjects), key=len, reverse=True)) or "(?!)"
    before = f"(?i)\\b(?:the|a|an|his|her|their|its|my|your|that|this)\\s+([a-z]{{3,12}})\\s+({names})\\b"
    one = _claims(rows, F.regexp_extract_all("quote", F.lit(before), F.lit(0)), lambda h: F.lower(F.regexp_extract(h, before, 2)), lambda h: _predicate(S.normalise(F.regexp_extract(h, before, 1))), lambda h: S.normalise(F.regexp_extract(h, before, 1)), "attribute")
    said = f"\\b(?i:({names}))\\s+(?:is|was|are|were)\\s+(the\\s+|a\\s+|an\\s+)?([a-z][\\w -]{{1,40}}?)(?=[.,;:!?]|\\s+(?:and|but|which|who|when)\\b|$)"
    art, val = lambda h: F.regexp_extract(h, said, 2), lambda h: F.trim(F.regexp_extract(h, said, 3))
    # The look-ahead isn't part of a hit, so a stop stands in for it.
    hits = F.transform(F.regexp_extract_all("quote", F.lit(said), F.lit(0)), lambda h: F.concat(h, F.lit(".")))
    two = _claims(rows, hits, lambda h: F.lower(F.regexp_extract(h, said, 1)), lambda h: F.coalesce(_predicate(S.normalise(val(h))), F.when(art(h) != "", "is")), val, "attribute")
    return one.unionByName(two).where("predicate is not null")


def _quote(s: str) -> str:
    return "".join("\\" + c if c in "\\.^$|()[]{}*+?-" else c for c in s)


def relationship_claims(passages: DataFrame) -> DataFrame:
    rx = f"\\b([A-Z][\\w'-]{{1,25}})\\s+(?:is|was)\\s+([A-Z][\\w-]{{1,25}})['’]s\\s+({'|'.join(L.KIN)})\\b"
    hits = F.regexp_extract_all("quote", F.lit(rx), F.lit(0))
    return _claims(sentence_rows(passages), hits, lambda h: F.regexp_extract(h, rx, 1), lambda h: F.concat(F.regexp_extract(h, rx, 3), F.lit(" of")), lambda h: F.regexp_extract(h, rx, 2), "relationship")


def claims(passages: DataFrame, subjects: Sequence[str] = ()) -> DataFrame:
    """All that can be read without a model; extraction proposes, it never asserts."""
    out = numeric_claims(passages).unionByName(temporal_claims(passages)).unionByName(relationship_claims(passages))
    return out.unionByName(attribute_claims(passages, subjects)) if subjects else out


def fresh_claims(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New readings that no stored claim has: same key, value and quote (white space aside), in the same section if both name one."""
    same = lambda d, s: d.withColumn(s, F.sha1(F.concat_ws("|", F.lower(F.trim("subject")), F.lower(F.trim("predicate")), F.lower("value"), F.lower(F.regexp_replace(F.trim("quote"), "\\s+", " "))).cast("binary")))
    old = same(stored, "_k").select(F.col("_k").alias("_o"), F.col("section_id").alias("_s"))
    here = F.col("section_id").isNull() | F.col("_s").isNull() | (F.col("section_id") == F.col("_s"))
    return same(new, "_k").join(old, (F.col("_k") == F.col("_o")) & here, "left_anti").drop("_k")


def states(journal: DataFrame) -> DataFrame:
    """The current state of each claim: its latest journal row (claim_id, seq, action)."""
    return journal.groupBy("claim_id").agg(F.max_by("action", "seq").alias("state"), F.count("*").alias("events"))


def _seconds(value: Column) -> Column:
    rx = "(\\d+)\\s*(minute|hour|day|week)"
    by = F.element_at(F.create_map(*[F.lit(x) for k, v in (("minute", 60.0), ("hour", 3600.0), ("day", 86400.0), ("week", 604800.0)) for x in (k, v)]), F.regexp_extract(value, rx, 2))
    return F.regexp_extract(value, rx, 1).try_cast("double") * by


def contradictions(claims_: DataFrame) -> DataFrame:
    """Pairs of values of one subject and predicate that can't both hold.

    A value stands for all its mentions: its first place and their number. Numbers compare
    by stated precision, times within their kind, other values by text; a sweep over the ends
    of their intervals pairs up only those that lie apart. `certain` is false
    where the two may speak of different things (a bare quantity in two sections)."""
    live = placed(claims_).where("state not in ('rejected', 'superseded')").withColumn("key", F.concat_ws("|", F.lower(F.trim("subject")), F.lower(F.trim("predicate"))))
    live = live.withColumn("shown", F.lower(F.trim("value"))).withColumn("u", F.coalesce("unit", F.lit("")))
    place = F.struct("ord", "start", "sent_idx", "hit_no")
    d = live.groupBy("ms", "key", "kind", "predicate", "shown", "u").agg(F.min(place).alias("at"), F.count("*").alias("mentions"), F.min_by("quote", place).alias("quote"), F.min_by("section_id", place).alias("section_id"), F.min_by("value", place).alias("value"))
    iso, sec = "^\\d{4}-\\d{2}-\\d{2}$", _seconds(F.col("shown"))
    timed = F.when(F.col("shown").isin(L.WEEKDAYS), "weekday").when(F.col("shown").rlike(iso), "date").when(sec.isNotNull(), "duration").otherwise("other")
    d = S.once(d, r=units.reading(F.col("value"), F.col("u")))
    low, high = units.drawn_in(F.col("r"))
    numeric, length = F.col("kind") == "numeric", (F.col("kind") == "temporal") & (timed == "duration")
    # Values of different classes never clash; within one, quantities and durations do if they lie apart, others if they differ.
    d = d.withColumn("class", F.when(numeric, F.col("r.scale")).when(F.col("kind") == "temporal", timed).otherwise(""))
    d = d.withColumn("low", F.when(numeric, low).when(length, sec)).withColumn("high", F.when(numeric, high).when(length, sec))
    d = d.where(F.col("class").isNotNull() & (~numeric | F.col("low").isNotNull()))
    pairs = units.apart(d, ["ms", "key", "kind", "predicate", "class"], ["value", "u", "at", "mentions", "quote", "section_id", "shown", "r"])
    pairs = pairs.where(F.when(F.col("kind") == "numeric", units.disagree(F.col("a_r"), F.col("b_r"))).otherwise(F.col("a_shown") != F.col("b_shown")))
    first = F.struct("a_at", "a_shown") < F.struct(F.col("b_at"), F.col("b_shown"))
    swapped = [F.when(first, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(f"{p}_{c}") for p, q in ("ab", "ba") for c in ("value", "u", "at", "mentions", "quote", "section_id", "shown")]
    pairs = pairs.select("ms", "key", "kind", "predicate", "class", *swapped)
    certain = ~((F.col("predicate") == "value") & (F.col("a_section_id") != F.col("b_section_id"))) & ~((F.col("kind") == "temporal") & (F.col("class") == "other"))
    return pairs.withColumn("certain", certain).drop("class")


def cast(passages: DataFrame, least: int = 4, limit: int = 40) -> DataFrame:
    """Names by use: capitalised, at least once inside a sentence, mostly no calendar use."""
    rx = "\\b[A-Z][a-z]{2,}(?:['’-][A-Z]?[a-z]+)?\\b"
    s = sentence_rows(passages).select("ms", "quote")
    pieces, hits = F.split("quote", rx, -1), F.regexp_extract_all("quote", F.lit(rx), F.lit(0))
    each = F.transform(
        hits,
        lambda h, i: F.struct(
            h.alias("name"),
            ((i > 0) | (F.char_length(F.get(pieces, F.lit(0))) > 1)).alias("inside"),
            F.lower(F.regexp_extract(F.get(pieces, i), "([A-Za-z]+)[^A-Za-z]*$", 1)).isin(L.DATE_BEFORE).alias("dated"),
            F.get(pieces, i + 1).rlike("(?i)^\\s*(?:\\d|the\\s+\\d|morning|afternoon|evening|night|week|next|last)").alias("dated_after"),
        ),
    )
    n = s.select("ms", F.explode(each).alias("x")).select("ms", "x.*").where(~F.lower("name").isin(L.STOPWORDS))
    calendar = F.lower("name").isin(L.CALENDAR) & (F.col("dated") | F.coalesce("dated_after", F.lit(False)))
    out = n.groupBy("ms", "name").agg(F.count("*").alias("uses"), F.count_if("inside").alias("inside"), F.count_if(calendar).alias("dates"))
    out = out.where((F.col("uses") >= least) & (F.col("inside") >= 1) & (F.col("dates") * 2 < F.col("uses")))
    rank = F.row_number().over(Window.partitionBy("ms").orderBy(F.desc("uses"), "name"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit).select("ms", "name", "uses")


def threads(passages: DataFrame, named: Sequence[str] = (), least: int = 3, limit: int = 60) -> DataFrame:
    """(ms, name): what to follow through a manuscript: the project's cast and terms, else
    names of one or two words with three uses and mostly no calendar use, 60 at most."""
    p = placed(passages)
    if named:
        return p.select("ms").distinct().join(F.broadcast(p.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(named)], "name string")))  # a project's list
    rx = "\\b[A-Z][a-z]{3,}(?:[- ][A-Z][a-z]{2,})?\\b"
    hit = F.regexp_extract_all("text", F.lit(rx), F.lit(0))
    pieces = F.split("text", rx, -1)
    each = F.transform(hit, lambda h, i: F.struct(h.alias("h"), F.lower(F.regexp_extract(F.get(pieces, i), "([A-Za-z]+)[^A-Za-z]*$", 1)).isin(L.DATE_BEFORE).alias("dated")))
    d = p.select("ms", F.explode(each).alias("x")).select("ms", "x.*")
    head, tail = F.regexp_extract("h", "^([A-Za-z]+) (.*)$", 1), F.regexp_extract("h", "^([A-Za-z]+) (.*)$", 2)
    # The first of two words may only be capitalised because it opens a sentence, or be a day.
    name = F.when((head != "") & (F.lower(head).isin(L.STOPWORDS) | F.lower(head).isin(L.CALENDAR)), tail).otherwise(F.col("h"))
    d = d.select("ms", name.alias("name"), "dated").where((F.length("name") >= 4) & ~F.lower("name").isin(L.STOPWORDS))
    calendar = F.lower("name").isin(L.CALENDAR) & F.col("dated")
    g = d.groupBy("ms", S.term_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"), F.count_if(calendar).alias("dates"), F.min("name").alias("name"))
    g = g.where((F.col("n") >= least) & (F.col("dates") * 2 < F.col("n")))
    rank = F.row_number().over(Window.partitionBy("ms").orderBy(F.desc("n"), "name"))
    return g.withColumn("rank", rank).where(F.col("rank") <= limit).select("ms", "name")


def tracked(passages: DataFrame, sections: DataFrame, names: DataFrame, tail: float = 0.18) -> DataFrame:
    """Where each followed name appears: mentions, first and last section, sections, emphasis, resolved.

    Emphasis says how loudly a name came in: 2 for standing in its first section's title, 1
    for its first mention within 400 characters of that section's start, and up to 2 for
    further mentions in the paragraph of the first one. A name is resolved if its last
    section lies in the last 18 % of all. names: ms, name; few for each manuscript."""
    s = sections.select("ms", F.col("id").alias("section_id"), F.col("start").alias("section_start"))
    total = sections.groupBy("ms").agg(F.count("*").alias("total"))
    hits = terms.found(placed(passages).select("ms", "section_id", "ord", "start", "text"), names)
    hits = hits.groupBy("ms", "section_id", "ord", "start", F.col("term").alias("name")).agg(F.min("from").alias("at"), F.count("*").alias("n"))
    titled = terms.found(sections.select("ms", F.col("id").alias("section_id"), F.col("title").alias("text")), names).groupBy("ms", "section_id", F.col("term").alias("name")).agg(F.count("*").alias("titled"))
    hits = hits.withColumn("at", F.col("start") + F.col("at")).join(s, ["ms", "section_id"]).join(titled, ["ms", "section_id", "name"], "left").withColumn("titled", F.coalesce("titled", F.lit(0)))
    first = F.struct("ord", "at", "n", "section_start", "titled", "section_id")
    g = hits.groupBy("ms", "name").agg(F.sum("n").alias("mentions"), F.min(first).alias("f"), F.max("ord").alias("last"), F.countDistinct("section_id").alias("sections"), F.max_by("section_id", F.struct("ord", "at")).alias("last_section"))
    g = g.join(total, "ms")
    emphasis = 2.0 * (F.col("f.titled") > 0).cast("int") + (F.col("f.at") - F.col("f.section_start") < 400).cast("int") + F.least(F.lit(2), F.col("f.n") - 1)
    return g.select("ms", "name", "mentions", F.col("f.ord").alias("first"), "last", "sections", emphasis.alias("emphasis"), (F.col("last") >= F.col("total") * (1 - tail)).alias("resolved"), "total", "last_section")


def dropped_threads(tracked_: DataFrame, least_sections: int = 2, least_emphasis: float = 1.0) -> DataFrame:
    """Names that came in with emphasis, went over several sections and then vanished."""
    gap = F.col("total") - 1 - F.col("last")
    d = tracked_.where(~F.col("resolved") & (F.col("sections") >= least_sections) & (F.col("emphasis") >= least_emphasis))
    return d.where(gap >= F.greatest(F.lit(3), F.floor(F.col("total") / 4))).withColumn("gap", gap)


def name_variants(names: DataFrame) -> DataFrame:
    """Pairs of a cast's names that may be one person, with the reason. names: name, uses; a
    cast is bounded by its limit, so its pairs are few."""
    nick = names.sparkSession.createDataFrame([(a, b) for a, bs in L.NICKNAMES.items() for b in bs.split()], "x string, y string")
    k = placed(names).select("ms", "name", "uses", S.normalise(F.col("name")).alias("k"))
    a, b = k.select("ms", *[F.col(c).alias(f"a_{c}") for c in k.columns if c != "ms"]), k.select("ms", *[F.col(c).alias(f"b_{c}") for c in k.columns if c != "ms"])
    pairs = a.join(b, "ms").where(F.struct(-F.col("a_uses"), F.col("a_name")) < F.struct(-F.col("b_uses"), F.col("b_name"))).where("a_k <> b_k")
    known = nick.union(nick.select("y", "x")).distinct().withColumn("nick", F.lit(True))
    pairs = pairs.join(F.broadcast(known), (F.col("a_k") == F.col("x")) & (F.col("b_k") == F.col("y")), "left")
    short, long = F.least(F.length("a_k"), F.length("b_k")), F.greatest(F.length("a_k"), F.length("b_k"))
    starts = (short >= 4) & (short < long) & (F.col("a_k").startswith(F.col("b_k")) | F.col("b_k").startswith(F.col("a_k")))
    near = (short >= 5) & F.levenshtein("a_k", "b_k", 2).between(0, 2)
    why = (
        F.when(F.col("nick"), "a diminutive on the list").when(starts, "one begins with the other").when(near, "spelt within two letters")
        .when(F.replace(F.col("a_k"), F.lit("k"), F.lit("c")) == F.replace(F.col("b_k"), F.lit("k"), F.lit("c")), "k and c exchanged")
    )
    return pairs.select("ms", F.col("a_name").alias("name"), F.col("b_name").alias("form"), F.col("a_uses").alias("uses"), F.col("b_uses").alias("form_uses"), why.alias("reason")).where("reason is not null")


def name_groups(names: DataFrame) -> DataFrame:
    """Groups of a cast's names that may be one person: ms, name (the one most used), forms,
    uses (of all its forms), reason.

    Names are taken by falling use, equal ones by name; each that is in no group yet opens
    one and takes in the later names related to it that are free. A group is a star: its
    forms are related to its head, not to one another. That order is sequential, so a
    manuscript's cast, which has a bound, is one group of rows."""
    order = placed(names).select("ms", "name", "uses")
    pairs = name_variants(names).select("ms", F.struct("name", "form", "reason").alias("pair"))
    related = pairs.groupBy("ms").agg(F.collect_list("pair").alias("pairs"))
    every = order.groupBy("ms").agg(F.collect_list(F.struct("name", "uses")).alias("names")).join(related, "ms")

    def one(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                uses = {x["name"]: x["uses"] for x in row["names"]}
                tie: dict = {}
                for p in row["pairs"]:
                    tie.setdefault(p["name"], {})[p["form"]] = p["reason"]
                live, taken = sorted(uses, key=lambda n: (-uses[n], n)), set()
                for i, head in enumerate(live):
                    if head in taken:
                        continue
                    forms = [n for n in live[i + 1 :] if n not in taken and n in tie.get(head, ())]
                    taken |= {head, *forms}
                    if forms:
                        out.append({"ms": row["ms"], "name": head, "forms": forms, "uses": uses[head] + sum(uses[n] for n in forms), "reason": tie[head][forms[-1]]})
            yield pa.RecordBatch.from_pylist(out, schema=_GROUP)

    return every.mapInArrow(one, "ms string, name string, forms array<string>, uses bigint, reason string")


_GROUP = pa.schema([("ms", pa.string()), ("name", pa.string()), ("forms", pa.list_(pa.string())), ("uses", pa.int64()), ("reason", pa.string())])


#: The kinds of time markers in the order in which they are tried.
MARKS = (
    ("weekday", "\\b(?:" + "|".join(L.WEEKDAYS) + ")\\b"),
    ("date", "\\b\\d{4}-\\d{2}-\\d{2}\\b"),
    ("date", "\\b\\d{1,2}\\s+(?:" + "|".join(L.MONTHS) + ")\\b[^.,;]{0,8}"),
    ("clock", "\\b\\d{1,2}[:.]\\d{2}\\s*(?:am|pm)?\\b"),
    ("relative", "\\b(?:the\\s+)?(?:next|following|previous|last)\\s+(?:morning|evening|night|day|week|month|year)\\b"),
    ("relative", "\\b(?:a|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|\\d+)\\s+(?:minutes?|hours?|days?|weeks?|months?|years?)\\s+(?:later|earlier|before|after|ago)\\b"),
    ("duration", "\\b\\d+\\s*(?:minutes?|hours?|seconds?|days?)\\b"),
)


def moments(passages: DataFrame) -> DataFrame:
    """Time markers with their places, one for each start: the first kind that fits.

    All kinds are cut out of a text in its own row; a marker's place is the length of what
    stands before it, summed up over the pieces and markers of its kind."""

    def marked(rank: int, kind: str, rx: str) -> Column:
        rx = "(?i)" + rx
        none = F.array().cast("array<struct<at:int,rank:int,kind:string,said:string>>")

        def placed_(hits: Column) -> Column:
            # Most texts have no marker of a kind: those are read once and not cut.
            ends = S.running(F.zip_with(F.slice(F.split("text", rx, -1), 1, F.size(hits)), hits, lambda p, h: F.char_length(p) + F.char_length(h)))
            each = S.let(ends, lambda e: F.zip_with(hits, e, lambda h, at: F.struct((at - F.char_length(h)).alias("at"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), h.alias("said"))))
            return F.when(F.size(hits) > 0, each).otherwise(none)

        return S.let(F.regexp_extract_all("text", F.lit(rx), F.lit(0)), placed_)

    found = F.concat(*[marked(i, kind, rx) for i, (kind, rx) in enumerate(MARKS)])
    d = S.once(placed(passages).select(*PLACE, "text"), m=F.array_sort(found)).select(*PLACE, "m")
    first = F.filter("m", lambda x, i: (i == 0) | (F.get("m", i - 1)["at"] != x["at"]))
    d = S.once(d, x=first).select(*PLACE, F.explode("x").alias("x"))
    return d.select("ms", "rel", "section_id", "ord", (F.col("start") + F.col("x.at")).alias("start"), F.col("x.kind").alias("kind"), F.trim("x.said").alias("text"))


def dates_backwards(moments_: DataFrame) -> DataFrame:
    """ISO dates that are before the previous one in reading order, over a manuscript's files."""
    d = placed(moments_).where(F.col("text").rlike("^\\d{4}-\\d{2}-\\d{2}$"))
    before = F.lag("text").over(Window.partitionBy("ms").orderBy("ord", "start"))
    return d.withColumn("before", before).where("text < before")


def chronology(moments_: DataFrame) -> DataFrame:
    """(ms, what, name, n, rank): markers by kind, the eight sections with most of them, and
    the weekdays and the first forty dates in reading order with equal neighbours as one."""
    m = placed(moments_)
    kinds = m.groupBy("ms", F.col("kind").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("kind")).withColumn("rank", F.lit(0))
    busy = m.groupBy("ms", F.col("section_id").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("section"))
    busy = busy.withColumn("rank", F.row_number().over(Window.partitionBy("ms").orderBy(F.desc("n"), "name"))).where("rank <= 8")
    value = S.normalise(F.col("text"))
    runs = m.where("kind in ('weekday', 'date')").withColumn("name", value)
    by = Window.partitionBy("ms", "kind").orderBy("ord", "start")
    runs = runs.withColumn("was", F.lag("name").over(by)).where("was is null or was <> name")
    runs = runs.select("ms", F.concat("kind", F.lit(" sequence")).alias("what"), "name", F.lit(1).cast("long").alias("n"), F.row_number().over(by).alias("rank"))
    runs = runs.where("what <> 'date sequence' or rank <= 40")
    cols = ["ms", "what", "name", "n", "rank"]
    return kinds.select(cols).unionByName(busy.select(cols)).unionByName(runs.select(cols))


def durations(moments_: DataFrame) -> DataFrame:
    """The durations of each section in order."""
    return placed(moments_).where("kind = 'duration'").groupBy("ms", "section_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]).alias("durations"))
