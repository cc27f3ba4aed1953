"""Personal data by patterns and by bootstrapped contexts, in DataFrame functions only.

Base spans come from four fixed patterns (email, ip, card, phone), each read from left
to right without overlap; a match that fails its check is dropped. They stay as they are.

The bootstrap adds spans of kind "id". Tokens with a digit, an at sign or 16 capitals are
instances. Each has several lexical patterns: the two words before it (one at the start of
a text; "0" for a word that is itself such a token), the one word before, the one after,
the name before "=" or ":" inside of the token, and the shape of a token that mixes letters
and digits (its characters' class and its length). Seed entities have confidence 1: tokens
on a base span and tokens of a published key format. No context is given: which words stand
before identifiers is learnt.

Rounds of scoring run over the graph of patterns and instances. A pattern's confidence is the
mean confidence of its distinct instances, damped for few of them; an instance's is its best
pattern's, less a tenth, where a pattern of one word tells half as much as the others. Each
step shrinks differences by a tenth or more, so the confidences have one solution, which the
rounds come near to until nothing moves by SETTLED any more.

Unseen instances that stand on a trusted context (a pattern other than a shape), are trusted
themselves, are long enough to identify someone and no mere number become spans, and so do
seeds of a key format that no base span covers. Formats that other things share (FORTY) are
seeds too, but become spans on a trusted context only.

Offsets are code points: a match's place is the length of all the pieces and matches
before it, summed up within parts of PART matches and then over the parts. To keep Java's matcher from recursing over long repeats, a separator inside a
repeat is first replaced by one control character of the same length, so that every
repeat is one character class.

Null text is empty; documents without digits or marks pass with no spans; repeated rows
get equal spans; columns of any name pass untouched; very long texts and hot patterns are aggregated before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spare

KINDS = ("email", "ip", "card", "phone")
#: Distinct instances that damp a pattern; share of a pattern's confidence that an instance
#: gets; confidence to accept; change below which the rounds end.
DAMP, PASSED, ACCEPT, SETTLED = 2.0, 0.9, 0.7, 1e-3
#: Shortest discovered token, and the words before a token that are its pattern.
SHORTEST, CONTEXT = 6, 2

#: Fixed values, published formats of access keys: further seeds.
FORMATS = (
    "(?:AKIA|ASIA)[0-9A-Z]{16}",
    "gh[pousr]_[0-9A-Za-z]{36,}",
    "xox[abprs]-[0-9A-Za-z-]{10,}",
    "AIza[0-9A-Za-z_-]{35}",
    "sk-[0-9A-Za-z_-]{20,}",
)
#: Classic access tokens of 40 hexadecimal digits; checksums look the same.
FORTY = "[0-9a-f]{40}"
#: Matches whose offsets are summed up together.
PART = 128

_JOIN = "\x01"
_LABEL = "A-Za-z0-9-"
_LOCAL = f"A-Za-z0-9._%+{_JOIN}-"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def summed(sizes: Column) -> Column:
    """Running sums; each array that grows by copies has PART entries, or one for each part."""

    def run(a: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(a, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out")), lambda acc: acc["out"])

    def joined_up(parts: Column) -> Column:
        ends = run(F.transform(parts, lambda r: F.element_at(r, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda r, k: F.transform(r, lambda x: x + F.when(k > 0, F.get(e, k - 1)).otherwise(0)))))

    def cut(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / PART).cast("int")), lambda k: run(F.slice(a, k * PART + 1, PART)))

    return F.when(F.size(sizes) == 0, F.array().cast("array<bigint>")).otherwise(let(cut(sizes), joined_up))


def located(text: Column, pattern: str, also) -> Column:
    """array<struct<start, end, hit, ...>>: matches with code point offsets, and the fields
    that also(pieces, index) gives, where pieces are the texts between the matches."""

    def placed(f: Column) -> Column:
        steps = F.zip_with(F.slice(f["pieces"], 1, F.size(f["hits"])), f["hits"], lambda p, h: (F.char_length(p) + F.char_length(h)).cast("bigint"))
        one = lambda h, i, ends: F.struct((ends[i] - F.char_length(h)).cast("int").alias("start"), ends[i].cast("int").alias("end"), h.alias("hit"), *also(f["pieces"], i))
        return let(summed(steps), lambda ends: F.transform(f["hits"], lambda h, i: one(h, i, ends)))

    found = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return let(found, placed)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>>: matches with code point offsets."""
    return located(text, pattern, lambda pieces, i: ())


def plain_words(piece: Column) -> Column:
    """The words of a text, lower-cased, without marks other than : and =."""
    word = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}:=_]+", "")
    return F.filter(F.transform(F.split(piece, r"\s+"), word), lambda w: w != "")


#: Characters beside a token that are looked at first for its neighbouring words.
_NEAR = 400


def last_words(piece: Column, n: int) -> Column:
    """Words at the end of a piece, the last n among them: from its last characters if these
    hold more than n words (so that none of the n is cut), else from the whole piece."""
    return let(plain_words(F.right(piece, F.lit(_NEAR))), lambda w: F.when((F.char_length(piece) <= _NEAR) | (F.size(w) > n), w).otherwise(plain_words(piece)))


def first_word(piece: Column) -> Column:
    """The first word of a piece, in the same way; null if there is none."""
    return let(plain_words(F.left(piece, F.lit(_NEAR))), lambda w: F.get(F.when((F.char_length(piece) <= _NEAR) | (F.size(w) > 1), w).otherwise(plain_words(piece)), F.lit(0)))


def in_context(text: Column, pattern: str) -> Column:
    """matches, with the words before and after each one, other matches among them as "0"."""
    zero, none = F.array(F.lit("0")), F.array().cast("array<string>")
    ends = lambda p: last_words(p, CONTEXT)

    def also(pieces: Column, i: Column) -> list[Column]:
        earlier = F.when(i > 0, F.concat(F.when(i > 1, zero).otherwise(none), ends(F.get(pieces, i - 1)), zero)).otherwise(none)
        before = let(F.concat(earlier, ends(F.get(pieces, i))), lambda w: F.slice(w, F.greatest(F.size(w) - (CONTEXT - 1), F.lit(1)), CONTEXT))
        following = F.get(pieces, i + 1)
        after = F.coalesce(first_word(following), F.when(i + 2 < F.size(pieces), F.lit("0")).otherwise(""))
        return [before.alias("before"), after.alias("after")]

    return located(text, pattern, also)


def joined(text: Column, sides: str, marks: str) -> Column:
    """Marks between two characters of sides become the control character."""
    return F.regexp_replace(F.translate(text, _JOIN, "\x02"), f"(?<=[{sides}])[{marks}](?=[{sides}])", _JOIN)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)
    place = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(place, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>>, by kind as listed, then by start."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    when = lambda gate, found: F.when(gate, found).otherwise(none)
    email = when(
        F.contains(text, F.lit("@")),
        matches(joined(text, _LABEL, "."), rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++{_JOIN}[{_LABEL[:-1]}{_JOIN}-]++"),
    )
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    ip = when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), lambda x: x["hit"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")))
    number = lambda x: digits(x["hit"])
    card = when(
        text.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
        F.filter(matches(joined(text, "0-9", " -"), f"[0-9{_JOIN}]{{13,}}"), lambda x: F.length(number(x)).between(13, 19) & F.when(F.length(number(x)) <= 19, luhn(number(x))).otherwise(False)),
    )
    phone = when(F.contains(text, F.lit("+")), F.filter(matches(text, r"\+[0-9][ ().0-9-]+[0-9]"), lambda x: F.length(number(x)).between(9, 15)))

    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*map(named, KINDS, (email, ip, card, phone)))


def shape(token: Column) -> Column:
    """The characters' class and the length of a token of letters and digits; else null."""
    kind = F.when(token.rlike("^[0-9a-f]+$"), "hex").when(token.rlike("^[0-9a-z]+$"), "small").when(token.rlike("^[0-9A-Z]+$"), "large").otherwise("mixed")
    return F.when(token.rlike("^[0-9A-Za-z_-]{12,200}$") & token.rlike("[0-9]") & token.rlike("[A-Za-z]"), F.concat_ws(" ", F.lit("shape"), kind, F.char_length(token)))


def instances(text: Column, spans: Column) -> Column:
    """array<struct<start, end, token, patterns, seed, bare, sure>> of the tokens that have a pattern."""
    kind = "array<struct<start:int,end:int,hit:string,before:array<string>,after:string>>"
    found = F.when(text.rlike("[0-9@]|[A-Z]{16}"), in_context(text, r"(?<!\S)(?:\S*[0-9@]\S*|\S*[A-Z]{16}\S*)")).otherwise(F.array().cast(kind))
    edge, tail = r"^[^\p{L}\p{N}+@]+", r"[^\p{L}\p{N}]+$"
    # A name and "=" or ":" before the token's value, as in password=b7db.
    assigned = r"^([\p{L}_-]{2,40}[=:])[^\p{L}\p{N}]*(?=[\p{L}\p{N}].)"

    def one(x: Column) -> Column:
        return let(F.regexp_replace(x["hit"], edge, ""), lambda body: valued(x, body, F.lower(F.regexp_extract(body, assigned, 1))))

    def valued(x: Column, body: Column, name: Column) -> Column:
        value = F.when(name != "", F.regexp_replace(body, assigned, "")).otherwise(body)
        return let(F.struct(value.alias("v"), name.alias("name")), lambda y: measured(x, y["v"], y["name"]))

    def measured(x: Column, value: Column, name: Column) -> Column:
        core = F.regexp_replace(value, tail, "")
        start = x["end"] - F.char_length(value)
        return let(F.struct(core.alias("core"), start.alias("start"), (start + F.char_length(core)).alias("end")), lambda y: told(x, y["core"], y["start"], y["end"], name))

    def told(x: Column, core: Column, start: Column, end: Column, name: Column) -> Column:
        two, last = F.array_join(x["before"], " "), F.coalesce(F.element_at(F.when(F.size(x["before"]) > 0, x["before"]), -1), F.lit(""))
        worded = lambda p: p.rlike(r"\p{L}")
        patterns = F.array(
            F.when(worded(two), F.concat(F.lit("before "), two)),
            F.when(worded(last) & (F.size(x["before"]) > 1), F.concat(F.lit("word "), last)),
            F.when(worded(x["after"]), F.concat(F.lit("after "), x["after"])),
            F.when(name != "", F.concat(F.lit("name "), name)),
            shape(core),
        )
        covered = F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))
        sure = covered | core.rlike("^(?:" + "|".join(FORMATS) + ")$")
        return F.struct(
            start.alias("start"), end.alias("end"), F.lower(core).alias("token"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"),
            (sure | core.rlike(f"^{FORTY}$")).alias("seed"), (~covered).alias("bare"), sure.alias("sure"),
        )

    return F.filter(F.transform(found, one), lambda x: ((F.size(x["patterns"]) > 0) | x["seed"]) & (F.length(x["token"]) > 0))


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of id and text: rows that agree in both are repeats."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", F.md5(text.cast("binary")), F.col(id_col).cast("string")).cast("binary")))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, id, base spans and instances of every row, written to the shared folder."""
    rows = docs.select(row_key(id_col, text_col).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = rows.withColumn("_base", base_spans(F.col("_text")))
    return materialise(rows.select("_row", "_id", "_base", instances(F.col("_text"), F.col("_base")).alias("_found")), "pii")


def beliefs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, trust) and (token, belief) that settle over the graph; what has none is left out.

    Only what already has confidence takes part in a round."""
    size = materialise(edges.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    seeds = materialise(edges.where("seed").select("token").distinct().withColumn("belief", F.lit(1.0)), "seeds")
    known, least = seeds, SETTLED / 10
    tells = F.col("trust") * F.when(F.col("pattern").rlike("^(word|after) "), 0.5).otherwise(1.0) * PASSED
    while True:
        mass = edges.join(known, "token").groupBy("pattern").agg(F.sum("belief").alias("mass"))
        trust = materialise(mass.join(size, "pattern").select("pattern", F.round(F.col("mass") / (F.col("n") + DAMP), 9).alias("trust")).where(F.col("trust") > least), "trust")
        told = edges.where("NOT seed").join(trust, "pattern").groupBy("token").agg(F.round(F.max(tells), 9).alias("belief"))
        after = materialise(told.join(seeds.select("token"), "token", "left_anti").unionByName(seeds), "belief")
        moved = after.join(known.withColumnRenamed("belief", "was"), "token", "left").agg(F.max(F.col("belief") - F.coalesce("was", F.lit(0.0)))).first()[0]
        known = after
        if (moved or 0) <= SETTLED:
            return trust, known


def discovered(rows: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(_row, _more): the spans that seeds and patterns of high confidence add to a row."""
    each = rows.select("_row", F.explode("_found").alias("x")).select("_row", "x.*").distinct()
    pairs = each.select("token", "seed", F.explode("patterns").alias("pattern"))
    edges = materialise(pairs.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "edges")
    trust, known = beliefs(edges)
    good = trust.where((F.col("trust") >= accept) & ~F.col("pattern").startswith("shape ")).select("pattern")
    sure = known.where(F.col("belief") >= accept).select("token")
    long = each.where(F.col("bare") & (F.length("token") >= SHORTEST))
    fresh = long.where(~F.col("sure") & F.col("token").rlike("[0-9]") & F.col("token").rlike(r"[\p{L}@_]")).select("_row", "token", "start", "end", F.explode("patterns").alias("pattern"))
    found = fresh.join(good, "pattern", "left_semi").join(sure, "token", "left_semi").select("_row", "start", "end")
    found = found.unionByName(long.where("sure").select("_row", "start", "end"))
    span = F.struct(F.lit("id").alias("kind"), "start", "end")
    return found.groupBy("_row").agg(F.sort_array(F.collect_set(span)).alias("_more"))  # of one document


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int>>")


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans, how many were added and are there."""
    rows = scanned(docs, id_col, text_col)
    out = rows.select("_row", "_id", "_base").join(discovered(rows), "_row", "left")
    more = F.coalesce("_more", _none())
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        F.col("_id").alias(id_col),
        *map(count, KINDS),
        F.sha2(text_of(F.col("_base")), 256).alias("base_sha256"),
        text_of(F.concat("_base", more)).alias("spans"),
        F.size(more).cast("long").alias("n_discovered"),
        F.size(F.concat("_base", more)).cast("long").alias("n_spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans by the first one's."""
    in_order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.array_append(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    return F.aggregate(in_order, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data masked in their texts; their columns stay."""
    rows = scanned(docs, id_col, text_col)
    row, own = spare(docs, "row_of_spans"), spare(docs, "spans_of_row")
    spans = rows.select("_row", "_base").distinct().join(discovered(rows), "_row", "left").select(F.col("_row").alias(row), F.concat("_base", F.coalesce("_more", _none())).alias(own)).where(F.size(own) > 0)
    out = docs.withColumn(row, row_key(id_col, text_col)).join(spans, row, "left")
    hit = F.col(own).isNotNull()
    out = out.withColumn(text_col, F.when(hit, masked(F.col(text_col), F.col(own))).otherwise(F.col(text_col)))
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.when(hit, F.char_length(text_col)).otherwise(F.col(count_col)).cast(docs.schema[count_col].dataType))
    return out.select(*docs.columns)
