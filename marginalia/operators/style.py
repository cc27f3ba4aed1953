"""Style fingerprints: measures of six-sentence windows, baselines per group, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalar as S
from . import influence

WINDOW = 6
METRICS = ("sentence_words", "sentence_spread", "comma_density", "semicolons", "dashes", "subordination", "rarity", "ttr", "adverbs", "article_openings", "similes", "dialogue")
#: Metrics that count occurrences per 1000 words, and the occurrences that are noise.
COUNT_RATES, NOISE = ("semicolons", "dashes", "adverbs", "similes"), 2.0
NEEDS_SENTENCES = {"sentence_spread": 3, "article_openings": 3, "subordination": 2}
NEEDS_WORDS = {"ttr": 50}


def _cut(sentences: str, words: Column, size: int) -> Column:
    """The windows of an array of sentences."""
    s = F.col(sentences)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / size).cast("int")), lambda k: F.slice(s, k * size + 1, size))
    kept = F.when(F.size(s) > 0, F.filter(cut, lambda x: F.size(x) >= size // 2))
    return S.let(kept, lambda k: F.when(F.size(k) > 0, k).when((F.size(s) > 0) & (words >= 20), F.array(s)))


def windows(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """docs with window_id and the window's sentences; a tail under half a window is left
    out, and a text without a window is one itself from 20 words on."""
    rest = [c for c in docs.columns if c != text_col]
    d = S.once(docs, _s=S.sentences(F.col(text_col)))
    d = S.once(d, _w=_cut("_s", F.size(S.words(F.col(text_col))), size))
    return d.select(*rest, F.posexplode_outer("_w").alias("window_id", "s")).where("s is not null")


def mattr(keys: Column, width: int = 50) -> Column:
    """Distinct words per word, averaged over windows of 50 words at half steps."""
    n = F.size(keys)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - width), F.lit(width // 2))
    each = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(keys, i + 1, F.lit(width)))))
    total = F.aggregate(each, F.lit(0), lambda a, b: a + b)
    return F.when(n == 0, 0.0).when(n <= width, F.size(F.array_distinct(keys)) / n).otherwise(total / width / F.size(each))


def read(sentences: Column, common: Sequence[str] = L.STOPWORDS) -> Column:
    """array<struct>: each sentence with its words and what can be summed up over sentences, so
    that no word is read again for the windows and the text that its sentence stands in."""
    many = lambda a, f: F.size(F.filter(a, f))
    less = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))
    adverb = lambda w: w.endswith("ly") & w.rlike("^[a-z]{2,}ly$") & ~w.isin([w for w in L.LY_KEEP if w != "italy"])

    # Each ASCII word is one key.
    number = lambda x, k: F.when(F.octet_length(x) == F.char_length(x), F.size(k)).otherwise(F.regexp_count(x, F.lit(S.WORD)))

    def one(x: Column) -> Column:
        return S.let(
            S.keys(x),
            lambda k: F.struct(
                x.alias("said"), k.alias("k"), number(x, k).alias("n"), S.normalise(F.regexp_extract(x, S.WORD, 0)).isin(L.ARTICLES).cast("int").alias("article"),
                many(k, lambda w: w.isin(L.SUBORDINATORS)).alias("subordinators"), many(k, lambda w: ~w.isin(list(common))).alias("rare"), many(k, adverb).alias("adverbs"),
                less(x, ",").alias("commas"), less(x, ";").alias("semis"), (less(x, "—") + less(x, "–")).alias("dashes"),
            ),
        )

    return F.transform(sentences, one)


def counted(rows: DataFrame, sentences: str = "s", common: Sequence[str] = L.STOPWORDS) -> DataFrame:
    """Integer counts behind the metrics, for an array of sentences, as texts or as `read` has
    them; over 4 words only."""
    rest = [c for c in rows.columns if c != sentences]
    if rows.schema[sentences].dataType.elementType.typeName() == "string":
        rows = S.once(rows, **{sentences: read(F.col(sentences), common)})
    rows = S.once(rows, _t=F.array_join(F.transform(sentences, lambda x: x["said"]), " "), k=F.flatten(F.transform(sentences, lambda x: x["k"]))).where(F.size("k") >= 5)
    total = lambda a, of=lambda x: x: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + of(x))
    every = lambda c: total(sentences, lambda x: x[c])
    quoted = F.transform(F.regexp_extract_all("_t", F.lit("[\"“]([^\"“”]{2,600}?)[\"”]"), F.lit(1)), lambda q: F.regexp_count(q, F.lit(S.WORD)))
    spaced = (F.char_length("_t") - F.char_length(F.replace("_t", F.lit(" - "), F.lit("")))) / 3
    return rows.select(
        *rest,
        F.size("k").cast("long").alias("words"), F.size(F.filter(sentences, lambda x: x["n"] > 0)).cast("long").alias("sentences"), F.size(sentences).cast("long").alias("spans"),
        every("n").alias("in_sentences"), total(sentences, lambda x: x["n"] * x["n"]).alias("squares"),
        every("commas").alias("commas"), every("semis").alias("semis"), (every("dashes") + spaced.cast("long")).alias("dash_marks"),
        every("subordinators").alias("subordinators"), every("rare").alias("rare"),
        mattr(F.col("k")).alias("ttr"),
        every("adverbs").alias("adverb_words"), every("article").alias("articles"),
        # The first letter is looked at before what stands around it.
        F.regexp_count("_t", F.lit("(?i)(?=[la])(?<![\\p{L}\\p{N}_])(?:like a|like an|as if|as though|as [\\p{L}\\p{N}_]+ as)(?![\\p{L}\\p{N}_])")).cast("long").alias("simile_marks"),
        total(quoted).alias("quoted"),
    )


def measured(rows: DataFrame) -> DataFrame:
    """The metrics from their counts."""
    w, n = F.col("words"), F.col("sentences")
    mean = F.col("in_sentences") / n
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / n - mean * mean)) / mean
    per = lambda c: F.col(c) * 1000 / w
    of = {
        "sentence_words": mean, "sentence_spread": F.when(n > 1, spread).otherwise(0.0), "comma_density": F.col("commas") * 100 / w, "semicolons": per("semis"), "dashes": per("dash_marks"),
        "subordination": F.col("subordinators") / n, "rarity": F.col("rare") / w, "ttr": F.col("ttr"), "adverbs": per("adverb_words"), "article_openings": F.col("articles") / F.col("spans"),
        "similes": per("simile_marks"), "dialogue": F.col("quoted") / w,
    }
    used = {"in_sentences", "squares", "commas", "semis", "dash_marks", "subordinators", "rare", "ttr", "adverb_words", "articles", "simile_marks", "quoted", "spans"}
    return rows.select(*[c for c in rows.columns if c not in used], *[x.alias(m) for m, x in of.items()])


def long_form(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    return rows.select(*keep, F.expr(f"stack({len(METRICS)}, {pairs}) AS (metric, value)"))


def fit(docs: DataFrame, group: str | None = None, id_col: str = "doc_id", text_col: str = "text", common: Sequence[str] = L.STOPWORDS) -> DataFrame:
    """Baseline: (grp, metric, mean, sd, windows) over the windows of a group's documents."""
    grp = F.col(group).cast("string") if group else F.lit("all")
    return baseline(measured(counted(windows(docs.select(grp.alias("grp"), F.col(text_col).alias("text")), id_col, "text"), common=common)))


def baseline(rows: DataFrame) -> DataFrame:
    """The baseline of measured windows (grp and the metrics)."""
    return long_form(rows, ["grp"]).groupBy("grp", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("windows"))


def profiled(docs: DataFrame, group: str | None = None, id_col: str = "doc_id", text_col: str = "text", common: Sequence[str] = L.STOPWORDS, size: int = WINDOW) -> DataFrame:
    """(id, grp, whole, words, sentences, the metrics): a row for each window of a text and one
    for the whole of it. A text's sentences and words are read once for all of them."""
    grp = F.col(group).cast("string") if group else F.lit("all")
    d = S.once(docs.select(F.col(id_col).alias("id"), grp.alias("grp"), F.col(text_col).alias("text")), _s=read(S.sentences(F.col("text")), common)).drop("text")
    words = F.aggregate("_s", F.lit(0), lambda a, x: a + x["n"])
    d = S.once(d, _w=F.coalesce(_cut("_s", words, size), F.slice(F.array("_s"), 1, 0)))
    row = lambda whole: lambda s: F.struct(F.lit(whole).alias("whole"), s.alias("s"))
    return measured(counted(d.select("id", "grp", F.inline(F.concat(F.transform("_w", row(False)), F.array(row(True)(F.col("_s")))))), common=common))


def score(docs: DataFrame, baseline: DataFrame, group: str | None = None, id_col: str = "doc_id", text_col: str = "text", common: Sequence[str] = L.STOPWORDS) -> DataFrame:
    """(id, metric, baseline, value, z): how far each whole text is from its group's baseline.

    A baseline has twelve rows per group, far fewer than documents; Spark picks the join."""
    grp = F.col(group).cast("string") if group else F.lit("all")
    whole = S.once(docs.select(F.col(id_col).alias("id"), grp.alias("grp"), F.col(text_col).alias("text")), s=S.sentences(F.col("text"))).drop("text")
    return scored(measured(counted(whole, common=common)), baseline, id_col)


def scored(whole: DataFrame, baseline: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The scores of measured whole texts (id, grp, words, sentences and the metrics)."""
    rows = long_form(whole, ["id", "grp", "words", "sentences"]).join(baseline, ["grp", "metric"])
    need = lambda table, c: F.coalesce(*[F.when(F.col("metric") == m, F.col(c) >= n) for m, n in table.items()], F.lit(True))
    rows = rows.where(need(NEEDS_SENTENCES, "sentences") & need(NEEDS_WORDS, "words"))
    base, value, sd = F.col("mean"), F.col("value"), F.coalesce("sd", F.lit(0.0))
    clamp = lambda x, limit: F.greatest(F.lit(-limit), F.least(F.lit(limit), x))
    noise = F.col("metric").isin(list(COUNT_RATES)) & (F.abs(value - base) < NOISE * 1000 / F.col("words"))
    flat = sd <= F.greatest(F.lit(1e-9), F.abs(base) * 0.02)
    z = F.when(noise, 0.0).when(flat, clamp(3.0 * (value - base) / F.greatest(F.abs(base), F.lit(1e-6)), 3.0)).otherwise(clamp((value - base) / sd, 6.0))
    return rows.select(F.col("id").alias(id_col), "grp", "metric", base.alias("baseline"), value.alias("value"), z.alias("z"))


def drift(scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Root mean square of all z of a document, and how many are notable."""
    return scores.groupBy(id_col).agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("drift"), F.count_if(F.abs("z") >= 1.5).alias("notable"), F.count("*").alias("metrics"))


def nearest_group(baseline: DataFrame) -> DataFrame:
    """Of each group the group with the most alike baseline: lowest root mean square of
    differences in units of the group's own spread. Groups meet on the metric."""
    a = baseline.select(F.col("grp"), "metric", F.col("mean").alias("m"), F.col("sd").alias("s"))
    b = baseline.select(F.col("grp").alias("other"), "metric", F.col("mean").alias("n"))
    z = (F.col("m") - F.col("n")) / F.greatest("s", F.abs("m") * 0.02, F.lit(1e-6))
    far = a.join(b, "metric").where("grp <> other").groupBy("grp", "other").agg(F.sqrt(F.avg(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z)) ** 2)).alias("distance"))
    return far.groupBy("grp").agg(F.min(F.struct("distance", "other")).alias("x")).select("grp", F.col("x.other").alias("nearest"), F.col("x.distance").alias("distance"), (F.col("x.distance") < 1.0).alias("alike"))


#: What a metric above and below its baseline is called.
WORDS = {
    "sentence_words": ("longer sentences", "shorter sentences"), "sentence_spread": ("more varied sentence lengths", "more even sentence lengths"), "comma_density": ("more commas", "fewer commas"),
    "semicolons": ("more semicolons", "fewer semicolons"), "dashes": ("more dashes", "fewer dashes"), "subordination": ("more subordinate clauses", "fewer subordinate clauses"),
    "rarity": ("rarer words", "plainer words"), "ttr": ("a wider vocabulary", "a narrower vocabulary"), "adverbs": ("more adverbs", "fewer adverbs"),
    "article_openings": ("more sentences that open with an article", "fewer sentences that open with an article"), "similes": ("more similes", "fewer similes"), "dialogue": ("more dialogue", "less dialogue"),
}


def described(scores: DataFrame, id_col: str = "doc_id", notable: float = 1.5) -> DataFrame:
    """(id, said): the three metrics farthest from the baseline in words, of texts with any notable one."""
    up, down = (F.create_map(*[F.lit(x) for m, w in WORDS.items() for x in (m, w[k])]) for k in (0, 1))
    d = scores.where(F.abs("z") >= notable).withColumn("word", F.when(F.col("z") > 0, up[F.col("metric")]).otherwise(down[F.col("metric")]))
    g = d.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct((-F.abs("z")).alias("far"), "metric", "word"))).alias("x"))  # twelve at most
    return g.select(id_col, F.array_join(F.transform(F.slice("x", 1, 3), lambda x: x["word"]), ", ").alias("said"))


def unborrowed(docs: DataFrame, said: Sequence[str], text_col: str = "text") -> DataFrame:
    """docs without recorded passages, so that a fingerprint is the author's own."""
    return docs.withColumn(text_col, influence.blanked(F.col(text_col), list(said)))


def spoken(lines: DataFrame, speaker: str, text_col: str = "text", least: int = 200) -> DataFrame:
    """lines of the speakers with at least 200 words, as fewer give no fingerprint."""
    enough = lines.groupBy(speaker).agg(F.sum(F.size(S.words(F.col(text_col)))).alias("_n")).where(F.col("_n") >= least).select(speaker)
    return lines.join(enough, speaker, "left_semi")


def since(chapters: DataFrame, earlier: DataFrame, least: int = 120, common: Sequence[str] = L.STOPWORDS) -> DataFrame:
    """Drift of each chapter (ms, id, ord, text) of 120 words and more from an earlier draft's
    chapters: (ms, id, ord, drift, rank, overall, first_half, second_half). The halves are
    means over the chapters in order, from four chapters on; rank 1 is the farthest."""
    kept = chapters.where(F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")) >= least)
    base = fit(earlier, "ms", common=common)
    far = drift(score(kept.select(F.col("id").alias("doc_id"), "ms", "text"), base, "ms", common=common)).select(F.col("doc_id").alias("id"), F.round("drift", 2).alias("drift"))
    d = kept.select("ms", "id", "ord").join(far, "id")
    by = Window.partitionBy("ms")
    place, n = F.row_number().over(by.orderBy("ord")), F.count("*").over(by)
    d = d.withColumn("n", n).withColumn("place", place).withColumn("half", F.when(F.col("place") <= F.floor(F.col("n") / 2), 1).otherwise(2))
    half = lambda k: F.when(F.col("n") >= 4, F.round(F.avg(F.when(F.col("half") == k, F.col("drift"))).over(by), 2)).otherwise(0.0)
    return d.select("ms", "id", "ord", "drift", F.row_number().over(by.orderBy(F.desc("drift"), "ord")).alias("rank"), F.round(F.avg("drift").over(by), 2).alias("overall"), half(1).alias("first_half"), half(2).alias("second_half"))
