"""URL filter: rules first, then a ratio of character language models.

Rules give a verdict to the hosts and paths they fit. Every URL that a rule accepts or
rejects trains one of two character models, for accepted and for rejected URLs: variable
order Markov models over a folded alphabet of 40 symbols, of orders 0 to 3, where each
order is smoothed by the next lower one in proportion to how many different symbols
followed its context. A URL without a rule is scored by the difference of the two log
likelihoods over its length, and accepted from the threshold on that lies between the
mean scores of the two kinds of training URLs, nearer to the one with less spread.

All counts are aggregates over all URLs. The table of log ratios has at most 41^4 rows by
its alphabet, in fact those that occur; it is joined to the URLs' distinct symbols with
their counts, so each URL sends a row per distinct context.

Null URLs and URLs without :// have no host and no path; they have no symbols, score 0
and get the verdict of that score. Without both kinds of training URLs every score is 0
and accepted. Repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed values of the query: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ORDER = 3
#: Rows of the table of ratios that are broadcast, under 50 MB.
GRAMS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def folded(host: Column, path: Column) -> Column:
    """Host and path in 40 symbols: a-z, 0-9 as 0, marks as themselves, others as ~."""
    text = F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "0" * 9)
    return F.regexp_replace(text, r"[^a-z0./_%&=+:@-]", "~")


def contexts(text: Column) -> Column:
    """map-like array of (gram, n): each symbol with the 3 before it, ^ before the start."""
    padded = F.concat(F.lit("^" * ORDER), text, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return F.when(F.char_length(text) > 0, grams).otherwise(F.array().cast("array<string>"))


def ratios(counts: DataFrame, seen: DataFrame) -> DataFrame:
    """(gram, ratio) of every gram in seen: log of the accepted over the rejected chance.

    counts: gram, good, bad of the training URLs."""
    table = seen.select("gram")
    rows = counts
    levels = []
    for k in range(ORDER + 1):  # k: length of the context
        tail = rows.groupBy(F.right("gram", F.lit(k + 1)).alias(f"g{k}")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        head = tail.groupBy(F.expr(f"left(g{k}, {k})").alias(f"c{k}")).agg(
            *[F.sum(x).alias(f"all_{x}{k}") for x in ("good", "bad")], *[F.sum((F.col(x) > 0).cast("int")).alias(f"kinds_{x}{k}") for x in ("good", "bad")]
        )
        levels.append((tail.select(f"g{k}", F.col("good").alias(f"n_good{k}"), F.col("bad").alias(f"n_bad{k}")), head))
    for k, (tail, head) in enumerate(levels):
        table = table.withColumn(f"g{k}", F.right("gram", F.lit(k + 1))).withColumn(f"c{k}", F.expr(f"left(g{k}, {k})")).join(tail, f"g{k}", "left").join(head, f"c{k}", "left")
    chance = {}
    for x in ("good", "bad"):
        p = F.lit(1.0 / 41)
        for k in range(ORDER + 1):
            n, total, kinds = (F.coalesce(F.col(f"{c}_{x}{k}"), F.lit(0)) for c in ("n", "all", "kinds"))
            p = F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p)
        chance[x] = p
    return table.select("gram", F.log(chance["good"] / chance["bad"]).alias("ratio"))


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score of every page."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"), folded(F.col("host"), F.col("path")).alias("text"))
    # URLs that fold to the same text have the same grams: they are counted as one, with a weight.
    texts = rows.groupBy("text").agg(F.sum((F.col("said") == "allow").cast("int")).alias("good"), F.sum((F.col("said") == "block").cast("int")).alias("bad"))
    texts = materialise(texts.na.fill(0, ["good", "bad"]), "urls")
    grams = texts.select("text", "good", "bad", F.explode(contexts(F.col("text"))).alias("gram"))
    counts = materialise(grams.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "grams")
    table = materialise(ratios(counts.where("good > 0 or bad > 0"), counts), "ratios")
    # The alphabet allows 41^4 rows; there are some thousands. Beyond GRAMS rows the join shuffles.
    table = F.broadcast(table) if table.count() <= GRAMS else table
    scored = grams.select("text", "gram").join(table, "gram").groupBy("text").agg(F.round(F.sum("ratio") / F.count("*"), 9).alias("score"))
    scored = materialise(texts.join(scored, "text", "left").select("text", "good", "bad", F.coalesce("score", F.lit(0.0)).alias("score")), "scores")
    weight = lambda w: [F.sum(F.col(w)), F.sum(F.col(w) * F.col("score")), F.sum(F.col(w) * F.col("score") ** 2)]
    n, s, q, m, t, u = scored.agg(*weight("good"), *weight("bad")).first()
    both = bool(n and m)
    rows = rows.join(scored.select("text", "score"), "text")
    if both:
        good, bad = s / n, t / m
        wide = [max(q / n - good**2, 0) ** 0.5 + 1e-9, max(u / m - bad**2, 0) ** 0.5 + 1e-9]
        cut = (good * wide[1] + bad * wide[0]) / (wide[0] + wide[1])
    else:
        cut = 0.0
        rows = rows.withColumn("score", F.lit(0.0))
    # Sums of floats depend on their order: scores and cut are compared at nine digits.
    own = F.when(F.col("score") >= round(cut, 9), "allow").otherwise("block")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "score")
