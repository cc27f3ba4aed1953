"""Keyword retrieval: BM25 over any table of passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

K1, B = 1.5, 0.75
#: Fixed value: a word has two characters at least.
WORD = "[A-Za-z][A-Za-z'\\-]+"
#: Queries' terms, one row for each query, that are sent to the passages.
FEW = 1 << 18


def terms(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, len: counted within each passage's row; sorted words that are equal are neighbours."""
    words = F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)), F.lower)
    d = S.once(passages.select(F.col(id_col).alias("id"), F.col(text_col)), w=F.sort_array(words)).where(F.size("w") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.coalesce(F.get("w", i) != F.get("w", i - 1), F.lit(True)))
    d = S.once(d.select("id", "w"), f=first)
    own = F.transform("f", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("f", k + 1), F.size("w")) - i).cast("long").alias("tf")))
    return d.select("id", F.size("w").alias("len"), F.inline(own)).select("id", "term", "tf", "len")


def search(passages: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """The k best passages of each query: query_id, id, score, rank.

    Only terms that some query has are kept, right after the scan. The queries' terms are
    counted first: up to FEW of them go out to the passages, of which only the sums for a query
    are shuffled. Spark cuts each task's scores to a query's k best before they meet in that
    query's window."""
    q = terms(queries, query_id, query_text).select(F.col("id").alias("query_id"), "term").distinct()
    size = passages.select(F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    sent = F.broadcast if q.limit(FEW + 1).count() <= FEW else lambda d: d
    t = terms(passages, id_col, text_col).join(sent(q.select("term").distinct()), "term", "left_semi")
    listed = q.join(t.groupBy("term").agg(F.count("*").alias("df")), "term")
    t = t.join(sent(listed), "term").join(F.broadcast(size))  # one row of sizes
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = t.withColumn("weight", weight).groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def relevance(hits: DataFrame, passages: DataFrame, limit: int = 24, id_col: str = "id") -> DataFrame:
    """(query_id, section_id, relevance): a section's best passage over the query's best one.

    hits: search() of passages that have a section_id; the best `limit` sections are listed."""
    best = hits.join(passages.select(F.col(id_col).alias("id"), "section_id"), "id").groupBy("query_id", "section_id").agg(F.max("score").alias("score"))
    top = best.groupBy("query_id").agg(F.max("score").alias("top"))
    d = best.join(top, "query_id").select("query_id", "section_id", (F.col("score") / F.col("top")).alias("relevance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "section_id"))
    return d.withColumn("rank", rank).where(F.col("rank") <= limit)
