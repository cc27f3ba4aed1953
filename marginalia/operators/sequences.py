"""Orderings: runs, gaps, reversals, streaks, presence. A key's rows are ordered inside one
partition by that key, so a key's rows are sorted by one task, which spills to disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: str, order: list[str], value: str, least: int = 1) -> DataFrame:
    """Consecutive equal values: key, run_no, value, first, last, n (islands by two row numbers' difference)."""
    by = Window.partitionBy(key).orderBy(*order)
    by_value = Window.partitionBy(key, value).orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(by)).withColumn("_g", F.col("_rn") - F.row_number().over(by_value))
    out = rows.groupBy(key, value, "_g").agg(F.min("_rn").cast("long").alias("first"), F.max("_rn").cast("long").alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select(key, value, "first", "last", "n")


def reversals(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is below the previous one's in order."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(F.col(value) < F.col("before"))


def streaks(rows: DataFrame, key: str, day: str) -> DataFrame:
    """The longest run of consecutive days of each key, and the one that ends at its last day."""
    d = rows.select(F.col(key), F.col(day).alias("day")).distinct()
    d = d.withColumn("g", F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day"))))
    s = d.groupBy(key, "g").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return s.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "last").alias("current"), F.max("last").alias("last_day"))


def gaps(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Steps over 1 between consecutive orders of a key: key, after, before, missing."""
    d = rows.select(key, F.col(order).alias("after")).distinct()
    d = d.withColumn("before", F.lead("after").over(Window.partitionBy(key).orderBy("after")))
    return d.where(F.col("before") - F.col("after") > 1).select(key, "after", "before", (F.col("before") - F.col("after") - 1).alias("missing"))


def presence(rows: DataFrame, name: str, chapter: str, chapters: int, least: int = 6, gap: int | None = None) -> DataFrame:
    """Names that are used `least` times, with their longest absence between uses and after the last one."""
    limit = gap or max(4, chapters // 3)
    d = rows.groupBy(name, F.col(chapter).alias("c")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(name).orderBy("c")
    d = d.withColumn("gap", F.lead("c").over(by) - F.col("c") - 1)
    out = d.groupBy(name).agg(F.sum("n").alias("uses"), F.min("c").alias("first"), F.max("c").alias("last"), F.max("gap").alias("inside")).where(F.col("uses") >= least)
    tail = F.lit(chapters - 1) - F.col("last")
    return out.select(name, "uses", "first", "last", F.coalesce("inside", F.lit(0)).cast("long").alias("inside"), tail.cast("long").alias("after"), (F.coalesce("inside", F.lit(0)) >= limit).alias("absent"), ((tail >= limit) & (F.col("uses") >= 10)).alias("gone"))


def dropped(mentions: DataFrame, name: str, order: str, total: int, settled: float = 0.18) -> DataFrame:
    """Threads with at least two sections that end early: the tail is a quarter of all sections (3 at least)."""
    d = mentions.groupBy(name).agg(F.count("*").alias("mentions"), F.min(order).alias("first"), F.max(order).alias("last"), F.countDistinct(order).alias("sections"))
    tail = F.lit(total - 1) - F.col("last")
    return d.where((F.col("last") < total * (1 - settled)) & (F.col("sections") >= 2) & (tail >= max(3, total // 4))).withColumn("tail", tail)
