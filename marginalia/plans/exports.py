"""Exports: plain and numbered texts, outlines, registers and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.findings import ranked
from ..operators.structure import scene_blocks


def plain(files: DataFrame) -> DataFrame:
    """One text: the files in order, a blank line between. The caller asked for one text, so it ends in one row."""
    return files.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_order", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def numbered(sections: DataFrame, max_level: int = 3) -> DataFrame:
    """(ord, heading): headings with the author's number, else the derived one."""
    number = F.when(F.col("number") != "", F.col("number")).otherwise(F.col("derived_number"))
    return sections.select("ord", F.concat(F.repeat(F.lit("#"), F.least(F.col("level"), F.lit(6))), F.lit(" "), number, F.lit(" "), F.col("title")).alias("heading"), (F.col("level") <= max_level).alias("in_contents"))


def outline(sections: DataFrame, max_level: int = 3) -> DataFrame:
    number = F.when(F.col("number") != "", F.col("number")).otherwise(F.col("derived_number"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), number, F.lit(" "), F.col("title"), F.lit(" ("), F.col("words").cast("string"), F.lit(" words)"))
    return sections.where(F.col("level") <= max_level).select("ord", line.alias("line")).orderBy("ord")


def rounded_words(words):
    """A title page's word count: exact under 100, then to the next 100, 500 or 1000, halves up."""
    to = lambda n: F.floor(words / n + 0.5) * n
    return F.when(words < 100, words).when(words < 17_500, to(100)).when(words < 40_000, to(500)).otherwise(to(1000)).cast("long")


def submission(sections: DataFrame) -> DataFrame:
    """Chapters of a submission: (chapter, title, words, title_page_words); sub-sections count to their chapter."""
    from ..operators.structure import roots

    words = sections.join(roots(sections), "id").groupBy("root").agg(F.sum("words").alias("words"))
    d = sections.where("parent_id is null").join(words, sections["id"] == words["root"]).select("ord", "title", words["words"])
    total = d.agg(F.sum("words").alias("total"))
    return d.join(F.broadcast(total)).select("ord", "title", "words", rounded_words(F.col("total")).alias("title_page_words")).orderBy("ord")


def register_csv(register: DataFrame, path: str) -> None:
    register.write.mode("overwrite").option("header", True).csv(path)


def report_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def report_summary(report) -> dict:
    """What a run's findings don't say: counts by check and severity, checks that found nothing, those skipped or failed and why, and seconds."""
    rows = report.findings.groupBy("check", "severity").agg(F.count("*").alias("n")).collect() if report.findings is not None else []  # a row for each check and severity
    counts: dict = {}
    for r in sorted(rows):
        counts.setdefault(r["check"], {})[r["severity"]] = r["n"]
    return {"counts": counts, "quiet": [c for c in report.ran if c not in counts], "skipped": report.skipped, "failed": report.failed, "seconds": {k: round(v, 3) for k, v in report.timing.items()}}


def report_text(findings: DataFrame) -> DataFrame:
    """Lines of a report, defects first."""
    return ranked(findings).select(F.concat(F.upper("severity"), F.lit(" ["), F.col("check"), F.lit("] "), F.col("title")).alias("line"))


def numbered_text(files: DataFrame, sections: DataFrame, max_level: int = 3, contents: bool = True) -> DataFrame:
    """(ms, part, ord, text): a contents line for each section up to a level, then each
    section's heading with its number and its text as written. Ordered by part and ord, the
    parts are the export; it is written in that order and never gathered in one row."""
    ms = F.col("ms").cast("string") if "ms" in files.columns else F.lit("")
    f = files.select(ms.alias("ms"), "rel", F.col("text").alias("whole"))
    number = F.when(F.col("number") != "", F.col("number")).otherwise(F.col("derived_number"))
    toc = sections.where((F.col("level") <= max_level) & F.lit(contents)).select("ms", F.lit(0).alias("part"), "ord", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), number, F.lit(" "), "title").alias("text"))
    body = F.regexp_replace(F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start")), "^ {0,3}#{1,6}[^\\n]*\\n?", "")
    body = F.regexp_replace(body, "^\\s+|\\s+$", "")
    head = F.concat(F.repeat(F.lit("#"), F.least(F.col("level"), F.lit(6))), F.lit(" "), number, F.lit(" "), F.col("title"))
    parts = sections.join(f, ["ms", "rel"]).select("ms", F.lit(1).alias("part"), "ord", F.concat_ws("\n\n", head, F.nullif(body, F.lit(""))).alias("text"))
    return toc.unionByName(parts)


def submission_text(located: DataFrame, sections: DataFrame) -> DataFrame:
    """(ms, chapter, ord, start, kind, text): a submission's lines in order. A manuscript with
    one top heading over several children is a title over chapters; sections and scenes
    within a chapter are parted by "#"; the last line is THE END."""
    tops = sections.where("parent_id is null").groupBy("ms").agg(F.count("*").alias("tops"), F.min("id").alias("top"))
    kids = sections.where("parent_id is not null").groupBy("ms", F.col("parent_id").alias("top")).agg(F.count("*").alias("kids"))
    titled = tops.where("tops = 1").join(kids, ["ms", "top"]).where("kids > 1").select("ms", F.col("top").alias("book"))
    s = sections.join(titled, "ms", "left")
    # The chapter of a section: its ancestor right under the title, or at the top.
    parent = sections.select(F.col("id").alias("up"), F.col("parent_id").alias("next"))
    at = s.select("ms", "id", "book", "ord", "title", F.col("id").alias("chapter"), F.col("parent_id").alias("up"))
    for _ in range(5):
        rise = F.col("up").isNotNull() & ~F.col("up").eqNullSafe(F.col("book"))
        at = at.join(parent, "up", "left").select("ms", "id", "book", "ord", "title", F.when(rise, F.col("up")).otherwise(F.col("chapter")).alias("chapter"), F.when(rise, F.col("next")).otherwise(F.col("up")).alias("up"))
    place = sections.select(F.col("id").alias("chapter"), F.col("ord").alias("chapter_ord"), F.col("title").alias("chapter_title"))
    at = at.join(place, "chapter").withColumn("heads", (F.col("id") == F.col("chapter")) & ~F.col("id").eqNullSafe(F.col("book")))
    heading = at.where("heads").select("ms", "chapter", "chapter_ord", "ord", F.lit(-1).alias("start"), F.lit("heading").alias("kind"), F.col("chapter_title").alias("text"))
    rows = scene_blocks(located).join(at.select(F.col("id").alias("section_id"), "chapter", "chapter_ord", "ord"), "section_id").where(F.trim("prose") != "")
    by = Window.partitionBy("ms", "chapter").orderBy("ord", "start")
    said = rows.select("ms", "chapter", "chapter_ord", "ord", "start", "scene", F.regexp_replace(F.trim("prose"), "\\s+", " ").alias("text"))
    here, before = F.struct("ord", "scene"), F.lag(F.struct("ord", "scene")).over(by)
    said = said.withColumn("cut", before.isNotNull() & (before != here))
    para = said.select("ms", "chapter", "chapter_ord", "ord", "start", F.lit("para").alias("kind"), "text")
    cuts = said.where("cut").select("ms", "chapter", "chapter_ord", "ord", (F.col("start") - 0.5).alias("start"), F.lit("break").alias("kind"), F.lit("#").alias("text"))
    last = sections.groupBy("ms").agg(F.max("ord").alias("ord")).select("ms", F.lit(None).cast("string").alias("chapter"), (F.col("ord") + 1).alias("chapter_ord"), (F.col("ord") + 1).alias("ord"), F.lit(0).alias("start"), F.lit("end").alias("kind"), F.lit("THE END").alias("text"))
    out = [x.withColumn("start", F.col("start").cast("double")) for x in (heading, para, cuts, last)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def title_page(sections: DataFrame, title: str, author: str, contact: Sequence[str] = ()) -> list[str]:
    """The lines above a submission: who, about how many words, the title."""
    n = sections.agg(rounded_words(F.sum("words"))).first()[0] or 0
    return [*[c for c in contact if c], "", f"about {n:,} words", "", f"# {title}", *(["", f"by {author}"] if author else [])]
