"""Drafts, packing, exports and streams."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import drafts
from marginalia.operators import structure as st
from marginalia.plans import exports
from marginalia.streaming import delta


def test_hunks_apply(spark):
    r = random.Random(3)
    said = lambda: r.choice(["One here.", "Two! ", "Three?\n\n", "Four; five.", "Six… ", "tail", "  ", "# Head\n"])
    rows = []
    for i in range(150):
        old = [said() for _ in range(r.randrange(12))]
        new = [x for x in old if r.random() > 0.2]
        for _ in range(r.randrange(3)):
            new.insert(r.randrange(len(new) + 1), said())
        rows.append((f"f{i}", "".join(old), "".join(new)))
    a = spark.createDataFrame([(x, y) for x, y, _ in rows] + [("gone", "Bye. All.")], "rel string, text string")
    b = spark.createDataFrame([(x, z) for x, _, z in rows] + [("born", "Hi. You.")], "rel string, text string")
    h = drafts.hunks(a, b).cache()
    got = {x.rel: x.text for x in drafts.apply(a, h).collect()}
    assert got == {x: z for x, _, z in rows} | {"gone": "", "born": "Hi. You."}
    assert {x.rel: x.text for x in drafts.apply(a, h.limit(0)).collect()} == {x: y for x, y, _ in rows} | {"gone": "Bye. All."}
    assert h.where("rel = 'gone'").count() == 1


def test_versions(spark, tmp_path):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "rel string, text string")
    path = f"file://{tmp_path}/v"
    drafts.save_version(a, path, "first")
    drafts.save_version(a.where("rel = 'x'"), path, "second")
    drafts.save_version(a.where("rel = 'y'"), path, "second")
    assert drafts.load_version(spark, path, "first").count() == 2
    assert [r.rel for r in drafts.load_version(spark, path, "second").collect()] == ["y"]


def test_assemble():
    rows = [dict(id=i, band=b, tokens=t, value=v) for i, b, t, v in [("m", 0, 10, 1), ("a", 1, 50, 1.0), ("b", 1, 30, 0.5), ("c", 2, 10, 1), ("d", 2, 5, 1), ("e", 4, 100, 9), ("f", 4, 4, 0.1)]]
    assert drafts.assemble(rows, 100) == ["m", "a", "b", "d", "f"]
    with pytest.raises(ValueError):
        drafts.assemble(rows, 5)


def test_exports_and_candidates(spark, tmp_path):
    files = spark.createDataFrame([("a.md", 0, "# A\n\none two\n\n## B\n\nthree\n"), ("b.md", 1, "# 7. C\n\nfour five six\n")], "rel string, file_order int, text string")
    assert exports.plain(files).first().text == "# A\n\none two\n\n## B\n\nthree\n\n\n# 7. C\n\nfour five six\n"
    sec = st.sections(st.blocks(files)).cache()
    assert [r.line for r in exports.outline(sec).collect()] == ["1 A (2 words)", "  1.1 B (1 words)", "7 C (3 words)"]
    assert [r.heading for r in exports.numbered(sec).orderBy("ord").collect()] == ["# 1 A", "## 1.1 B", "# 7 C"]
    assert [(r.title, r.words, r.title_page_words) for r in exports.submission(sec).collect()] == [("A", 3, 6), ("C", 3, 6)]
    n = spark.createDataFrame([(99,), (149,), (150,), (17_499,), (17_750,), (40_499,), (40_500,)], "w long")
    assert [r[0] for r in n.select(exports.rounded_words(F.col("w"))).collect()] == [99, 100, 200, 17_500, 18_000, 40_000, 41_000]
    f = spark.createDataFrame([("note", "z", "t1"), ("defect", "y", "t2"), ("warn", "a", "t3")], "severity string, check string, title string")
    assert [r.line for r in exports.report_text(f).collect()] == ["DEFECT [y] t2", "WARN [a] t3", "NOTE [z] t1"]
    exports.report_json(f, f"file://{tmp_path}/j")
    exports.register_csv(f, f"file://{tmp_path}/c")
    assert spark.read.json(f"file://{tmp_path}/j").count() == spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 3
    c = drafts.candidates(sec.withColumn("text", F.col("title")), None, "b.md#1").collect()
    assert {(r.id, r.band) for r in c} == {("b.md#1", 1), ("a.md#2", 1), ("a.md#1", 4)}


def test_streams(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs.write.parquet(f"{tmp_path}/in")
    s = delta.measured(delta.arriving(spark, f"{tmp_path}/in", docs.schema))
    delta.into(s, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    from marginalia.operators import craft

    want = {tuple(r) for r in craft.readability(docs, 1).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*craft.readability(docs, 1).columns).collect()} == want
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{tmp_path}/ev")
    live = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/ev")
    q = delta.activity(live, "ts", "event_type").writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from act").first()[0] == e.count()
    q = delta.fresh(live, "user_id", "ts", "1000 days").writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select count(*) from fresh").first()[0] == e.select("user_id").distinct().count()
