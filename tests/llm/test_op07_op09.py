"""Licence digests and perspective rotation: SQL oracles, planted texts, odd rows."""

import duckdb

from marginalia.llm import licences, op07_licence, op09_chat, queries

SF = "/root/testdata/sf0.001"


def same(spark, name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.select(*cols).collect()) == order(want.select(*cols).fetchall())


def test_oracles(spark):
    same(spark, "op7_licence_scan")
    same(spark, "op9_chat_rotation")


def test_licence_variants(spark):
    mit, bsd = op07_licence.LICENCES["MIT"], op07_licence.LICENCES["BSD-3-Clause"]
    rows = [
        (1, "Copyright (c) 2020 A. Author\n\n" + mit, "MIT"),
        (2, "© Someone 1999\nCopyright 2001 Other\n" + mit.upper().replace("\n", "  "), "MIT"),
        (3, mit.replace("sublicense", "sublicence").replace('"', "“"), "MIT"),
        (4, bsd.replace("AND/OR", "and / or").replace("copyright holder nor", "copyright owner nor"), "BSD-3-Clause"),
        (5, mit + "more", None),
        (6, mit[:-30], None),
        (7, "", None),
        (8, None, None),
        (1, "Copyright (c) 2020 A. Author\n\n" + mit, "MIT"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, digest string")
    got = op07_licence.scan(docs).collect()
    assert sorted((r.doc_id, r.license_id or "") for r in got) == sorted((i, w or "") for i, _, w in rows)
    assert all(r.is_license == (r.license_id is not None) for r in got)
    assert op07_licence.scan(docs.limit(0)).count() == 0


def test_whole_standard_files(spark):
    apache = licences.full()["Apache-2.0"]
    note = "Copyright (c) 2020, A. Author\nAll rights reserved.\n\n"
    rows = [(title, name) for name, title in (("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("0BSD", "BSD Zero Clause License"))]
    want = {i: name for i, (_, name) in enumerate(rows)} | {90: "Apache-2.0", 91: "Apache-2.0"}
    docs = [(i, f"{title}\n\n{note}{op07_licence.LICENCES[name]}") for i, (title, name) in enumerate(rows)]
    docs += [(90, apache), (91, apache.replace("[yyyy] [name of copyright owner]", "2020 A. Author")), (92, apache[:-300]), (93, "MIT License")]
    docs += [(200 + i, t) for i, t in enumerate(licences.full().values())]
    want |= {200 + i: k for i, k in enumerate(licences.full())}
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(licences.full())
    got = op07_licence.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == want | {92: None, 93: None}


def test_licences_equal_sql_on_a_planted_table(spark, tmp_path):
    """Every form of every licence, each in another dress, among texts that are none."""
    dress = [lambda t: t, lambda t: t.upper(), lambda t: "Copyright 2001 An Author\n" + t, lambda t: t.replace("\n", "\r\n  "), lambda t: "« " + t.replace("license", "licence") + " »"]
    rows = [(i, dress[i % len(dress)](t)) for i, (_, t) in enumerate(op07_licence.forms(op07_licence.LICENCES))]
    rows += [(900, None), (901, ""), (902, rows[0][1] + " not"), (903, rows[1][1][:200])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d.parquet/*.parquet'")
    want = con.sql(op07_licence.oracle())
    got = op07_licence.scan(spark.read.parquet(f"{tmp_path}/d.parquet")).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    assert sum(r.is_license for r in got) == len(rows) - 4


def test_rotation(spark):
    rows = [("a", 0, "system", "be kind"), ("a", 1, "Ann", "hi <|im_end|>"), ("a", 2, "Bob", None), ("a", 70, None, "é🙂"), ("a", 1, "Ann", "hi <|im_end|>"), ("b", 0, "system", "alone"), (None, None, "Cy", "x")]
    chats = spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn long, role string, text string, block int")
    got = {(r.conv_id, r.participant, r.block): r for r in op09_chat.perspectives(chats).collect()}
    assert set(got) == {("a", p, b) for p in ("Ann", "Bob", "unknown") for b in (0, 1)} | {(None, "Cy", -1)}
    ann = got["a", "Ann", 0]
    assert ann.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <| im_end|><|im_end|>\n<|im_start|>user name=Bob\n<|im_end|>\n"
    assert [ann.rendered[m.start : m.end] for m in ann.mask] == ["hi <| im_end|><|im_end|>"]
    own = got["a", "unknown", 1]
    assert [own.rendered[m.start : m.end] for m in own.mask] == ["é🙂<|im_end|>"] and got["a", "Bob", 1].mask == []
    assert op09_chat.perspectives(chats.limit(0)).count() == 0


def plain_rendering(rows, who):
    out = ""
    for _, role, text in sorted(set(rows)):
        head = "assistant" if role == who else "system" if role == "system" else f"user name={role}"
        out += f"<|im_start|>{head}\n{text}<|im_end|>\n"
    return out


def test_crowded_turns_keep_the_reading_order(spark, tmp_path):
    """Turns with many texts are cut into bounded parts; the pieces in order are the dialogue."""
    crowd = lambda t, n: [(t, "uvw"[i % 3], f"x{i:03}") for i in range(n)]
    a = [(t, "uv"[t % 2], f"t{t}") for t in (1, 2, 4, 5, 8, 63, 64, 70)] + crowd(3, 100) + crowd(6, 400) + crowd(7, 65) + crowd(63, 64) + crowd(66, 200) + [(0, "system", "be kind")]
    b = crowd(-3, 90) + [(-1, "u", "é"), (-4, "u", "first")]
    rows = [("a", *r) for r in a] + [(None, *r) for r in b] + [("a", *a[20])]
    chats = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(5)
    got = op09_chat.perspectives(chats).collect()
    assert max(r.n_turns for r in got) <= op09_chat.BLOCK**2
    for conv, own in (("a", a), (None, b)):
        for who in {role for _, role, _ in own} - {"system"}:
            pieces = sorted((r for r in got if r.conv_id == conv and r.participant == who), key=lambda r: (r.block, r.segment, r.part))
            assert len({(r.block, r.segment, r.part) for r in pieces}) == len(pieces)
            assert "".join(r.rendered for r in pieces) == plain_rendering(own, who)
            assert [p.rendered[m.start : m.end] for p in pieces for m in p.mask] == [f"{t}<|im_end|>" for _, role, t in sorted(set(own)) if role == who]
    path = f"{tmp_path}/conversations.parquet"
    chats.write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/*.parquet'")
    want = con.sql(op09_chat.ORACLE)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(op09_chat.report(spark.read.parquet(path)).select(*want.columns).collect()) == order(want.fetchall())
