"""Bit-parallel cuts against regular expressions, round trips, and the SQL over odd texts."""

import hashlib
import random
import re

import duckdb
import pytest

from marginalia.llm import op12_middle as op

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"^[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", "char": r"(?s)."}
ODD = ["", None, "\n", "a", "a\n", "\n\na", "no <P> here", "<S", "a<\nS>b\n<M", "é🙂\nü\n\n", "\r\n x", "x" * 9000, "\n" * 70000, "ab c\n" * 40000, "<M>", "\x00\n \x85", " a  b ", "  "]


def odd(n=300):
    r = random.Random(2)
    return [*ODD, *("".join(r.choice(["a", "\n", " ", "é", "🙂", "<", "P>", "S>", "M>", "\r"]) for _ in range(r.randrange(30))) for _ in range(n))]


def plain(ident, text, unit, rate, spm):
    text = text or ""
    units = [u for u in re.findall(UNITS[unit], text) if u]
    digest = hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("word", 60, 0), ("char", 100, 100)])
def test_rewritten_equals_plain(spark, unit, rate, spm):
    rows = [(i if i else None, t) for i, t in enumerate(odd())]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, form string").repartition(4)
    out = op.rewritten(docs, unit=unit, rate=rate, spm=spm)
    got = {r.doc_id: r for r in out.withColumn("back", op.restored(out["output"], out["form"])).collect()}
    assert len(got) == len(rows)
    for ident, text in rows:
        r = got[ident]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(ident, text, unit, rate, spm)
        assert r.back == (text or "")
    assert op.rewritten(docs.limit(0)).count() == 0


def test_selected():
    r = random.Random(1)
    for _ in range(200):
        bits = r.getrandbits(r.randrange(1, 400)) | 1
        places = [i for i in range(bits.bit_length()) if bits >> i & 1]
        k = r.randrange(len(places))
        assert op.selected(bits, k, bits.bit_length()) == places[k]


def test_report_equals_sql_on_odd_texts(spark, tmp_path):
    rows = [(i if i else None, t) for i, t in enumerate(odd()) if "\x00" not in (t or "")]
    spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d.parquet/*.parquet'")
    want = con.sql(op.ORACLE)
    got = op.report(spark.read.parquet(f"{tmp_path}/d.parquet")).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
