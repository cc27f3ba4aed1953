"""Reading folders, blocks, prose, sections and what is derived from them."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.operators import structure as st
from marginalia.sources import manuscript

MANUAL = """---
title: x
---
Preface words here.

# 1. Fitting

Fit the lid. See Section 2.1 and Figure 3 and section 9.9.

Figure 3: The lid

1. Undo the bolts.
2. Lift the lid.
4. Clean `code 1` the seat.

## 2.1 Care

```
not prose # 1
```

> quoted *words* here

| a | b |
|---|---|

***

- item one
- item two

Deep
----
tail
"""


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f'<w:p><w:pPr>{f"<w:pStyle w:val=%s/>" % (chr(34) + s + chr(34)) if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = para("Top", "Heading1") + para("Plain 1. text") + para("# not a heading") + para("one", "ListBullet") + "<w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:t>kept</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("book")
    (d / "2-b.md").write_text("# Two\n\nWords.\n\n***\n\nMore words here.\n")
    (d / "10-c.txt").write_bytes(b"Chapter 1\n\nCaf\xe9 time.\r\nx\r\n")
    (d / "1-a.md").write_text("﻿" + MANUAL, encoding="utf-8")
    (d / "1-a.thinking.md").write_text("notes")
    (d / "3.docx").write_bytes(docx())
    (d / "4.docx").write_bytes(b"broken")
    (d / ".git").mkdir()
    (d / ".git" / "x.md").write_text("no")
    (d / "pic.png").write_bytes(b"no")
    (d / "w.txt").write_bytes("﻿wide é".encode("utf-16-le"))
    return d


def test_read(spark, folder):
    files, bad, side = manuscript.read(spark, f"file://{folder}")
    got = {r.rel: r for r in files.collect()}
    assert [r.rel for r in sorted(got.values(), key=lambda r: r.file_order)] == ["1-a.md", "2-b.md", "3.docx", "10-c.txt", "w.txt"]
    assert got["10-c.txt"].text == "Chapter 1\n\nCafé time.\nx\n" and got["10-c.txt"].encoding == "cp1252" and got["10-c.txt"].newline == "\r\n"
    assert got["w.txt"].text == "wide é" and got["w.txt"].encoding == "utf-16-le"
    assert got["1-a.md"].text == MANUAL and not got["1-a.md"].derived
    assert got["3.docx"].text == "# Top\n\nPlain 1. text\n\n\\# not a heading\n\n- one\n\nkept\n" and got["3.docx"].derived
    assert [r.rel for r in bad.collect()] == ["4.docx"] and [r.rel for r in side.collect()] == ["1-a.thinking.md"]


def test_scan_and_prose():
    found = st.scan(MANUAL)
    assert [b[0] for b in found] == ["front", "para", "heading", "para", "para", "ordered", "ordered", "ordered", "heading", "code", "quote", "table", "rule", "list", "list", "heading", "para"]
    assert [b[5] for b in found if b[0] == "ordered"] == [1, 2, 4] and [b[4] for b in found if b[0] == "heading"] == [1, 2, 2]
    assert all(MANUAL[b[1] : b[2]].strip().startswith(b[3][:3]) or b[0] == "heading" for b in found)
    shown = st.prose(MANUAL, found)
    assert len(shown) == len(MANUAL) and shown.count("\n") == MANUAL.count("\n")
    for hidden in ("code 1", "not prose", "title", "Fitting", ">", "| a |", "*words*", "1. Undo"):
        assert hidden not in shown
    for kept in ("Undo the bolts", "quoted", "item two", "tail"):
        assert shown.index(kept) == MANUAL.index(kept)
    assert [b[0] for b in st.scan("~~~\n\ntext\n```\nopen")] == ["rule", "para", "rule", "para"]
    t = "a <!-- b --> [lab](url) <b>x</b> <http://q> **bold** snake_case 2 < 3"
    assert st.prose(t, st.scan(t)).split() == ["a", "lab", "x", "bold", "snake", "case", "2", "<", "3"]
    # A thought in angle brackets, a key's name and doubled back-quotes are prose.
    for t in ("She heard <Where are you?> and <I love you> twice.", "Press <Enter> now.", "He said ``hello'' and then `code` went.", "<A ship comes> said it."):
        shown = st.prose(t, st.scan(t))
        assert len(shown) == len(t) and shown == t.replace("`code`", "      ")
    assert st.prose("x <a href='y' id=z>k</a> <br/> <img src=\"q\"> end", [("para", 0, 51, "", 0, 0)]).split() == ["x", "k", "end"]


def test_sections(spark, folder):
    files, _, _ = manuscript.read(spark, f"file://{folder}")
    blocks = st.blocks(files).cache()
    sec = st.sections(blocks).cache()
    rows = sec.orderBy("ord").collect()
    assert [(r.id, r.title, r.level, r.number, r.derived_number) for r in rows] == [
        ("1-a.md#1", "1-a", 1, "", "1"), ("1-a.md#2", "Fitting", 1, "1", "2"), ("1-a.md#3", "Care", 2, "2.1", "2.1"), ("1-a.md#4", "Deep", 2, "", "2.2"),
        ("2-b.md#1", "Two", 1, "", "3"), ("3.docx#1", "Top", 1, "", "4"), ("10-c.txt#1", "Chapter 1", 1, "", "5"), ("w.txt#1", "w", 1, "", "6"),
    ]
    assert {r.id: r.parent_id for r in rows}["1-a.md#4"] == "1-a.md#2" and rows[0].parent_id is None
    assert {r.id: r.words for r in rows}["2-b.md#1"] == 4
    loc = st.located(blocks, sec).cache()
    for b in loc.collect():
        own = [r for r in rows if r.rel == b.rel and r.start <= b.start]
        assert b.section_id == max(own, key=lambda r: r.start).id
    assert st.paragraphs(loc).where("section_id = '1-a.md#2'").count() == 5
    assert [(r.scene, r.words) for r in st.scenes(loc).where("section_id = '2-b.md#1'").orderBy("scene").collect()] == [(0, 1), (1, 3)]
    assert {r.id for r in st.leaves(sec).collect()} == {r.id for r in rows} - {"1-a.md#2"}
    assert {r.id: r.root for r in st.roots(sec).collect()}["1-a.md#3"] == "1-a.md#2"
    assert st.chapters(sec).count() == 6
    bad = st.steps(loc).collect()
    assert [(r.numbers, r.missing, r.repeated) for r in bad] == [([1, 2, 4], [3], [])]
    refs = {(r.what, r.target) for r in st.broken_references(loc, sec).collect()}
    assert refs == {("section", "9.9")}
    assert st.sections(blocks.where(F.lit(False))).count() == 0
