"""What a reader of a Word file sees, and nothing twice."""

import io
import zipfile

from marginalia.sources import manuscript

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"


def word(body, styles="", numbering=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, tag, inner in (("document", "document", f"<w:body>{body}</w:body>"), ("styles", "styles", styles), ("numbering", "numbering", numbering)):
            if inner:
                z.writestr(f"word/{name}.xml", f'<?xml version="1.0"?><w:{tag} xmlns:w="{W}" xmlns:mc="{MC}">{inner}</w:{tag}>')
    return manuscript.read_docx(out.getvalue())


def p(*runs, style="", props=""):
    name = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{name}{props}</w:pPr>{''.join(r if r.startswith('<') else f'<w:r><w:t>{r}</w:t></w:r>' for r in runs)}</w:p>"


def test_paragraphs_controls_moves_and_symbols():
    assert word(f"<w:sdt><w:sdtPr><w:tag w:val='x'/></w:sdtPr><w:sdtContent>{p('Inside.')}</w:sdtContent></w:sdt>{p('After.')}") == "Inside.\n\nAfter.\n"
    assert word(p("A ", "<w:sdt><w:sdtContent><w:r><w:t>b</w:t></w:r></w:sdtContent></w:sdt>", " c")) == "A b c\n"
    assert word(p('<w:moveFrom><w:r><w:t>Moved.</w:t></w:r></w:moveFrom>', "Stays.") + p("<w:moveTo><w:r><w:t>Moved.</w:t></w:r></w:moveTo>") + p("<w:del><w:r><w:delText>gone</w:delText></w:r></w:del>", "<w:ins><w:r><w:t>new</w:t></w:r></w:ins>")) == "Stays.\n\nMoved.\n\nnew\n"
    assert word(p("Wi", "<w:r><w:noBreakHyphen/></w:r>", "Fi at 10 k", '<w:r><w:sym w:font="Symbol" w:char="F057"/></w:r>', "<w:r><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r>")) == "Wi-Fi at 10 kΩ\tx\ny\n"
    assert word(p("<w:r><w:instrText>PAGE</w:instrText></w:r>", "7")) == "7\n" and word(p("# no heading") + p("1. no list") + p("")) == "\\# no heading\n\n\\1. no list\n"


def test_text_boxes_stand_alone_and_once():
    box = f"<w:txbxContent>{p('Hot surface')}{p('Mind it')}</w:txbxContent>"
    body = p("See the label.", f"<w:r><mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback></mc:AlternateContent></w:r>", " And on.") + p("Next.")
    assert word(body) == "See the label. And on.\n\nHot surface\n\nMind it\n\nNext.\n"


def test_headings_by_name_outline_and_inheritance():
    styles = '<w:style w:styleId="x1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="mine"><w:name w:val="Mine"/><w:basedOn w:val="base"/></w:style><w:style w:styleId="base"><w:name w:val="Base"/><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style><w:style w:styleId="loop"><w:basedOn w:val="loop"/></w:style>'
    assert word(p("A", style="x1") + p("B", style="mine") + p("C", props='<w:outlineLvl w:val="1"/>') + p("D", style="Title") + p("E", style="loop") + p("F", props='<w:outlineLvl w:val="9"/>'), styles) == "# A\n\n### B\n\n## C\n\n# D\n\nE\n\nF\n"


def test_lists_by_paragraph_and_by_style():
    numbering = '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num>'
    styles = '<w:style w:styleId="step"><w:name w:val="Step"/><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style>'
    n = lambda level, num=5: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>'
    body = p("one", props=n(0)) + p("two", style="step") + p("dot", props=n(1)) + p("plain", style="step", props=n(0, 0)) + p("again", style="step") + p("item", style="ListBullet") + p("x", style="ListNumber")
    assert word(body, styles, numbering) == "1. one\n2. two\n\n- dot\n\nplain\n\n1. again\n\n- item\n\n1. x\n"


def test_tables():
    cell = lambda *ps: f"<w:tc>{''.join(ps)}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell(p('in'))}{cell(p('ner'))}</w:tr></w:tbl>"
    table = f"<w:tbl><w:tblPr/><w:sdt><w:sdtContent><w:tr>{cell(p('a'), p('b'))}<w:sdt><w:sdtContent>{cell(p('c'))}</w:sdtContent></w:sdt></w:tr></w:sdtContent></w:sdt><w:tr>{cell(inner, p('d'))}{cell(p(''))}</w:tr></w:tbl>"
    assert word(p("Before.") + table + p("After.")) == "Before.\n\n| a b | c |\n| in ner d |  |\n\nAfter.\n"
