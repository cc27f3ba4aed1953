"""Reading a folder of manuscripts: files in natural order, decoded text, newlines, notes.

A bad file gives a row in `unreadable` instead of ending the read. Each file is decoded in
the task that read it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes read, folders skipped, the suffix of side notes.
SUFFIXES = (".md", ".markdown", ".txt", ".docx")
SKIPPED = (".workshop", ".git", "__pycache__", "_to_delete", "backups", "node_modules", ".venv", "exports", "audio")
SIDECAR = ".thinking.md"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(raw: bytes) -> tuple[str, str, str]:
    """(text, encoding, note): by byte order mark, else strict UTF-8, else the better of
    UTF-8 with replacements and cp1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace"), "utf-8-sig" if name == "utf-8" else name, ""
    try:
        return raw.decode("utf-8"), "utf-8", ""
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "replace")
        bad = text.count("�")
        good = sum(c > "\x7f" for c in text) - bad
        if good > bad:
            return text, "utf-8", f"{bad} bytes could not be read"
        return raw.decode("cp1252", "replace"), "cp1252", "read as cp1252"


#: Characters of the Symbol font by their code, and where it keeps them.
SYMBOLS = {
    0x44: "Δ", 0x46: "Φ", 0x47: "Γ", 0x4C: "Λ", 0x50: "Π", 0x51: "Θ", 0x53: "Σ", 0x57: "Ω", 0x59: "Ψ", 0x61: "α", 0x62: "β", 0x64: "δ", 0x65: "ε", 0x66: "φ", 0x67: "γ", 0x68: "η",
    0x6B: "κ", 0x6C: "λ", 0x6D: "µ", 0x6E: "ν", 0x70: "π", 0x71: "θ", 0x72: "ρ", 0x73: "σ", 0x74: "τ", 0x77: "ω", 0xA3: "≤", 0xA5: "∞", 0xAC: "←", 0xAE: "→", 0xB0: "°", 0xB1: "±",
    0xB2: "″", 0xB3: "≥", 0xB4: "×", 0xB7: "•", 0xB8: "÷", 0xB9: "≠", 0xBB: "≈", 0xD6: "√",
}
_PRIVATE = 0xF000
#: Parts of a document that a reader doesn't see, or sees elsewhere.
_UNSEEN = ("del", "moveFrom", "delText", "instrText", "Fallback", "rPr", "sectPr", "tblPr", "tblGrid", "trPr", "tcPr", "sdtPr", "sdtEndPr")


def _events(xml: bytes) -> Iterator[tuple[str, str, ElementTree.Element]]:
    """(event, tag without namespace, element) in document order; what was read is let go."""
    for event, node in ElementTree.iterparse(io.BytesIO(xml), events=("start", "end")):
        yield event, node.tag.rsplit("}", 1)[-1], node
        if event == "end":
            node.clear()


def _value(node: ElementTree.Element, name: str = "val") -> str:
    return node.get(f"{_W}{name}") or ""


class Styles:
    """Of each paragraph style: its heading level (0: none), and its list, if any."""

    def __init__(self, styles: bytes | None, numbering: bytes | None):
        self.own: dict[str, dict] = {}
        self.formats: dict[str, dict[str, str]] = {}
        kinds: dict[str, dict[str, str]] = {}
        at: dict = {}
        for event, tag, node in _events(styles) if styles else ():
            if event == "start" and tag == "style":
                at = self.own.setdefault(_value(node, "styleId"), {})
            elif event == "start" and tag in ("name", "basedOn", "outlineLvl", "numId", "ilvl"):
                at.setdefault(tag, _value(node))
        abstract = level = num = ""
        for event, tag, node in _events(numbering) if numbering else ():
            if event != "start":
                continue
            if tag == "abstractNum":
                abstract = _value(node, "abstractNumId")
            elif tag == "lvl":
                level = _value(node, "ilvl")
            elif tag == "numFmt":
                kinds.setdefault(abstract, {}).setdefault(level, _value(node))
            elif tag == "num":
                num = _value(node, "numId")
            elif tag == "abstractNumId" and num:
                self.formats[num] = kinds.get(_value(node), {})

    def of(self, style: str, what: str) -> str:
        """A property of a style or of the first that it is based on and that has one."""
        seen: set[str] = set()
        while style and style not in seen:
            seen.add(style)
            own = self.own.get(style, {})
            if what in own:
                return own[what]
            style = own.get("basedOn", "")
        return ""

    def level(self, style: str, outline: str) -> int:
        said = outline or self.of(style, "outlineLvl")
        for name in (self.own.get(style, {}).get("name", style), style):
            if m := re.fullmatch(r"heading ?(\d)|title", name.lower()):
                return int(m[1] or 1)
        return int(said) + 1 if said.isdigit() and int(said) < 6 else 0

    def list_kind(self, style: str, num: str | None, level: str) -> str:
        """list, ordered or nothing."""
        name = self.own.get(style, {}).get("name", style).lower()
        num = self.of(style, "numId") if num is None else num
        if num == "0":
            return ""
        shape = self.formats.get(num, {}).get(level or self.of(style, "ilvl") or "0", "")
        if shape:
            return "list" if shape in ("bullet", "none") else "ordered"
        return ("ordered" if "number" in name else "list") if num or name.startswith("list") else ""


def read_docx(raw: bytes) -> str:
    """Markdown of a Word file: headings, lists and tables.

    One pass over the document's events with a stack of open paragraphs and table cells, so
    that content controls are read through, a text box becomes a paragraph of its own behind
    the one that holds it, and what is deleted, moved away or an alternative is passed over."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        part = lambda n: z.read(n) if n in names else None
        styles, document = Styles(part("word/styles.xml"), part("word/numbering.xml")), z.read("word/document.xml")
    parts: list[tuple[str, str]] = []
    open_: list[dict] = []  # paragraphs, the innermost last
    tables: list[list[list[list[str]]]] = []
    late: list[list[tuple[str, str]]] = []  # what stood inside of an open paragraph
    hidden, count = 0, 0

    def put(kind: str, said: str) -> None:
        nonlocal count
        if kind == "ordered":
            count = count + 1 if parts and parts[-1][0] == "ordered" else 1
            said = f"{count}. {said}"
        parts.append((kind, said))

    def ended(p: dict) -> tuple[str, str] | None:
        said = "".join(p["text"]).strip()
        if not said:
            return None
        level = styles.level(p["style"], p["outline"])
        kind = "heading" if level else styles.list_kind(p["style"], p["num"], p["ilvl"])
        if kind == "heading":
            return kind, "#" * level + " " + said
        if kind == "ordered":
            return kind, said
        return ("list", f"- {said}") if kind else ("para", re.sub(r"^(\s*)([#>*+-]|\d+[.)])(?=\s)", r"\1\\\2", said))

    for event, tag, node in _events(document):
        start = event == "start"
        if tag in _UNSEEN:
            hidden += 1 if start else -1
        elif hidden:
            continue
        elif tag == "p":
            if start:
                open_.append({"text": [], "style": "", "outline": "", "num": None, "ilvl": ""})
                late.append([])
                continue
            done, after = ended(p := open_.pop()), late.pop()
            if tables and not open_:
                tables[-1][-1][-1] += [x for x in ("".join(p["text"]).strip(), *(t for _, t in after)) if x]
                continue
            whole = [*([done] if done else []), *after]
            if open_:
                late[-1] += whole
            else:
                for kind, said in whole:
                    put(kind, said)
        elif tag == "tbl":
            if start:
                tables.append([])
                continue
            rows = tables.pop()
            said = "\n".join("| " + " | ".join(" ".join(c).replace("\n", " ") for c in r) + " |" for r in rows if r)
            if tables:
                tables[-1][-1][-1].append(" ".join(" ".join(c) for r in rows for c in r).replace("\n", " "))
            elif open_:
                late[-1].append(("table", said))
            elif said:
                put("table", said)
        elif tag == "tr" and start and tables:
            tables[-1].append([])
        elif tag == "tc" and start and tables:
            tables[-1][-1].append([])
        elif open_ and start and tag in ("pStyle", "outlineLvl", "numId", "ilvl"):
            open_[-1][{"pStyle": "style", "outlineLvl": "outline", "numId": "num", "ilvl": "ilvl"}[tag]] = _value(node)
        elif open_ and not start and tag == "t":
            open_[-1]["text"].append(node.text or "")
        elif open_ and start and tag in _MARKS:
            open_[-1]["text"].append(_MARKS[tag])
        elif open_ and start and tag == "sym":
            code = int(_value(node, "char") or "20", 16)
            own = code - _PRIVATE if code >= _PRIVATE else code
            open_[-1]["text"].append(SYMBOLS.get(own, "") if code >= _PRIVATE or _value(node, "font") == "Symbol" else chr(code))
    out = ""
    for i, (kind, said) in enumerate(parts):
        same = i and kind == parts[i - 1][0] and kind in ("list", "ordered")
        out += ("" if not i else "\n" if same else "\n\n") + said
    return out + "\n"


_MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def natural_key(path: Column) -> Column:
    """A sort key with runs of digits in the order of their numbers."""
    parts = F.regexp_extract_all(F.lower(path), F.lit("\\d+|\\D+"), F.lit(0))
    return F.transform(parts, lambda p: F.when(p.rlike("^\\d+$"), F.lpad(p, 20, "0")).otherwise(p))


def newline_of(text: Column) -> Column:
    """The most frequent line end."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf, cr = F.regexp_count(text, F.lit("\n")) - crlf, F.regexp_count(text, F.lit("\r")) - crlf
    return F.when((crlf >= lf) & (crlf >= cr) & (crlf > 0), "\r\n").when(cr > lf, "\r").otherwise("\n")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(rel, name, content) of the files to read, side notes included; folders of tools are left out."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_extract("path", "^[a-z0-9]*:?/*" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/(.*)$", 1)
    files = files.select(rel.alias("rel"), "content").withColumn("parts", F.split("rel", "/"))
    hidden = F.exists("parts", lambda p: p.isin(list(SKIPPED)) | p.startswith("."))
    suffix = F.exists(F.array(*map(F.lit, SUFFIXES)), lambda s: F.lower(F.col("rel")).endswith(s))
    return files.where(~hidden & suffix).select("rel", "content")


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, unreadable, sidecars) of a folder.

    files: rel, file_order, text, derived, encoding, newline, note."""
    rows = listed(spark, root)
    side = F.lower(F.col("rel")).endswith(SIDECAR)
    schema = "rel string, raw string, derived boolean, encoding string, note string, error string"

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {c.split()[0]: [] for c in schema.split(", ")}
            for rel, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                derived = rel.lower().endswith(".docx")
                try:
                    row = (read_docx(raw), "docx", "") if derived else decode(raw)
                    row = (*row, None)
                except Exception as e:  # noqa: BLE001  one bad file must not end the read; it is reported
                    row = (None, None, None, f"{type(e).__name__}: {e}")
                for k, v in zip(out, (rel, row[0], derived, row[1], row[2], row[3]), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.bool_() if k == "derived" else pa.string()) for k in out]))

    got = rows.where(~side).select("rel", "content").mapInArrow(decoded, schema)
    text = F.replace(F.replace(F.col("raw"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    files = got.where("error is null").select("rel", text.alias("text"), "derived", "encoding", newline_of(F.col("raw")).alias("newline"), "note")
    return ordered(files), got.where("error is not null").select("rel", F.col("error").alias("why")), rows.where(side).select("rel")


def ordered(files: DataFrame) -> DataFrame:
    """file_order in natural order. Only names are ranked, and joined back."""
    from pyspark.sql import Window

    names = files.select("rel", F.row_number().over(Window.orderBy(natural_key(F.col("rel")), "rel")).alias("n"))
    return files.join(names.select("rel", (F.col("n") - 1).alias("file_order")), "rel")
