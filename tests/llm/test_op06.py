"""Base spans against the plain patterns; the bootstrap on planted contexts."""

import hashlib
import random
import re

from marginalia.llm import op06_pii as op
from pyspark.sql import functions as F


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def plain(text):
    text = text or ""
    out = []
    spans = lambda rx, ok, kind: out.extend((kind, m.start(), m.end()) for m in re.finditer(rx, text) if ok(m[0]))
    count = lambda t: re.sub("[^0-9]", "", t)
    spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True, "email")
    spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split(".")), "ip")
    spans(r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(count(t)) <= 19 and luhn(count(t)), "card")
    spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(count(t)) <= 15, "phone")
    return out


def texts():
    r = random.Random(8)
    hand = [
        "", None, "a@b.c_d@e.f x@y@z.com", "me.you+x%y-z@mail.example-host.org. Next", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 1.2.3",
        "4111 1111 1111 1111, 4111-1111-1111-1112 4381893557741609 00000000000000 1 2", "+1 (202) 555-0143. +49-30-901820 +1 2 +123456789012345678",
        "\x01a@b\x01c.de 🙂é +33 1 23 45 67 89🙂 4111\x011111", "a..b@c..d @x.y a@b a@-.- %@a.b", "1" * 4000, "a." * 9000 + "@" + "b." * 9000 + "c", "1 " * 9000, "1.1." * 5000, "a@b.c" * 3,
        "0" * 30 + ".1.1.1 1.1.1." + "0" * 40 + "9",
    ]
    rand = ["".join(r.choice(["a", "b-", ".", "@", "1", "22", " ", "-", "+", "4", "(", ")", "é", "_", "255.", "\n"]) for _ in range(r.randrange(60))) for _ in range(500)]
    cards = []
    for _ in range(60):
        d = "".join(r.choice("0123456789") for _ in range(r.choice([12, 13, 16, 18, 19])))
        d = next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c)) if r.random() < 0.8 else d
        cards.append("x" + "".join(c + (r.choice(["", " ", "-", "", ""]) if i < len(d) - 1 else "") for i, c in enumerate(d)) + "y.")
    return hand + rand + cards


def test_base_spans_equal_plain_patterns(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(rows)], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: r for r in op.find(docs).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        want = plain(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert ",".join(x for x in got[i].spans.split(",") if not x.startswith("id:")) == said, (i, t, said, got[i].spans)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in op.KINDS] == [sum(w[0] == k for w in want) for k in op.KINDS]


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"Please contact us at user{i}@mail.org for order {i}000 of {i} parts.") for i in range(30)]
    rows += [(100 + i, f"They said: contact us at @user_{i}99x now, about 77{i}123 units.") for i in range(4)]
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[1][1])], "doc_id long, text string")
    got = {r.doc_id: r for r in op.find(docs).collect()}
    assert op.find(docs).count() == len(rows) + 2
    for i in range(4):
        text = rows[30 + i][1]
        at = text.index("@user")
        assert got[100 + i].spans == f"id:{at}:{at + len(f'@user_{i}99x')}"
    assert got[3].n_email == 1 and got[3].n_discovered == 0
    clean = {r.doc_id: r.text for r in op.redact(docs).collect()}
    assert clean[101] == "They said: contact us at [ID] now, about 771123 units."
    assert clean[2] == "Please contact us at [EMAIL] for order 2000 of 2 parts."


def test_redaction_and_edges(spark):
    docs = spark.createDataFrame([(1, "é 10.0.0.1🙂 a@b.c", 9, "q"), (2, None, 0, None), (3, "", 0, "")], "doc_id long, text string, n_chars long, kind string")
    got = {r.doc_id: r for r in op.redact(docs).collect()}
    assert got[1].text == "é [IP]🙂 [EMAIL]" and got[1].n_chars == 15 and got[1].kind == "q"
    assert got[2].text is None and got[3].text == ""
    assert op.redact(docs).schema.names == docs.columns
    assert op.find(docs.limit(0)).count() == 0


def test_patterns_beside_numbers_at_the_start_and_over_two_hops(spark):
    rows = [f"row 7 contact user{i}@mail.org" for i in range(200)] + [f"row 7 contact tag_{i}99x" for i in range(20)]
    rows += [f"Passport tag_{i}99x" for i in range(20)] + ["Passport AB123456"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in op.find(docs).where("n_discovered > 0").collect()}
    assert got == {i: ("id:14:" if i < 220 else "id:9:") + str(len(rows[i])) for i in range(200, 241)}
    assert {r.text for r in op.redact(docs).where("doc_id >= 220").collect()} == {"Passport [ID]"}


def plain_instances(text):
    """(start, end, token, patterns, seed, bare, sure) of each token, read one after another."""
    text = text or ""
    base = plain(text)
    tokens = [m for m in re.finditer(r"\S+", text)]
    special = [bool(re.search(r"[0-9@]|[A-Z]{16}", m[0])) for m in tokens]
    word = lambda w: "".join(c for c in w.lower() if c.isalnum() or c in ":=_")
    out = []
    for i, m in enumerate(tokens):
        if not special[i]:
            continue
        before = [w for j in range(i) for w in ["0" if special[j] else word(tokens[j][0])] if w][-2:]
        # The word after may lie behind tokens without letters or digits, not behind another such token.
        after = next((w for j in range(i + 1, len(tokens)) for w in ["0" if special[j] else word(tokens[j][0])] if w), "")
        hit = m[0]
        lead = next((k for k, c in enumerate(hit) if c.isalnum() or c in "+@"), len(hit))
        value, name = hit[lead:], ""
        if (x := re.match(r"((?:[^\W\d]|[_-]){2,40}[=:])[\W_]*(?=[^\W_].)", value)) and re.match(r"[A-Za-zÀ-ÿ_-]", value):
            name, value = x[1].lower(), value[x.end() :]
        core = value
        while core and not core[-1].isalnum():
            core = core[:-1]
        start = m.end() - len(value)
        end = start + len(core)
        patterns = set()
        letters = lambda p: any(c.isalpha() for c in p)
        if letters(" ".join(before)):
            patterns.add("before " + " ".join(before))
        if len(before) > 1 and letters(before[-1]):
            patterns.add("word " + before[-1])
        if letters(after):
            patterns.add("after " + after)
        if name:
            patterns.add("name " + name)
        if re.fullmatch(r"[0-9A-Za-z_-]{12,200}", core) and re.search("[0-9]", core) and re.search("[A-Za-z]", core):
            kind = "hex" if re.fullmatch("[0-9a-f]+", core) else "small" if re.fullmatch("[0-9a-z]+", core) else "large" if re.fullmatch("[0-9A-Z]+", core) else "mixed"
            patterns.add(f"shape {kind} {len(core)}")
        covered = any(a < end and start < b for _, a, b in base)
        sure = covered or bool(re.fullmatch("|".join(op.FORMATS), core))
        seed = sure or bool(re.fullmatch(op.FORTY, core))
        if core and (patterns or seed):
            out.append((start, end, core.lower(), patterns, seed, not covered, sure))
    return out


def plain_discovered(rows):
    """The spans of each row that the same rounds over a dictionary graph accept."""
    found = [plain_instances(t) for t in rows]
    edges, seeds = {}, {}
    for own in found:
        for _, _, token, patterns, seed, _, _ in own:
            seeds[token] = seeds.get(token, False) or (seed and bool(patterns))
            for p in patterns:
                edges.setdefault(p, set()).add(token)
    belief, trust = {t: float(s) for t, s in seeds.items()}, {}
    for _ in range(500):
        trust = {p: sum(belief[t] for t in ts) / (len(ts) + op.DAMP) for p, ts in edges.items()}
        best = dict.fromkeys(belief, 0.0)
        for p, ts in edges.items():
            for t in ts:
                best[t] = max(best[t], op.PASSED * trust[p] * (0.5 if p.startswith(("word ", "after ")) else 1))
        belief = {t: 1.0 if seeds[t] else best[t] for t in belief}
    # No confidence may lie so near to the bound that rounding decides.
    assert all(abs(x - op.ACCEPT) > 1e-4 for x in [*belief.values(), *trust.values()])
    out = []
    for own in found:
        keep = set()
        for start, end, token, patterns, _, bare, sure in own:
            fresh = re.search("[0-9]", token) and any(c.isalpha() or c in "@_" for c in token) and belief.get(token, 0) >= op.ACCEPT and any(trust[p] >= op.ACCEPT and not p.startswith("shape ") for p in patterns)
            if bare and len(token) >= op.SHORTEST and (sure or fresh):
                keep.add((start, end))
        out.append(sorted(keep))
    return out


def test_bootstrap_equals_a_plain_graph(spark, monkeypatch):
    monkeypatch.setattr(op, "SETTLED", 1e-6)
    r = random.Random(4)
    lead = ["contact us at", "ask for", "ref", "ID:", "token =", "the year", "order", "x"]
    value = [lambda: f"u{r.randrange(40)}@mail.org", lambda: f"tag_{r.randrange(30)}zz", lambda: "".join(r.choice("0123456789abcdef") for _ in range(20)), lambda: str(r.randrange(1900, 2100)), lambda: f"password={r.randrange(10**9)}b", lambda: "AKIA" + "".join(r.choice("ABC234") for _ in range(16)), lambda: f"+1 202 555 01{r.randrange(10, 99)}", lambda: f"lot-{r.randrange(50)}c", lambda: '"k9' + "z" * r.randrange(9, 12) + '"']
    tail = ["now", "or later", ".", "", "-- then", "and"]
    rows = [" ".join(x for _ in range(r.randrange(4)) for x in (r.choice(lead), r.choice(value)(), r.choice(tail)) if x) for _ in range(300)]
    rows += ["contact us at tag_1zz", None, "", "ref " * 2000 + "77abc77 now"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    want = plain_discovered(rows)
    got = {x.doc_id: x for x in op.find(docs).collect()}
    for i, t in enumerate(rows):
        mine = [tuple(map(int, x.split(":")[1:])) for x in got[i].spans.split(",") if x.startswith("id:")]
        assert mine == want[i], (i, t)
        assert got[i].n_discovered == len(mine) and got[i].n_spans == len(plain(t)) + len(mine)
    # Some of them no seed covers: the graph has found them.
    hidden = [x for t, own in zip(rows, want, strict=True) for x in plain_instances(t) if not x[4] and x[:2] in own]
    assert len(hidden) > 20


def test_unseen_keys_are_found_on_the_tables(spark, monkeypatch):
    """The context of the tables' keys is learnt: keys in capitals, which no format has, are
    found by it; without confidence that passes on, they and the keys that may be checksums aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("text").rlike("(?i)[0-9a-f]{40}"))
    count = lambda rx: sum(len(re.findall(rx, r.text)) for r in docs.select("text").collect())
    found = [r.text[a:b] for r in op.find(docs).join(docs.select("doc_id", "text"), "doc_id").collect() for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "id" for a, b in [(int(a), int(b))]]
    capitals = [t for t in found if re.fullmatch("[0-9A-F]{40}", t)]
    assert len(capitals) == count('TOKEN = "[0-9A-F]{40}"') > 0
    assert len(found) - len(capitals) == count('token = "[0-9a-f]{40}"') > 100
    monkeypatch.setattr(op, "PASSED", 0.0)
    assert not any(re.fullmatch("[0-9A-F]{40}", r.text[int(a) : int(b)]) for r in op.find(docs).join(docs.select("doc_id", "text"), "doc_id").collect() for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "id")


def test_words_far_from_a_token(spark, monkeypatch):
    """Neighbours are found however long the blanks or the words between are."""
    monkeypatch.setattr(op, "SETTLED", 1e-6)
    rows = [f"contact {'us' * 300} at user{i}@mail.org" for i in range(20)] + [f"contact {'us' * 300} at{' ' * 900}tag_{i}99x" for i in range(3)] + [f"at{' - ' * 300}tag_199x"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = plain_discovered(rows)
    got = {x.doc_id: x.spans for x in op.find(docs).collect()}
    for i, spans in enumerate(want):
        assert [x for x in got[i].split(",") if x.startswith("id:")] == [f"id:{a}:{b}" for a, b in spans]
    assert sum(map(bool, want)) == 3


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.cd x", "p", [3], 5)], "doc_id long, text string, _row string, _spans array<int>, spans_of_row int")
    got = op.redact(docs)
    assert got.columns == docs.columns and tuple(got.collect()[0]) == (1, "[EMAIL] x", "p", [3], 5)
