"""Text expressions: words, sentences, normal forms, syllables. All are Column functions
that stay in the JVM and work inside one row, so no text is shuffled for them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L

LETTER = "A-Za-zÀ-ɏ"
WORD = f"[{LETTER}][{LETTER}'’\\-]*"
#: A normalised word up to its last letter.
KEY = f"[{LETTER}]++(?:['\\-]++[{LETTER}]++)*+"
#: Every character belongs to exactly one match, so offsets are running lengths.
LOSSLESS = f"[{LETTER}][{LETTER}'’\\-]*|[.!?…]+[\"'”’)\\]]*|\\n[ \\t]*\\n|\\s+|[^\\s{LETTER}.!?…]+"


def _plain_letters() -> tuple[str, str]:
    """Letters from À to ɏ that are one base letter with marks, and those base letters."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c and base[0].isalpha():
            pairs.append((c, base[0].lower()))
        elif len(c.lower()) == 1 and c.lower() != c:
            pairs.append((c, c.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _plain_letters()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD_FROM, FOLD_TO = "’" + _UPPER + MARKED, "'" + _LOWER + PLAIN


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once for each row. A filter or another column that
    uses one of them doesn't repeat its expression, as nothing moves through a generator."""
    made = F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return rows.select(*[c for c in rows.columns if c not in columns], made)


def normalise(text: Column) -> Column:
    """Straight apostrophes, no accents, lower case; the length stays."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LOSSLESS), F.lit(0))


def bare(word: Column) -> Column:
    """Without apostrophes and hyphens at the ends."""
    return F.regexp_replace(word, "^['-]+|['-]+$", "")


def keys(text: Column) -> Column:
    """Normalised words of a text, in order, without apostrophes and hyphens at the end: the
    pattern leaves them out, so no word is read a second time."""
    return F.regexp_extract_all(F.coalesce(normalise(text), F.lit("")), F.lit(KEY), F.lit(0))


def _boundary() -> str:
    """A terminator that ends a sentence. Its first character is read before anything is
    looked at around it, so that all other characters of a text cost one comparison each."""
    run, close = "[.!?…]", "[\"'”’)\\]]"
    rest = f"{run}*+{close}*+"
    own = "[\\p{L}\\p{N}'\\-]"
    after = f"(?=\\s*\\z|[ \\t]*{_END}|[ \\t]*\\n[ \\t]*\\n|(?=\\s)[ \\t]*\\n?[ \\t]*[\\p{{Lu}}\\p{{Nd}}\"'“‘(\\[#*\\->—])"
    one_of = lambda ws: f"(?<!{own})(?i:{'|'.join(sorted(ws, key=lambda w: (-len(w), w)))})"
    dot = (
        f"\\.(?<!{run}\\.)"
        f"(?<!\\.{own}\\.)"
        f"(?<!(?:^|[ \\t\\n(\\[\"'“‘])\\p{{L}}\\.)"
        f"(?<!{one_of(L.NEVER_END)}\\.)"
        f"(?!(?<={one_of(L.LABELS)}\\.){rest}[ \\t]*(?:\\p{{Nd}}|\\p{{Ll}}|[IVXLC]+(?![\\p{{L}}\\p{{N}}])))"
    )
    return f"(?:{dot}|[!?…](?<!{run}[!?…])){rest}{after}"


END = _END = "\x1e"
_SPACE = " \t\n\x0b\f\r"
BOUNDARY = _boundary()


def sentences(text: Column) -> Column:
    """Trimmed sentences: ended by a terminator that isn't part of an abbreviation, an
    initial or a number, or by a blank line."""
    cut = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(_END), F.lit(" ")), "\\n[ \\t]*\\n", _END + "\n")
    # Blank lines are hidden from the terminators' look-ahead by the mark, so it counts as an end too.
    parts = F.transform(F.split(F.regexp_replace(cut, BOUNDARY, f"$0{_END}"), _END, -1), lambda s: F.trim(s, F.lit(_SPACE)))
    return F.filter(parts, lambda s: s != "")


def sentence_spans(text: Column) -> Column:
    """array<struct<start, end, said>>: sentences with their places in the text, in code points."""
    marked = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(_END), F.lit(" ")), "\\n[ \\t]*\\n", _END + "$0")
    pieces = F.split(F.regexp_replace(marked, BOUNDARY, f"$0{_END}"), _END, -1)

    def placed(parts: Column) -> Column:
        return let(running(F.transform(parts, F.char_length)), lambda ends: F.filter(F.zip_with(parts, ends, one), lambda x: x["said"] != ""))

    def one(part: Column, end: Column) -> Column:
        left = F.ltrim(part, F.lit(_SPACE))
        said = F.rtrim(left, F.lit(_SPACE))
        start = end - F.char_length(left)
        return F.struct(start.alias("start"), (start + F.char_length(said)).alias("end"), said.alias("said"))

    return let(pieces, placed)


#: Stands for a match while a text is cut at it.
MARK = "\x1f"


def between(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches of a pattern, none of which is empty.

    A split compiles its pattern for every text, a replacement once for all of them."""
    marked = F.split(F.regexp_replace(text, pattern, MARK), MARK, -1)
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern, -1)).otherwise(marked)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<at, hit>>: matches of a pattern with their places in the text, in code points."""

    def placed(hits: Column) -> Column:
        ends = running(F.zip_with(F.slice(between(text, pattern), 1, F.size(hits)), hits, lambda p, h: F.char_length(p) + F.char_length(h)))
        each = let(ends, lambda e: F.zip_with(hits, e, lambda h, end: F.struct((end - F.char_length(h)).alias("at"), h.alias("hit"))))
        return F.when(F.size(hits) == 0, F.array().cast("array<struct<at:int,hit:string>>")).otherwise(each)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


#: Pieces of a text whose places are summed up together; a sum over parts keeps long texts linear.
PART = 128


def running(sizes: Column) -> Column:
    """Running sums of an array of lengths."""

    def run(a: Column, start: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(a, F.struct(start.alias("at"), none.alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"] + n).alias("out")), lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        totals = run(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, b: a + b)), F.lit(0))
        return let(totals, lambda t: F.flatten(F.transform(parts, lambda p, k: run(p, F.when(k > 0, F.get(t, k - 1)).otherwise(0)))))

    parts = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / PART).cast("int")), lambda k: F.slice(a, k * PART + 1, PART))
    return let(sizes, lambda a: F.when(F.size(a) > 0, let(parts(a), joined)).otherwise(F.array().cast("array<int>")))


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence that has any."""
    return F.filter(F.transform(sentences(text), lambda s: F.size(words(s))), lambda n: n > 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def syllables(word: Column) -> Column:
    """Vowel groups, with rules for silent endings; at least 1, 0 of no letters."""

    def counted(w: Column) -> Column:
        n = F.regexp_count(w, F.lit("[aeiouy]+"))
        silent = w.endswith("e") & ~w.endswith("ee") & ~w.endswith("ye")
        n = n - F.when(silent, 1).otherwise(0)
        n = n + F.when(w.endswith("le") & w.rlike("[^aeiouy]le$"), 1).otherwise(0)
        n = n - F.when(w.endswith("ed") & w.rlike("[^td]ed$"), 1).otherwise(0)
        return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), n))

    return let(F.regexp_replace(normalise(word), "[^a-z]", ""), counted)


def term_key(term: Column) -> Column:
    """Letters and digits of the normalised term, singular."""
    k = F.regexp_replace(normalise(term), "[^a-z0-9]", "")
    long = F.length(k) > 4
    cut = lambda n: F.substring(k, F.lit(1), F.length(k) - n)
    return (
        F.when(long & k.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(long & k.endswith("ses"), cut(2))
        .when(long & k.endswith("es"), cut(2))
        .when(long & k.endswith("s"), cut(1))
        .otherwise(k)
    )


def is_participle(word: Column) -> Column:
    return word.isin(L.IRREGULAR) | ((F.length(word) > 4) & word.endswith("ed") & ~word.isin(L.NOT_PARTICIPLE))


def is_adverb(word: Column) -> Column:
    return word.endswith("ly") & word.rlike("^[a-z]{2,}ly$") & ~word.isin(L.LY_KEEP)


def is_passive(ws: Column) -> Column:
    """A form of be or get before a participle, with one adverb between at most."""
    at = lambda i: F.coalesce(F.get(ws, i), F.lit(""))
    hit = lambda i: at(i).isin(L.BE) & (is_participle(at(i + 1)) | (at(i + 1).rlike("^[a-z]{2,}ly$") & is_participle(at(i + 2))))
    return F.when(F.size(ws) > 1, F.exists(F.sequence(F.lit(0), F.size(ws) - 2), hit)).otherwise(False)


def token_estimate(text: Column) -> Column:
    """Tokens of a text for a budget; 0 of the empty one."""
    n = F.greatest(F.char_length(text) / F.lit(3.6), F.size(words(text)) / F.lit(0.75))
    return F.when(F.char_length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(F.floor(n) + 1).cast("int")
