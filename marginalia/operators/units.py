"""Written quantities: units, stated precision, and when two of them disagree."""

from __future__ import annotations

import bisect
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import lexicons as L
from ..functions.scalar import let, matches, once, words


def unit_table(spark: SparkSession) -> DataFrame:
    """unit as matched, whether case counts, dimension, factor; under 200 rows."""
    rows = [(u, True, d, f) for u, d, f in L.CASED] + [(u, False, d, f) for u, d, f in L.UNITS]
    return spark.createDataFrame(rows, "unit string, cased boolean, dimension string, factor double")


def _map(pairs: dict) -> Column:
    """A literal map; one call, however many entries."""
    said = lambda x: repr(float(x)) + "D" if isinstance(x, float) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(f'{said(k)}, {said(v)}' for k, v in pairs.items())})")


def _lookup(unit: Column, place: int) -> Column:
    cased, other = {r[0]: r[place] for r in L.CASED}, {r[0].lower(): r[place] for r in L.UNITS}
    return F.coalesce(F.try_element_at(_map(cased), unit), F.try_element_at(_map(other), F.lower(unit)))


def dimension(unit: Column) -> Column:
    """The dimension a unit as written stands for; null if none."""
    return _lookup(unit, 1)


def factor(unit: Column) -> Column:
    return _lookup(unit, 2)


def number(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(text), F.lit("−"), F.lit("-")), ",", "")


def bounds(text: Column) -> tuple[Column, Column]:
    """Low and high end as written: "10–20" and "10 to 20" are ranges."""
    rx = "^\\s*([-−]?\\d[\\d,]*(?:\\.\\d+)?)\\s*(?:–|—|-|to)\\s*([-−]?\\d[\\d,]*(?:\\.\\d+)?)\\s*$"
    is_range = text.rlike(rx)
    end = lambda k: number(F.when(is_range, F.regexp_extract(text, rx, k)).otherwise(text))
    return end(1), end(2)


def half_step(num: Column) -> Column:
    """Half a unit in the last place that the number was written to."""
    places = F.char_length(F.regexp_extract(num, "\\.(\\d+)$", 1))
    return F.pow(F.lit(10.0), -places) / 2


def scale(unit: Column) -> Column:
    """What quantities must share to be compared: the dimension, for temperatures with the
    letter of their scale; null of unknown units."""
    letter = F.upper(F.substring(F.regexp_replace(unit, "^[°\\s]+", ""), 1, 1))
    return let(dimension(unit), lambda d: F.when(d == "temperature", F.concat(F.lit("temperature "), letter)).otherwise(d))


def reading(text: Column, unit: Column) -> Column:
    """struct<scale, by, low, high, from, to>: a quantity read once, for any number of
    comparisons: what its unit measures and its factor, the ends as written, and the ends of
    what it asserts in base units."""

    def ends(r: Column) -> Column:
        decimal, double = (lambda c: c.try_cast("decimal(38,12)")), (lambda c: c.try_cast("double"))
        x, y = double(r["a"]), double(r["b"])
        return F.struct(
            r["scale"].alias("scale"), r["by"].alias("by"), F.least(decimal(r["a"]), decimal(r["b"])).alias("low"), F.greatest(decimal(r["a"]), decimal(r["b"])).alias("high"),
            ((F.least(x, y) - half_step(r["a"])) * r["by"]).alias("from"), ((F.greatest(x, y) + half_step(r["b"])) * r["by"]).alias("to"),
        )

    a, b = bounds(text)
    known = F.struct(scale(unit).alias("scale"), F.coalesce(factor(unit), F.lit(1.0)).alias("by"), a.alias("a"), b.alias("b"))
    return let(let(known, lambda r: F.struct(r["scale"].alias("scale"), F.when(r["scale"].startswith("temperature"), 1.0).otherwise(r["by"]).alias("by"), r["a"].alias("a"), r["b"].alias("b"))), ends)


def disagree(x: Column, y: Column) -> Column:
    """Whether two readings can't both hold: in the same unit as written, in different units
    if their intervals are apart. Unknown units and different scales never disagree."""
    written = (x["high"] < y["low"]) | (y["high"] < x["low"])
    apart = (x["to"] < y["from"]) | (y["to"] < x["from"])
    return F.coalesce((x["scale"] == y["scale"]) & F.when(x["by"] == y["by"], written).otherwise(apart), F.lit(False))


def conflict(a_text: Column, a_unit: Column, b_text: Column, b_unit: Column) -> Column:
    """Two quantities that can't both hold."""
    return let(F.struct(reading(a_text, a_unit).alias("x"), reading(b_text, b_unit).alias("y")), lambda p: disagree(p["x"], p["y"]))


def drawn_in(r: Column) -> tuple[Column, Column]:
    """The ends of a reading as written, in base units, drawn in by what arithmetic may add:
    two readings that disagree lie apart by them."""
    low, high = (r[c].cast("double") * r["by"] for c in ("low", "high"))
    slack = (F.abs(low) + F.abs(high)) * 1e-9
    return low + slack, high - slack


#: Rows of a key that are paired up as one array.
FEW = 64


def apart(rows: DataFrame, key: list[str], columns: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """(key, a_*, b_*): the pairs of a key's rows whose intervals lie apart; rows without an
    interval are pairs with all others of their key.

    The rows are dealt by key. Keys of up to FEW rows are paired up as arrays in Spark's own
    expressions. The rows of larger ones are sorted by their lower ends; one sweep keeps the
    rows passed in the order of their upper ends, so each row meets only those that end before
    it begins. The work is the sort and the pairs that come out."""
    both = rows.schema
    fields = [f"`{c}` {both[c].dataType.simpleString()}" for c in key] + [f"`{p}_{c}` {both[c].dataType.simpleString()}" for p in "ab" for c in columns]
    struct = rows.sparkSession.range(0).select(F.from_json(F.lit("{}"), ", ".join(fields)).alias("x")).schema["x"].dataType
    arrow, k = to_arrow_schema(struct), len(key)

    def run(batches):
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        for own, group in groupby(each, lambda r: r[:k]):
            ends: list = []  # upper ends of the rows passed, in order, and those rows
            held: list = []
            for r in group:
                lo, hi, row = r[k], r[k + 1], r[k + 2 :]
                met = held if lo is None else held[: bisect.bisect_left(ends, lo)]
                for other in met:
                    out.append((*own, *other, *row))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in out], schema=arrow)
                        out = []
                at = len(ends) if hi is None else bisect.bisect_right(ends, hi)
                if hi is not None or lo is None:
                    ends.insert(at, hi if hi is not None else float("-inf"))
                    held.insert(at, row)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in out], schema=arrow)

    d = rows.select(*key, F.col(low).alias("_lo"), F.col(high).alias("_hi"), *columns)
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    many = d.where(F.col("_n") > FEW).drop("_n").sortWithinPartitions(*key, F.col("_lo").asc_nulls_last(), *columns).mapInArrow(run, struct)
    # Rows without an interval come last, as the sweep has them.
    row = F.struct(F.col("_lo").isNull().alias("_no"), "_lo", *columns, "_hi")
    few = d.where(F.col("_n").between(2, FEW)).groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("_s"))
    # Each row of the array beside those before it, as rows: compiled code, where functions over arrays are interpreted.
    each = few.select(*key, "_s", F.posexplode("_s").alias("_i", "_b"))
    each = each.select(*key, "_b", F.explode(F.slice("_s", F.lit(1), F.col("_i"))).alias("_a"))
    before = (F.col("_a._no") | F.col("_a._hi").isNotNull()) & (F.col("_b._no") | (F.col("_a._hi") < F.col("_b._lo")))
    pairs = each.where(F.coalesce(before, F.lit(False)))
    return pairs.select(*key, *[F.col(f"_{p}.`{c}`").alias(f"{p}_{c}") for p in "ab" for c in columns]).unionByName(many)


def conflicts(values: DataFrame, key: list[str], text: str = "value", unit: str = "unit") -> DataFrame:
    """Conflicting pairs of distinct values of a key. Equal values are counted together and read
    once, and a sweep lets only those meet that may lie apart; the pair is named by the lesser text first."""
    d = values.groupBy(*key, F.col(text).alias("t"), F.col(unit).alias("u")).agg(F.count("*").alias("uses"))
    d = once(d, r=reading(F.col("t"), F.col("u"))).where("r.scale is not null and r.low is not null and r.high is not null")
    low, high = drawn_in(F.col("r"))
    fields = ("by", "low", "high", "from", "to")
    d = d.select(*key, "t", "u", "uses", F.col("r.scale").alias("_scale"), low.alias("_low"), high.alias("_high"), *[F.col(f"r.{c}").alias(f"r_{c}") for c in fields])
    pairs = apart(d, [*key, "_scale"], ["t", "u", "uses", *[f"r_{c}" for c in fields]], "_low", "_high")
    x, y = ({"scale": F.col("_scale")} | {c: F.col(f"{p}_r_{c}") for c in fields} for p in "ab")
    pairs = pairs.where(disagree(x, y))
    first = F.struct("a_t", "a_u") < F.struct(F.col("b_t"), F.col("b_u"))
    names = {"t": "", "u": "_unit", "uses": "_uses"}
    return pairs.select(*key, *[F.when(first, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(f"{p}{x}") for p, q in ("ab", "ba") for c, x in names.items()])


def _alternation() -> str:
    quote = lambda u: "".join("\\" + c if c in ".·-°" else c for c in u)
    names = sorted([(u, True) for u, _, _ in L.CASED] + [(u, False) for u, _, _ in L.UNITS], key=lambda x: -len(x[0]))
    return "|".join((quote(u) if cased else f"(?i:{quote(u)})") + ("(?![ \\t]+[A-Za-z0-9])" if u == "in" else "") for u, cased in names)


NUMBER = "[-−]?\\d[\\d,]*(?:\\.\\d+)?"
_TO = "(?:–|—|-|to)"
_UNIT = f"({_alternation()})(?![A-Za-z0-9])"
#: A number or a range with a unit, the low end perhaps with one of its own; the end of a
#: chain ("1 to 6 to 25 Nm") is a number alone.
_START = "(?<![\\p{L}\\p{N}_.])(?<!\\d\\s)"
_NO_CHAIN = f"(?<!\\d\\s{{0,2}}{_TO}\\s{{0,2}})"
QUANTITY = f"{_START}({_NO_CHAIN}{NUMBER}\\s*{_TO}\\s*{NUMBER}|{NUMBER})\\s*{_UNIT}"
RANGE = f"{_START}{_NO_CHAIN}({NUMBER})\\s*{_UNIT}\\s*{_TO}\\s*({NUMBER})\\s*{_UNIT}"
EITHER = f"(?:{RANGE}|{QUANTITY})"
#: Words that qualify the quantity word before them; verbs that state a value
#: of what follows them; words at which a noun phrase ends; the quantity of a dimension.
QUALIFIERS = ("range", "limit", "setting", "rating", "tolerance", "margin")
IMPERATIVES = (
    "adjust", "apply", "bleed", "calibrate", "charge", "cool", "cut", "drill", "fill", "gap", "heat", "increase", "inflate", "limit", "load", "lower", "preheat",
    "pressurise", "pressurize", "pump", "raise", "rate", "reduce", "regulate", "set", "shim", "space", "tighten", "torque", "trim",
)
PHRASE_ENDS = (
    "a", "about", "adjust", "all", "an", "and", "any", "apply", "approximately", "are", "at", "be", "been", "between", "both", "by", "can", "check", "each", "every", "fit", "for",
    "from", "if", "in", "is", "its", "max", "maximum", "may", "min", "minimum", "must", "no", "nominal", "not", "of", "on", "or", "our", "rated", "set", "shall", "should", "than",
    "that", "the", "their", "then", "these", "this", "those", "tighten", "to", "torque", "use", "was", "were", "when", "will", "with", "your",
)
DETERMINERS = ("a", "all", "an", "both", "each", "every", "the")
NAMED_BY_DIMENSION = {"time": "duration", "data": "size"} | {d: d for d in ("torque", "pressure", "voltage", "current", "power", "frequency", "temperature", "length", "mass", "angle", "resistance")}


def measures(text: Column) -> Column:
    """array<struct<at, end, value, unit, dimension>> of a text's numbers with units.

    "40 Nm to 50 Nm" is one range in the second unit; where the two units measure different
    things, it is two numbers."""

    def one(m: Column) -> Column:
        h = m["hit"]
        part = lambda rx, k: F.regexp_extract(h, f"^{rx}$", k)
        low_unit, high_unit = part(RANGE, 2), part(RANGE, 4)
        same = dimension(low_unit) == dimension(high_unit)
        low = number(part(RANGE, 1)).try_cast("decimal(20,9)").cast("double") * factor(low_unit) / factor(high_unit)
        shown = F.when(low_unit == high_unit, part(RANGE, 1)).otherwise(F.regexp_replace(F.round(low, 9).cast("decimal(24,9)").cast("string"), "\\.?0+$", ""))
        end = m["at"] + F.char_length(h)
        row = lambda at, to, value, unit: F.struct(at.alias("at"), to.alias("end"), value.alias("value"), unit.alias("unit"), dimension(unit).alias("dimension"))
        split = m["at"] + F.char_length(F.regexp_extract(h, f"^({NUMBER}\\s*{_UNIT})", 1))
        second = end - F.char_length(F.regexp_extract(h, f"({NUMBER}\\s*{_UNIT})$", 1))
        whole = F.array(row(m["at"], end, F.concat(shown, F.lit("–"), part(RANGE, 3)), high_unit))
        two = F.array(row(m["at"], split, part(RANGE, 1), low_unit), row(second, end, part(RANGE, 3), high_unit))
        plain = F.array(row(m["at"], end, part(QUANTITY, 1), part(QUANTITY, 2)))
        return F.when(low_unit == "", plain).when(same & (low_unit.eqNullSafe(high_unit) | (dimension(low_unit) != "temperature")), whole).otherwise(two)

    return F.flatten(F.transform(matches(text, EITHER), one))


def _phrase(words: Column) -> Column:
    """Up to three words of a noun phrase from the start of the words, past one determiner."""
    step = lambda acc, w: F.struct(
        F.when(acc["open"] & ~w.isin(*PHRASE_ENDS) & w.rlike("^[\\p{L}-]+$") & (F.size(acc["out"]) < 3), F.array_append(acc["out"], w)).otherwise(acc["out"]).alias("out"),
        (acc["open"] & ~w.isin(*PHRASE_ENDS) & w.rlike("^[\\p{L}-]+$")).alias("open"),
    )
    past = F.when(F.coalesce(F.get(words, F.lit(0)).isin(*DETERMINERS), F.lit(False)), F.slice(words, 2, 3)).otherwise(F.slice(words, 1, 3))
    return F.aggregate(past, F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("open")), step, lambda acc: acc["out"])


def _phrase_before(words: Column) -> Column:
    """Up to three words of a noun phrase that ends with the words."""
    stop = lambda w: w.isin(*PHRASE_ENDS) | w.isin(*L.QUANTITY_WORDS) | ~w.rlike("^\\p{L}+$")
    step = lambda acc, w: F.struct(F.when(acc["open"] & ~stop(w), F.array_prepend(acc["out"], w)).otherwise(acc["out"]).alias("out"), (acc["open"] & ~stop(w)).alias("open"))
    back = F.reverse(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3))
    return F.aggregate(back, F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("open")), step, lambda acc: acc["out"])


def quantities(sentence: Column) -> Column:
    """array<struct<value, unit, dimension, quantity, object>> of a sentence's numbers with units.

    The quantity is the nearest quantity word among the six words before the number, with a
    qualifier that follows it ("torque range"), else the first among the five words after it,
    up to a comma, colon, semicolon or "then", else what an opening verb measures. The object
    is read from the clause around it, in this order: "torque for the X is", "the X torque
    is", "Tighten the X to", "Apply 40 Nm to the X", "applies to the X", "on the X"."""
    lower = lambda t: F.transform(words(t), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))
    empty = F.array().cast("array<string>")
    named = lambda w: w.isin(*L.QUANTITY_WORDS)

    def tokens(q: Column) -> Column:
        rest = F.regexp_replace(F.substring(sentence, q["end"] + 1, F.char_length(sentence)), "(?is)(?:[,;:.!?]|\\bthen\\b).*", "")
        return F.struct(lower(F.left(sentence, q["at"])).alias("b"), lower(rest).alias("a"), rest.alias("rest"))

    def word(q: Column, t: Column) -> Column:
        b, n = t["b"], F.size(t["b"])
        at = F.coalesce(F.array_max(F.filter(F.sequence(F.greatest(n - 6, F.lit(0)), n), lambda k: (k < n) & named(F.coalesce(F.get(b, k), F.lit(""))))), F.lit(-1))
        return let(F.struct(t["b"].alias("b"), t["a"].alias("a"), t["rest"].alias("rest"), at.alias("k")), lambda x: qualified(q, x))

    def qualified(q: Column, x: Column) -> Column:
        here, prior = F.get(x["b"], F.greatest(x["k"], F.lit(0))), F.get(x["b"], F.greatest(x["k"] - 1, F.lit(0)))
        pair = (x["k"] > 0) & here.isin(*QUALIFIERS) & named(prior)
        later = F.coalesce(F.get(F.filter(F.slice(x["a"], 1, 5), named), F.lit(0)), F.lit(""))
        quantity = F.when(pair, F.concat_ws(" ", prior, here)).when(x["k"] >= 0, here).otherwise(later)
        tail = F.when(x["k"] >= 0, F.slice(x["b"], x["k"] + 2, F.size(x["b"]) + 1)).otherwise(empty)
        ahead = F.when(x["k"] >= 0, F.slice(x["b"], F.lit(1), F.greatest(F.when(pair, x["k"] - 1).otherwise(x["k"]), F.lit(0)))).otherwise(empty)
        linked = F.coalesce(F.get(tail, F.lit(0)).isin("for", "of", "on"), F.lit(False))
        first = F.when(linked, _phrase(F.slice(tail, 2, 4))).otherwise(empty)
        return let(F.struct(x["b"].alias("b"), x["a"].alias("a"), x["rest"].alias("rest"), quantity.alias("w"), F.when(F.size(first) > 0, first).otherwise(_phrase_before(ahead)).alias("o")), lambda y: verbal(q, y))

    def verbal(q: Column, y: Column) -> Column:
        b, a = y["b"], y["a"]
        verb = F.coalesce(F.get(b, F.lit(0)).isin(*IMPERATIVES), F.lit(False)) & (F.size(y["o"]) == 0)
        told = F.when(F.exists(F.slice(b, 2, F.size(b) + 1), lambda w: w == "to"), _phrase(F.slice(b, 2, 4))).otherwise(empty)
        ends = F.coalesce(named(F.element_at(F.when(F.size(told) > 0, told), -1)), F.lit(False))
        given = F.when((F.size(b) == 1) & F.coalesce(F.get(a, F.lit(0)).isin("to", "on", "for"), F.lit(False)), _phrase(F.slice(a, 2, 4))).otherwise(empty)
        obj = F.when(verb & (F.size(told) > 0), F.when(ends, F.slice(told, F.lit(1), F.greatest(F.size(told) - 1, F.lit(0)))).otherwise(told)).when(verb, given).otherwise(y["o"])
        by_verb = F.when(ends, F.element_at(F.when(F.size(told) > 0, told), -1)).otherwise(F.coalesce(F.try_element_at(_map(NAMED_BY_DIMENSION), q["dimension"]), F.lit("")))
        quantity = F.when((y["w"] == "") & verb, by_verb).otherwise(y["w"])
        return let(F.struct(a.alias("a"), y["rest"].alias("rest"), quantity.alias("w"), obj.alias("o")), lambda z: after(q, z))

    def after(q: Column, z: Column) -> Column:
        a = z["a"]
        first = lambda k, *ws: F.coalesce(F.get(a, F.lit(k)).isin(*ws), F.lit(False))
        applies = (first(0, "applies") & first(1, "to")) | (first(0, "is") & first(1, "applied"))
        placed = first(0, "on", "to", "for") & ~z["rest"].rlike("(?i)^\\s*(?:on|to|for)\\s+[-−]?\\d")
        late = F.when(applies, _phrase(F.when(first(2, "to"), F.slice(a, 4, 4)).otherwise(F.slice(a, 3, 4)))).when(placed, _phrase(F.slice(a, 2, 4))).otherwise(empty)
        obj = F.when((z["w"] != "") & (F.size(z["o"]) == 0), late).otherwise(z["o"])
        return F.struct(q["value"].alias("value"), q["unit"].alias("unit"), q["dimension"].alias("dimension"), z["w"].alias("quantity"), F.array_join(obj, " ").alias("object"))

    return F.transform(measures(sentence), lambda q: let(tokens(q), lambda t: word(q, t)))


def split_value(text: Column) -> Column:
    """struct<value, unit>: the first number with a unit, else the first number, else empty."""
    bare = F.regexp_extract(text, f"(?<![\\p{{L}}\\p{{N}}_.])({NUMBER})", 1)
    value, unit = F.regexp_extract(text, QUANTITY, 1), F.regexp_extract(text, QUANTITY, 2)
    return F.struct(F.when(unit != "", value).otherwise(bare).alias("value"), unit.alias("unit"))
