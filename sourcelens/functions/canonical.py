"""Canonical JSON of a column, from its type alone: the text that Python's json.dumps(value, sort_keys=True) writes.

Keys are sorted by code point, items stand between ", " and ": ", characters beyond ASCII are escaped, floats have their
shortest form that reads back the same. It is one Column expression over structs, maps and arrays of any depth, so it
runs inside the JVM and its hash needs no text in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructType

_WHOLE = (ByteType, ShortType, IntegerType, LongType)
#: Characters with an escape of their own.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def text(x: Column) -> Column:
    """A string between quotation marks."""
    out = x
    for plain, escaped in ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    wide = F.regexp_like(out, F.lit("[^ -~]"))
    # UTF-16 gives the code units that \u escapes name, a pair for characters beyond the basic plane.
    units = F.transform(F.split(out, ""), lambda c: F.when(F.regexp_like(c, F.lit("^[ -~]*$")), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")))
    return F.concat(F.lit('"'), F.when(wide, F.array_join(units, "")).otherwise(out), F.lit('"'))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(shown: Column) -> Column:
    """Of d.ddd or d.dddE[-]n: the digits without zeros at either end, and the power of ten of the first."""

    def split(m: Column) -> Column:
        both = F.concat(m["whole"], m["part"])
        lead = F.length(both) - F.length(F.ltrim(both, F.lit("0")))
        return F.struct(F.trim(both, F.lit("0")).alias("d"), (F.length(m["whole"]) - 1 - lead + m["power"]).alias("e"))

    power = F.coalesce(F.try_to_number(F.regexp_extract(shown, r"E(-?\d+)$", 1), F.lit("S999")).cast("int"), F.lit(0))
    return let(F.struct(F.regexp_extract(shown, r"^(\d+)", 1).alias("whole"), F.regexp_extract(shown, r"\.(\d+)", 1).alias("part"), power.alias("power")), split)


def _shortest(x: Column) -> Column:
    """The digits of a positive number. The JVM may write one or two more than it takes to read the number back."""

    def struct(digits: Column, first: Column) -> Column:
        return F.struct(F.rtrim(digits, F.lit("0")).alias("d"), first.alias("e"))

    def reads(digits: Column, last: Column) -> Column:
        return F.concat(digits, F.lit("e"), last.cast("string")).cast("double") == x

    def less(s: Column) -> Column:
        n = F.length(s["d"])
        near = F.call_function("div", s["d"].cast("bigint") + 5, F.lit(10)).cast("string")
        grown = F.length(near) - (n - 1)
        return F.when((n > 1) & reads(near, s["e"] - n + 2), struct(near, s["e"] + grown)).otherwise(s)

    def whole(s: Column) -> Column:
        """Of a whole number of 17 to 19 digits, from which the nearest of 16, else 17 digits is known exactly."""

        def rounded(k: int) -> Column:
            ten = F.pow(F.lit(10), s["e"] + 1 - k).cast("bigint")
            return F.call_function("div", x.cast("bigint") + F.call_function("div", ten, F.lit(2)), ten).cast("string")

        six, seven = rounded(16), rounded(17)
        grown = lambda c, k: s["e"] + F.length(c) - k
        return F.when(reads(six, s["e"] - 15), struct(six, grown(six, 16))).otherwise(struct(seven, grown(seven, 17)))

    def chosen(s: Column) -> Column:
        return F.when((s["e"] >= 16) & (x < 9e18) & (F.length(s["d"]) > 15), whole(s)).otherwise(let(less(s), less))

    return let(_digits(x.cast("string")), chosen)


def _written(s: Column) -> Column:
    d, e, n = s["d"], s["e"], F.length(s["d"])
    power = F.concat(F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    far = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(""), F.lit("e"), power)
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
    above = F.when(n > e + 1, F.concat(F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2))).otherwise(F.concat(d, F.repeat(F.lit("0"), e + 1 - n), F.lit(".0")))
    return F.when((e >= 16) | (e < -4), far).when(e >= 0, above).otherwise(below)


def real(x: Column) -> Column:
    """A double: plain digits from 1e-4 to below 1e16, else an exponent of two digits at least."""

    def shown(v: Column) -> Column:
        sign = F.when(F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
        size = F.when(v == 0, "0.0").when(F.abs(v) == float("inf"), "Infinity").otherwise(let(_shortest(F.abs(v)), _written))
        return F.when(F.isnan(v), "NaN").otherwise(F.concat(sign, size))

    return let(x, shown)


def json(x: Column, kind: DataType) -> Column:
    """The canonical text of x, null as null. Dates and decimals are written as strings; a map's keys are strings."""
    if isinstance(kind, StructType):
        fields = [F.concat(text(F.lit(f.name)), F.lit(": "), json(x.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        shown = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(x), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        shown = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(text(e["key"].cast("string")), F.lit(": "), json(e["value"], kind.valueType))), ", "), F.lit("}"))
    elif isinstance(kind, ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: json(e, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, NullType):
        return F.lit("null")
    elif isinstance(kind, BooleanType):
        shown = F.when(x, "true").otherwise("false")
    elif isinstance(kind, (DoubleType, FloatType)):
        shown = real(x.cast("double"))
    elif isinstance(kind, _WHOLE):
        shown = x.cast("string")
    elif isinstance(kind, (StringType, DateType, DecimalType)):
        shown = text(x.cast("string"))
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.when(x.isNull(), "null").otherwise(shown)


def of(df, *names: str) -> Column:
    """The canonical text of some of a frame's columns as one object."""
    kind = StructType([df.schema[n] for n in names])
    return json(F.struct(*names), kind)
