"""Canonical JSON of any nested value, and its hash: built from the schema, run by Spark alone.

Keys are sorted, nothing is spaced, strings are escaped as JSON requires and no more (with
lower-case digits), numbers are written as JavaScript writes them. Two rows with the same
content have the same text, whatever order their columns or map entries are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.cuts import once

SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: Column) -> Column:
    """A string as JSON."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = out
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), escaped).otherwise(out), F.lit('"'))


def number(value: Column) -> Column:
    """A double as JavaScript writes it: as few digits as tell it apart, up to 21 places, then with an exponent; null if it is no finite number.

    Where 16 digits are enough but Java's own text has 17, ending in 5, the last digit may be one higher.
    """
    fewest = F.coalesce(*[F.when(F.format_string(f"%.{n - 1}e", value).cast("double") == value, F.format_string(f"%.{n - 1}e", value)) for n in (15, 16, 17)])

    def shown(java: Column) -> Column:
        part = lambda i: F.regexp_extract(java, r"^(-?)(\d)\.?(\d*)e([-+]\d+)$", i)
        digits = F.regexp_replace(F.concat(part(2), part(3)), "0+$", "")
        return F.struct(part(1).alias("sign"), digits.alias("digits"), F.length(digits).alias("n"), (part(4).cast("int") + 1).alias("point"))  # how many digits stand before the point

    def written(d: Column) -> Column:
        digits, n, point = d["digits"], d["n"], d["point"]
        zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)))
        plain = F.when(n <= point, F.concat(digits, zeros(point - n))).when(point > 0, F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1, n))).otherwise(F.concat(F.lit("0."), zeros(-point), digits))
        rest = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2), n))).otherwise("")
        power = F.concat(F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"))
        return F.concat(d["sign"], F.when((point > 21) | (point <= -6), F.concat(F.substr(digits, F.lit(1), F.lit(1)), rest, power)).otherwise(plain))

    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(value == 0, F.lit("0")).when(finite, once(once(fewest, shown), written))


def canonical(value: Column, kind: T.DataType, keep_nulls: bool = True, drop: frozenset[str] = frozenset()) -> Column:
    """A value of type ``kind`` as canonical JSON; null is ``null``.

    Fields and map entries that are null are written, unless ``keep_nulls`` is false; array
    items that are null always are. ``drop`` names struct fields to leave out, at any depth.
    """
    again = lambda v, k: canonical(v, k, keep_nulls, drop)
    named = lambda name, text: F.concat(name, F.lit(":"), text)
    brace = lambda parts: F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    if isinstance(kind, T.StructType):
        fields = sorted((f for f in kind if f.name not in drop), key=lambda f: f.name)
        parts = [F.when(F.lit(keep_nulls) | value[f.name].isNotNull(), named(quoted(F.lit(f.name)), again(value[f.name], f.dataType))) for f in fields]
        text = brace(F.array_compact(F.array(*parts))) if parts else F.lit("{}")
    elif isinstance(kind, T.MapType):
        entries = F.map_entries(value)
        entries = entries if keep_nulls else F.filter(entries, lambda e: e["value"].isNotNull())
        order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        text = brace(F.transform(F.array_sort(entries, order), lambda e: named(quoted(e["key"].cast("string")), again(e["value"], kind.valueType))))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: again(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.VariantType):
        text = F.to_json(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = number(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        text = value.cast("string")
    elif isinstance(kind, T.BinaryType):
        text = quoted(F.base64(value))
    else:
        text = quoted(value.cast("string"))
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def row_json(df: DataFrame, *columns: str, keep_nulls: bool = True, drop: frozenset[str] = frozenset()) -> Column:
    """The named columns of a row (all without names) as one object."""
    names = columns or tuple(df.columns)
    kind = T.StructType([df.schema[n] for n in names])
    return canonical(F.struct(*names), kind, keep_nulls, drop)


def digest(df: DataFrame, *columns: str, keep_nulls: bool = True, drop: frozenset[str] = frozenset()) -> Column:
    """SHA-256 of ``row_json``."""
    return F.sha2(row_json(df, *columns, keep_nulls=keep_nulls, drop=drop), 256)
