"""JSON text as Column expressions: keys sorted, two blanks for each level, other characters than ASCII kept.

The layout is that of a common pretty printer: a line for each member, ``"key": value``, no blanks at line ends, ``{}`` and
``[]`` for what is empty. Numbers are written as they are in SQL; fractions are left to the caller, since engines differ in
how they write them.

Defined results: a null is written as ``null``, and so is a null value in an array, a struct or a map. Entries of a map
are sorted by key, code point by code point. Texts of any length are escaped whole. Other types are a TypeError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.functions.chars import let

# The characters with an escape of two letters.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    plain = text
    for raw, escaped in ESCAPES.items():
        plain = F.replace(plain, F.lit(raw), F.lit(escaped))
    rare = plain
    for code in range(32):
        if chr(code) not in ESCAPES:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(plain), F.lit('"'))


def _members(lines: Column, level: int, marks: str) -> Column:
    """An array of member texts between brackets, or the brackets alone."""
    gap = "\n" + "  " * (level + 1)
    many = F.concat(F.lit(marks[0] + gap), F.array_join(lines, "," + gap), F.lit("\n" + "  " * level + marks[1]))
    return F.when(F.size(lines) == 0, marks).otherwise(many)


def _written(value: Column, kind: T.DataType, level: int) -> Column:
    """``value`` of a type as JSON text; null for null."""
    inner = lambda x, k: F.coalesce(_written(x, k, level + 1), F.lit("null"))
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return let(value, quoted)
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        return value.cast("string")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return quoted(value.cast("string"))
    if isinstance(kind, T.ArrayType):
        return F.when(value.isNotNull(), let(F.transform(value, lambda x: inner(x, kind.elementType)), lambda lines: _members(lines, level, "[]")))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_keys(value))
        member = lambda k: F.concat(quoted(k), F.lit(": "), inner(F.try_element_at(value, k), kind.valueType))
        return F.when(value.isNotNull(), let(F.transform(entries, member), lambda lines: _members(lines, level, "{}")))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        lines = [F.concat(quoted(F.lit(f.name)), F.lit(": "), inner(value.getField(f.name), f.dataType)) for f in fields]
        return F.when(value.isNotNull(), _members(F.array(*lines), level, "{}")) if lines else F.when(value.isNotNull(), "{}")
    raise TypeError(f"no JSON text for {kind.simpleString()}")


def pretty_json(rows: DataFrame, column: str, level: int = 0) -> Column:
    """The JSON text of a column of ``rows`` (a struct, map, array or scalar), with a line end behind it."""
    return F.concat(F.coalesce(_written(F.col(f"`{column}`"), rows.schema[column].dataType, level), F.lit("null")), F.lit("\n"))
