"""Rows as compact text: a header with the column names and one bracketed line for each row.

Fixed values: rows are ``[a,b]``, lists within are joined by ``|``; backslash, comma, brackets and bar
are escaped by a backslash; nulls are empty, as are empty texts, so the two can't be told apart again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\,\[\]|])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\,\[\]|])", "$1")


def _value(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        nested = isinstance(inner, (T.StructType, T.MapType, T.ArrayType))
        text = F.array_join(F.transform(c, lambda x: escape(F.coalesce(F.to_json(x) if nested else x.cast("string"), F.lit("")))), "|")
    elif isinstance(kind, (T.StructType, T.MapType)):
        text = escape(F.to_json(c))
    else:
        text = escape(c.cast("string"))
    return F.coalesce(text, F.lit(""))


def header(df: DataFrame, name: str = "data") -> str:
    """The first line of the text."""
    return f"{name}({','.join(df.columns)})"


def encode(df: DataFrame) -> DataFrame:
    """(line): one compact line for each row."""
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *[_value(f) for f in df.schema.fields]), F.lit("]")).alias("line"))


def decode(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The rows of compact lines (line); a value that isn't of its column's type becomes null."""
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    # An escaped character is never a separator: cut at commas that an even number of backslashes precedes.
    cut = lambda text, at: F.split(text, rf"(?<=(?<!\\)(?:\\\\){{0,1000}}){at}", -1)
    inside = F.expr("substring(line, 2, length(line) - 2)")
    values = lines.filter(F.startswith("line", F.lit("[")) & F.endswith("line", F.lit("]"))).select(F.explode(F.array(cut(inside, ","))).alias("v"))

    def typed(i: int, field: T.StructField) -> Column:
        raw, kind = F.try_element_at("v", F.lit(i + 1)), field.dataType
        if isinstance(kind, T.ArrayType):
            parts = F.when(raw == "", F.array().cast("array<string>")).otherwise(F.transform(cut(raw, r"\|"), unescape))
            return F.transform(parts, lambda x: x.try_cast(kind.elementType))
        if isinstance(kind, (T.StructType, T.MapType)):
            return F.from_json(unescape(raw), kind)
        return unescape(raw).try_cast(kind)

    return values.select(*[typed(i, f).alias(f.name) for i, f in enumerate(schema.fields)])


def saving(plain: Column, compact: Column) -> Column:
    """Per cent of the estimated tokens that the compact text saves."""
    a, b = F.ceil(F.length(plain) / 4), F.ceil(F.length(compact) / 4)
    return F.when(a > 0, F.round(100 * (a - b) / a, 1)).otherwise(0.0)
