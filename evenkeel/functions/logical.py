"""Logical types: what a column's data is, whatever type it is stored in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.names import named

#: The Spark type that values of a logical type are compared in.
TARGETS = {"bool": "boolean", "integer": "bigint", "decimal": "double", "date": "date", "timestamp": "timestamp_ntz", "text": "string", "null": "string"}

# Words that count as booleans, and texts that Spark would read as numbers or dates but are not.
BOOLEAN_WORDS = ("true", "false", "t", "f", "yes", "no")
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"
_WHOLE_DATE = r"^[+-]?\d{4,}-\d{1,2}-\d{1,2}"
_TIME_OF_DAY = r":| |[0-9]T[0-9]"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType, T.DecimalType)
_TEXT = (T.StringType, T.VarcharType, T.CharType)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, _TEXT)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, _INTEGRAL + _FRACTION)


def declared(kind: T.DataType) -> str:
    """The logical type that follows from a stored type alone."""
    for types, name in ((T.BooleanType, "bool"), (_INTEGRAL, "integer"), (_FRACTION, "decimal"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "timestamp"), (T.NullType, "null")):
        if isinstance(kind, types):
            return name
    return "text"


def loose(kind: T.DataType) -> str:
    """The stored type with all numbers as one and all strings as one."""
    return "number" if is_numeric(kind) else "string" if is_text(kind) else kind.simpleString()


def misfits(c: Column) -> dict[str, Column]:
    """For each logical type that text may hold, narrowest first, whether a value is not of it."""
    value = F.trim(c)
    filled = c.isNotNull() & (value != "")
    return {
        "bool": c.isNotNull() & ~F.lower(value).isin(*BOOLEAN_WORDS),
        "integer": filled & (value.try_cast("bigint").isNull() | value.rlike(r"[.eE]")),
        "decimal": filled & (value.try_cast("double").isNull() | ~value.rlike(_NUMBER)),
        "date": filled & (value.try_cast("date").isNull() | ~value.rlike(_WHOLE_DATE) | value.rlike(_TIME_OF_DAY)),
        "timestamp": filled & (value.try_cast("timestamp_ntz").isNull() | ~value.rlike(_WHOLE_DATE)),
    }


#: Order of the sample's rows.
_SEED = 20240229


def infer(df: DataFrame, most_rows: int | None = None) -> dict[str, str]:
    """Each column's logical type. Text columns are judged by all rows in one aggregate, or by a random sample of the whole table, of so many rows."""
    found = {f.name: declared(f.dataType) for f in df.schema.fields}
    texts = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not texts:
        return found
    sums: list[Column] = []
    for i, name in enumerate(texts):
        c = named(name)
        sums.append(F.count(c).alias(f"n{i}"))
        sums += [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"{kind}{i}") for kind, bad in misfits(c).items()]
    rows = df.select(*map(named, texts))
    if most_rows is not None:
        rows = rows.orderBy(F.rand(_SEED)).limit(max(int(most_rows), 1))
    row = rows.agg(*sums).first()
    for i, name in enumerate(texts):
        fitting = (kind for kind in ("bool", "integer", "decimal", "date", "timestamp") if not row[f"{kind}{i}"])
        found[name] = next(fitting, "text") if row[f"n{i}"] else "null"
    return found


def agreed(left: dict[str, str], right: dict[str, str], columns: list[str]) -> dict[str, str]:
    """The logical type of columns on which both sides agree, where it is more than text."""
    return {c: left[c] for c in columns if left.get(c) == right.get(c) and left.get(c) not in (None, "null", "text")}
