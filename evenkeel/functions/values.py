"""Expressions that normalise, compare and hash values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.config import ReconConfig
from evenkeel.functions.logical import TARGETS, is_numeric, is_text


def normalised(c: Column, kind: T.DataType, cfg: ReconConfig) -> Column:
    """A value as the settings see it; types that a setting does not name are left alone."""
    if is_text(kind):
        c = F.trim(c) if cfg.trim_strings else c
        c = c if cfg.case_sensitive else F.lower(c)
        return F.nullif(c, F.lit("")) if cfg.null_equals_empty else c
    if cfg.decimal_scale is not None and isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.round(c.cast("double"), cfg.decimal_scale)
    if cfg.timestamp_tz and isinstance(kind, T.TimestampNTZType):
        return F.to_utc_timestamp(c.cast("timestamp"), cfg.timestamp_tz)
    if cfg.timestamp_tz and isinstance(kind, T.TimestampType):
        return F.from_utc_timestamp(c, cfg.timestamp_tz)
    return c


def to_logical(c: Column, logical: str) -> Column:
    """A value by way of text as a logical type: blank and unreadable values are null."""
    return F.nullif(F.trim(c.try_cast("string")), F.lit("")).try_cast(TARGETS[logical])


def as_text(c: Column, cfg: ReconConfig) -> Column:
    """A value as text, empty as null, then trimmed and lower-cased if the settings say so."""
    c = F.nullif(c.try_cast("string"), F.lit(""))
    c = F.trim(c) if cfg.trim_strings else c
    return c if cfg.case_sensitive else F.lower(c)


def comparable(left: Column, right: Column, left_kind: T.DataType, right_kind: T.DataType, logical: str | None, cfg: ReconConfig) -> tuple[Column, Column]:
    """Both sides of a column in a form in which they can be compared."""
    if left_kind == right_kind:
        return normalised(left, left_kind, cfg), normalised(right, right_kind, cfg)
    if logical:
        return to_logical(left, logical), to_logical(right, logical)
    return as_text(left, cfg), as_text(right, cfg)


def differ(left: Column, right: Column, tolerance: float | None = None) -> Column:
    """Whether two values differ; nulls are equal. With a tolerance, by more than that, as numbers."""
    if tolerance is None:
        return ~left.eqNullSafe(right)
    a, b = left.try_cast("double"), right.try_cast("double")
    return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > F.lit(float(tolerance)), F.lit(False))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def widened(c: Column, kind: T.DataType) -> Column:
    """A value in the widest type of its family, so that equal values of two widths hash alike."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("bigint")
    if isinstance(kind, T.FloatType):
        return c.cast("double")
    if isinstance(kind, T.DecimalType):
        return c.cast(T.DecimalType(38, kind.scale))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(c))
    return c


def row_hash(columns: list[tuple[Column, T.DataType]], cfg: ReconConfig) -> Column:
    """One 64-bit hash of the normalised values. Whether each is null goes in, as xxhash64 skips nulls."""
    parts: list[Column] = []
    for c, kind in columns:
        value = normalised(c, kind, cfg)
        if not (cfg.decimal_scale is not None and is_numeric(kind) and not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))):
            value = widened(value, kind)
        parts += [value.isNull(), value]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def unsigned_hex(value: int | None) -> str:
    return f"{(value or 0) & 0xFFFFFFFFFFFFFFFF:016x}"
