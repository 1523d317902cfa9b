"""Schema differences."""

from __future__ import annotations

from pyspark.sql import types as T

from evenkeel.config import ReconConfig
from evenkeel.functions.logical import loose
from evenkeel.types import SchemaDiff


def compare_schemas(left: T.StructType, right: T.StructType, cfg: ReconConfig, logical_left: dict[str, str] | None = None, logical_right: dict[str, str] | None = None) -> SchemaDiff:
    """Names and types of two schemas that share names where they mean the same column.

    Types match by what the data is where both sides were looked at, else by stored type with all
    numbers alike. "null" (a column without a value) fits everything.
    """
    left_kinds = {f.name: f.dataType for f in left.fields if f.name not in cfg.exclude_columns}
    right_kinds = {f.name: f.dataType for f in right.fields if f.name not in cfg.exclude_columns}
    common = sorted(left_kinds.keys() & right_kinds.keys())
    stored = {c: {"left": left_kinds[c].simpleString(), "right": right_kinds[c].simpleString()} for c in common if loose(left_kinds[c]) != loose(right_kinds[c])}
    here = {c: t for c, t in (logical_left or {}).items() if c in left_kinds}
    there = {c: t for c, t in (logical_right or {}).items() if c in right_kinds}
    meant = {c: {"left": here[c], "right": there[c]} for c in common if c in here and c in there and here[c] != there[c] and "null" not in (here[c], there[c])}
    absent_left, absent_right = sorted(right_kinds.keys() - left_kinds.keys()), sorted(left_kinds.keys() - right_kinds.keys())
    drift = meant if here and there else stored
    return SchemaDiff(not (absent_left or absent_right or drift), absent_left, absent_right, stored, common, here, there, meant)
