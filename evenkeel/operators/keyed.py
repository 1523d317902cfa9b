"""Keyed comparison as two plans: key groups in a full outer join, and rows in an inner join.

Both take an optional slice column (see partition.py), by which all counters come back; without one,
there is one row of counters. Key tuples are grouped before they meet, so duplicates never multiply in
the outer join, and both sides shuffle once, on the keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.config import ReconConfig
from evenkeel.errors import CompareError
from evenkeel.functions.logical import TARGETS
from evenkeel.functions.names import named
from evenkeel.functions.values import any_of, comparable, differ, row_hash
from evenkeel.types import KeyedResult

SLICE = "__slice"
COUNTERS = ("row_count_left", "row_count_right", "missing_in_left", "missing_in_right", "duplicate_keys_left", "duplicate_keys_right")


@dataclass
class Pair:
    """Two sides with the same names for the same columns."""

    left: DataFrame
    right: DataFrame
    keys: list[str]
    values: list[str]
    cfg: ReconConfig
    logical: dict[str, str] = field(default_factory=dict)
    sliced: bool = False

    def __post_init__(self):
        for key in self.keys:
            for side, df in (("left", self.left), ("right", self.right)):
                if key not in df.columns:
                    raise CompareError(f"key column {key!r} is not in the {side} source")
        for key in self.keys:  # keys of two types meet in the type their data has
            kinds = self.left.schema[key].dataType, self.right.schema[key].dataType
            if kinds[0] != kinds[1] and key in self.logical:
                target = TARGETS[self.logical[key]]
                self.left = self.left.withColumn(key, F.trim(named(key).cast("string")).try_cast(target))
                self.right = self.right.withColumn(key, F.trim(named(key).cast("string")).try_cast(target))
            elif kinds[0].simpleString() != kinds[1].simpleString() and "string" in (kinds[0].simpleString(), kinds[1].simpleString()):
                self.left, self.right = (df.withColumn(key, named(key).cast("string")) for df in (self.left, self.right))

    def by(self) -> list[str]:
        return [SLICE] if self.sliced else []

    def on(self, a: str = "l", b: str = "r") -> Column:
        """Keys are equal in SQL's sense, so a null key meets nothing; slices are the same, null included."""
        same = [named(k, a) == named(k, b) for k in self.keys]
        same += [named(SLICE, a).eqNullSafe(named(SLICE, b))] if self.sliced else []
        return reduce(lambda x, y: x & y, same)


def value_columns(common: list[str], keys: list[str], cfg: ReconConfig) -> list[str]:
    return [c for c in common if c not in keys and c not in cfg.exclude_columns and (not cfg.columns or c in cfg.columns)]


def key_groups(pair: Pair) -> DataFrame:
    """A row per different key tuple: its number of rows on either side, null where it has none, under the names l_n and r_n."""
    names = pair.by() + pair.keys
    left = pair.left.groupBy(*map(named, names)).agg(F.count("*").alias("l_n")).alias("l")
    right = pair.right.groupBy(*map(named, names)).agg(F.count("*").alias("r_n")).alias("r")
    joined = left.join(right, pair.on(), "full_outer")
    return joined.select(*(F.coalesce(named(n, "l"), named(n, "r")).alias(n) for n in names), "l_n", "r_n")


def key_counters(pair: Pair) -> DataFrame:
    """COUNTERS, by slice if there are any."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = [
        total("l_n").alias("row_count_left"),
        total("r_n").alias("row_count_right"),
        F.count_if(F.col("l_n").isNull()).alias("missing_in_left"),
        F.count_if(F.col("r_n").isNull()).alias("missing_in_right"),
        F.count_if(F.coalesce(F.col("l_n") > 1, F.lit(False))).alias("duplicate_keys_left"),
        F.count_if(F.coalesce(F.col("r_n") > 1, F.lit(False))).alias("duplicate_keys_right"),
    ]
    groups = key_groups(pair)
    return groups.groupBy(SLICE).agg(*sums) if pair.sliced else groups.agg(*sums)


def changed_rows(pair: Pair) -> DataFrame:
    """Pairs of rows with one key and different values: keys, then c__left and c__right for each value column (keys alone with row_hash)."""
    cfg, keys = pair.cfg, pair.keys
    if cfg.row_hash:
        sides = []
        for df in (pair.left, pair.right):
            h = row_hash([(named(c), df.schema[c].dataType) for c in pair.values], cfg)
            sides.append(df.select(*map(named, pair.by() + keys), h.alias("__hash")))
        rows = sides[0].alias("l").join(sides[1].alias("r"), pair.on()).where("l.__hash <> r.__hash")
        return rows.select(*(named(n, "l").alias(n) for n in pair.by() + keys))
    names = pair.by() + keys + pair.values
    left, right = (df.select(*map(named, names)).alias(a) for df, a in ((pair.left, "l"), (pair.right, "r")))
    tests = []
    for c in pair.values:
        kinds = pair.left.schema[c].dataType, pair.right.schema[c].dataType
        forms = comparable(named(c, "l"), named(c, "r"), *kinds, pair.logical.get(c), cfg)
        tests.append(differ(*forms, tolerance_for(c, cfg)))
    rows = left.join(right, pair.on() & any_of(tests))
    both = [x for c in pair.values for x in (named(c, "l").alias(f"{c}__left"), named(c, "r").alias(f"{c}__right"))]
    return rows.select(*(named(n, "l").alias(n) for n in pair.by() + keys), *both)


def tolerance_for(column: str, cfg: ReconConfig) -> float | None:
    return cfg.tolerances.get(column, cfg.tolerances.get(cfg.column_mapping.get(column, column)))


def missing_keys(pair: Pair, side: str) -> DataFrame:
    """The different key tuples that the given side ("left" or "right") does not have."""
    absent = "l_n" if side == "left" else "r_n"
    return key_groups(pair).where(F.col(absent).isNull()).select(*map(named, pair.by() + pair.keys))


def first_rows(df: DataFrame, pair: Pair, limit: int) -> list[dict]:
    """At most so many rows in the order of slice and keys, so that a repeated run shows the same."""
    order = [named(c).asc_nulls_last() for c in pair.by() + pair.keys]
    return [r.asDict(recursive=True) for r in df.orderBy(*order).limit(limit).drop(SLICE).collect()]


def samples(pair: Pair, result: KeyedResult, limit: int) -> dict[str, list[dict]]:
    """Example rows of the buckets that have any."""
    found: dict[str, list[dict]] = {"missing_in_left": [], "missing_in_right": [], "changed": []}
    if limit <= 0:
        return found
    if result.missing_in_left:
        found["missing_in_left"] = first_rows(missing_keys(pair, "left"), pair, limit)
    if result.missing_in_right:
        found["missing_in_right"] = first_rows(missing_keys(pair, "right"), pair, limit)
    if result.changed_rows:
        found["changed"] = first_rows(changed_rows(pair), pair, limit)
    return found


def compare_keyed(pair: Pair) -> KeyedResult:
    result = KeyedResult(**key_counters(pair).first().asDict())
    result.changed_rows = changed_rows(pair).count()
    result.samples = samples(pair, result, int(pair.cfg.sample_limit))
    return result
