"""Keyed comparison by slices, all in the same two plans: the slice is one more grouping column."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.errors import CompareError
from evenkeel.functions.names import named
from evenkeel.operators.keyed import COUNTERS, SLICE, Pair, changed_rows, key_counters, samples
from evenkeel.types import KeyedResult, PartitionResult, PartitionSpec


def slice_values(pair: Pair, spec: PartitionSpec) -> list[Any]:
    """The slices' labels in order. Values are counted up to max_partitions and no further."""
    if spec.strategy == "hash":
        n = max(int(spec.buckets), 1)
        return [f"hash_bucket_{b}_of_{n}" for b in range(n)]
    if spec.strategy == "range":
        if not spec.boundaries:
            raise CompareError("range partition strategy requires `boundaries`")
        return [f"[{lo}, {hi})" for lo, hi in spec.boundaries]
    if spec.strategy != "value":
        raise CompareError(f"unknown partition strategy: {spec.strategy!r}")
    both = union_values(pair.left, pair.right, spec)
    rows = [r[0] for r in (both if spec.max_partitions is None else both.limit(spec.max_partitions + 1)).collect()]
    if spec.max_partitions is not None and len(rows) > spec.max_partitions:
        raise CompareError(f"value partitioning of {spec.column!r} gives more than max_partitions={spec.max_partitions} partitions; use strategy 'hash'")
    return rows


def union_values(left: DataFrame, right: DataFrame, spec: PartitionSpec) -> DataFrame:
    """The different values of the partition column on both sides, ordered, null last."""
    values = left.select(named(spec.column).alias("value")).union(right.select(named(spec.right()).alias("value")))
    return values.distinct().orderBy(F.col("value").asc_nulls_last())


def slice_column(c: Column, spec: PartitionSpec) -> Column:
    """The slice of a row: its value, the number of its bucket, or an array with the numbers of its ranges."""
    if spec.strategy == "hash":
        return F.pmod(F.xxhash64(c.cast("string")), F.lit(max(int(spec.buckets), 1))).cast("int")
    if spec.strategy == "range":
        inside = [F.when((c >= F.lit(lo)) & (c < F.lit(hi)), F.lit(i)) for i, (lo, hi) in enumerate(spec.boundaries)]
        return F.array_compact(F.array(*inside))
    return c


def sliced(pair: Pair, spec: PartitionSpec) -> Pair:
    def cut(df: DataFrame, column: str) -> DataFrame:
        out = df.withColumn(SLICE, slice_column(named(column), spec))
        return out.withColumn(SLICE, F.explode(SLICE)) if spec.strategy == "range" else out

    return replace(pair, left=cut(pair.left, spec.column), right=cut(pair.right, spec.right()), sliced=True)


def slice_counters(pair: Pair) -> DataFrame:
    """A row per slice that has rows: SLICE, COUNTERS and changed_rows. pair is sliced."""
    changed = changed_rows(pair).groupBy(named(SLICE).alias("__of")).agg(F.count("*").alias("changed_rows"))
    counters = key_counters(pair)
    joined = counters.join(changed, named(SLICE).eqNullSafe(F.col("__of")), "left")
    return joined.select(SLICE, *COUNTERS, F.coalesce("changed_rows", F.lit(0)).alias("changed_rows"))


def compare_partitioned(pair: Pair, spec: PartitionSpec) -> KeyedResult:
    for side, df, column in (("left", pair.left, spec.column), ("right", pair.right, spec.right())):
        if column not in df.columns:
            raise CompareError(f"partition column {column!r} is not in the {side} source")
    labels = slice_values(pair, spec)
    cut = sliced(pair, spec)
    rows = {r[SLICE]: r.asDict() for r in slice_counters(cut).collect()}  # as many as there are slices
    total = KeyedResult()
    for number, label in enumerate(labels):
        counters = rows.get(label if spec.strategy == "value" else number, {})
        part = PartitionResult(label, **{k: counters.get(k, 0) for k in (*COUNTERS, "changed_rows")})
        part.match = not (part.missing_in_left or part.missing_in_right or part.changed_rows or part.duplicate_keys_left or part.duplicate_keys_right) and part.row_count_left == part.row_count_right
        total.partitions.append(part)
        for k in (*COUNTERS, "changed_rows"):
            setattr(total, k, getattr(total, k) + getattr(part, k))
    total.samples = samples(cut, total, int(pair.cfg.sample_limit))
    return total
