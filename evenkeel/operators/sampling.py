"""Samples of key tuples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.names import named


def sample_keys(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """n different key tuples (all, if there are fewer), those with the smallest hash: the same in every run."""
    tuples = df.select(*map(named, keys)).distinct()
    return tuples.orderBy(F.xxhash64(*map(named, keys)), *map(named, keys)).limit(n)


def only_keys(df: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key tuple is in the sample; null keys are in none. Spark broadcasts the sample where it is small and shuffles both sides where it is not."""
    small = sample.select(*(named(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    same = reduce(lambda a, b: a & b, (named(k) == F.col(f"__k{i}") for i, k in enumerate(keys)))
    return df.join(small, same, "left_semi")
