"""Generated pairs whose differences follow from arithmetic on the id, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALUES = ["customer_id", "region", "amount", "qty", "name", "created_at", "is_active"]
SCENARIOS = ("all_match", "small_mismatch", "large_mismatch", "precision_diff")


def left_side(spark: SparkSession, rows: int) -> DataFrame:
    """id from 0, and seven columns drawn from its hash."""
    h = lambda p: F.pmod(F.xxhash64(F.col("id") * p), F.lit(1_000_003))
    return spark.range(rows).select(
        "id",
        (h(7) % 100_000).alias("customer_id"),
        F.element_at(F.array(*map(F.lit, ("NORTH", "SOUTH", "EAST", "WEST"))), (h(11) % 4 + 1).cast("int")).alias("region"),
        F.round(h(13) / 100, 2).alias("amount"),
        (h(17) % 50 + 1).cast("int").alias("qty"),
        F.concat(F.lit("item-"), F.lpad(h(19).cast("string"), 7, "0")).alias("name"),
        F.timestamp_seconds(1_700_000_000 + h(23)).cast("timestamp_ntz").alias("created_at"),
        (h(29) % 2 == 0).alias("is_active"),
    )


def pair(spark: SparkSession, scenario: str, rows: int) -> tuple[DataFrame, DataFrame]:
    base, i = left_side(spark, rows), F.col("id")
    if scenario == "small_mismatch":
        right = base.where(i % 5000 != 1).withColumn("amount", F.when(i % 1000 == 0, F.col("amount") + 0.5).otherwise(F.col("amount")))
        return base.where(i % 5000 != 2), right
    if scenario == "large_mismatch":
        step = F.when(i % 20 == 0, 1).otherwise(0)
        return base, base.withColumns({"amount": F.col("amount") + step, "qty": (F.col("qty") + step).cast("int")})
    if scenario == "precision_diff":
        return base, base.withColumns({"amount": F.col("amount") + 1e-6, "created_at": F.col("created_at") + F.expr("INTERVAL '0.003' SECOND")})
    if scenario == "all_match":
        return base, base
    raise ValueError(f"unknown scenario {scenario!r}; there are {', '.join(SCENARIOS)}")


def truth(scenario: str, rows: int) -> tuple[int, int, int]:
    """missing_in_left, missing_in_right and changed_rows of a scenario."""
    n = lambda step, rest: len(range(rest, rows, step))
    return {"all_match": (0, 0, 0), "small_mismatch": (n(5000, 2), n(5000, 1), n(1000, 0)), "large_mismatch": (0, 0, n(20, 0)), "precision_diff": (0, 0, rows)}[scenario]
