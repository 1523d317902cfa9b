"""Column profiles: nulls, distinct values, and the first and last value as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.names import named


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, nulls, distinct, min, max for each column.

    The columns' values become rows of (column, text) and are grouped twice, so that the exact distinct
    counts of many columns need no copy of the input for each.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in columns))
    values = df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value")
    groups = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    found = groups.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("nulls"),
        F.count("value").alias("distinct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # columns of an empty table too
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("nulls", "distinct")]
    return every.join(found, "column", "left").select("column", *zero, "min", "max")


def profile_pair(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    sides = [profile(df, columns).withColumn("side", F.lit(side)) for df, side in ((left, "left"), (right, "right"))]
    return sides[0].unionByName(sides[1])


def compare_profiles(left: DataFrame, right: DataFrame, columns: list[str]) -> dict[str, dict]:
    out: dict[str, dict] = {c: {} for c in columns}
    if columns:
        for r in profile_pair(left, right, columns).collect():  # two rows a column
            out[r["column"]][r["side"]] = {k: r[k] for k in ("nulls", "distinct", "min", "max")}
    return out
