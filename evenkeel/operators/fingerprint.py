"""Fingerprints of whole datasets: independent of row order, partitioning and number widths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.config import ReconConfig
from evenkeel.functions.names import named, one_key
from evenkeel.functions.values import row_hash, unsigned_hex
from evenkeel.types import HashCompareResult


def fingerprints(left: DataFrame, right: DataFrame, columns: list[str], cfg: ReconConfig) -> DataFrame:
    """side, n, xor and total (a 128-bit sum) of the row hashes: both sides in one job of two map-side sums."""

    def hashed(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.lit(side).alias("side"), row_hash([(named(c), df.schema[c].dataType) for c in columns], cfg).alias("h"))

    both = hashed(left, "left").unionAll(hashed(right, "right"))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"))


def read(df: DataFrame) -> dict[str, tuple[int, int, int]]:
    found = {r["side"]: (int(r["n"]), int(r["xor"] or 0), int(r["total"] or 0)) for r in df.collect()}
    return {side: found.get(side, (0, 0, 0)) for side in ("left", "right")}


def fast_path(left: DataFrame, right: DataFrame, columns: list[str], cfg: ReconConfig) -> tuple[bool, dict, int, int]:
    """Whether both sides are the same multiset of rows; what to tell of it; and both row counts."""
    both = read(fingerprints(left, right, columns, cfg))
    (n, xor, total), (m, other, sum_) = both["left"], both["right"]
    if n != m:
        return False, {"matched": False, "reason": "row_count_diff", "row_count_left": n, "row_count_right": m}, n, m
    matched = (xor, total) == (other, sum_)
    info = {
        "matched": matched,
        "algo": "xxhash64",
        "row_count": n,
        "columns_hashed": list(columns),
        "left_fingerprint": {"xor": unsigned_hex(xor), "sum": str(total)},
        "right_fingerprint": {"xor": unsigned_hex(other), "sum": str(sum_)},
    }
    return matched, info if matched else info | {"reason": "hash_diff"}, n, m


def hash_compare(left: DataFrame, right: DataFrame, columns: list[str] | None = None, keys: str | list[str] | None = None, config: ReconConfig | None = None) -> HashCompareResult:
    """Compare the XOR of all row hashes over the value columns. An even number of equal extra rows goes unseen, as XOR has it."""
    return hash_compare_counted(left, right, columns, keys, config)[0]


def hash_compare_counted(left, right, columns=None, keys=None, config=None) -> tuple[HashCompareResult, int, int]:
    cfg = config or ReconConfig()
    common = columns if columns is not None else sorted(set(left.columns) & set(right.columns))
    hashed = [c for c in common if c not in one_key(keys) and c not in cfg.exclude_columns and (not cfg.columns or c in cfg.columns)]
    both = read(fingerprints(left, right, hashed, cfg))
    (n, xor, _), (m, other, _) = both["left"], both["right"]
    return HashCompareResult(xor == other, unsigned_hex(xor), unsigned_hex(other), hashed), n, m
