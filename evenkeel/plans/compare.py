"""compare(): the modes, put together from the operators."""

from __future__ import annotations

import logging
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from evenkeel.config import ReconConfig
from evenkeel.errors import CompareError, ReconError
from evenkeel.functions import logical as lt
from evenkeel.functions.names import named, one_key
from evenkeel.operators.fingerprint import fast_path, hash_compare_counted
from evenkeel.operators.keyed import Pair, compare_keyed, value_columns
from evenkeel.operators.partition import compare_partitioned
from evenkeel.operators.profile import compare_profiles
from evenkeel.operators.sampling import only_keys, sample_keys
from evenkeel.operators.schema import compare_schemas
from evenkeel.result import ReconResult
from evenkeel.sources.base import DataFrameSource, Source
from evenkeel.types import ExecutionMetrics, KeyedResult, PartitionSpec, SchemaDiff

log = logging.getLogger(__name__)

MODES = ("schema", "rowcount", "names_only", "keyed", "sampled", "profile", "hash")
SESSION = {"spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true"}


def compare(left, right, keys=None, compare_mode: str = "keyed", columns=None, exclude_columns=None, tolerances=None, chunk_size=None, partition: PartitionSpec | None = None, config: ReconConfig | None = None, spark: SparkSession | None = None) -> ReconResult:
    """Compare two sources (or DataFrames). Never raises for what the data or the sources do: such a result has status ERROR.

    Single arguments go before config. partition slices mode "keyed" and is ignored in the others.
    """
    began = time.monotonic()
    keys = one_key(keys)
    previous: dict[str, str | None] = {}
    loaded: list[Source] = []
    try:
        cfg = (config or ReconConfig()).with_changes(columns=list(columns) if columns else None, exclude_columns=list(exclude_columns) if exclude_columns else None, tolerances=dict(tolerances) if tolerances else None, chunk_size=chunk_size)
        spark = spark or SparkSession.builder.getOrCreate()
        previous = {k: spark.conf.get(k, None) for k in SESSION}
        for k, v in SESSION.items():
            spark.conf.set(k, v)
        sides = [side if isinstance(side, Source) else DataFrameSource(side) for side in (left, right)]
        loaded = sides
        frames = [side.open(spark) for side in sides]
        result = run(*frames, keys, compare_mode, cfg, partition)
    except ReconError as e:
        result = ReconResult("ERROR", error=str(e), compare_mode=compare_mode, keys=keys)
    except Exception as e:  # whatever a reader or a plan raises
        log.debug("comparison failed", exc_info=True)
        result = ReconResult("ERROR", error=f"{type(e).__name__}: {e}", compare_mode=compare_mode, keys=keys)
    finally:
        for side in loaded:
            side.close()
        for k, v in previous.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    result.execution_metrics = ExecutionMetrics(elapsed_sec=time.monotonic() - began)
    return result


def align(left: DataFrame, right: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """right under left's names. A right column that a mapping takes is that column and no other; one that only shares a left name already taken keeps out of the way."""
    pairs = {r: l for l, r in mapping.items() if l in left.columns and r in right.columns}
    taken = set(pairs.values())
    return right.select(*(named(c).alias(pairs.get(c, f"{c}__right_only" if c in taken else c)) for c in right.columns))


def run(left: DataFrame, right: DataFrame, keys: list[str], mode: str, cfg: ReconConfig, partition: PartitionSpec | None) -> ReconResult:
    own_right = right
    right = align(left, right, cfg.column_mapping)
    inferred: list[dict[str, str]] = [{}, {}]
    if cfg.infer_logical_types and mode != "names_only":
        try:
            inferred = [lt.infer(df, cfg.infer_sample_size) for df in (left, right)]
        except Exception as e:
            log.warning("logical types could not be inferred (%s); stored types count", e)
    diff = compare_schemas(left.schema, right.schema, cfg, *inferred)
    result = ReconResult("MATCH", schema_match=diff.match, schema_diff=rename_back(diff, cfg, own_right), compare_mode=mode, keys=keys)
    agreed = lt.agreed(diff.logical_left, diff.logical_right, diff.common_columns)
    if mode == "schema":
        result.data_match = True
    elif mode in ("rowcount", "names_only"):
        result.row_count_left, result.row_count_right = left.count(), right.count()
        result.data_match = result.row_count_left == result.row_count_right
        if mode == "names_only":
            result.schema_match = not (diff.missing_in_left or diff.missing_in_right)
    elif mode == "hash":
        found, result.row_count_left, result.row_count_right = hash_compare_counted(left, right, diff.common_columns, keys, cfg)
        result.data_match = found.match
        result.column_stats = {"hash": {k: getattr(found, k) for k in ("algo", "left_checksum", "right_checksum", "columns_hashed")}}
    elif mode == "profile":
        result.row_count_left, result.row_count_right = left.count(), right.count()
        result.column_stats = compare_profiles(left, right, diff.common_columns)
        result.data_match = result.row_count_left == result.row_count_right
    elif mode in ("keyed", "sampled"):
        by_key(result, left, right, keys, mode, cfg, partition, diff.common_columns, agreed)
    else:
        raise CompareError(f"unknown compare_mode {mode!r}; there are {', '.join(MODES)}")
    if not (result.schema_match and result.data_match):
        result.status = "MISMATCH"
    return result


def by_key(result: ReconResult, left: DataFrame, right: DataFrame, keys: list[str], mode: str, cfg: ReconConfig, partition: PartitionSpec | None, common: list[str], agreed: dict[str, str]) -> None:
    """Modes keyed and sampled."""
    if not keys:
        raise CompareError(f"compare_mode={mode!r} requires `keys`")
    values = value_columns(common, keys, cfg)
    if mode == "sampled":
        partition = None
    Pair(left, right, keys, values, cfg, agreed)  # keys exist on both sides
    stats: dict = {}
    if cfg.fast_path and partition is None:
        same, info, result.row_count_left, result.row_count_right = fast_path(left, right, keys + values, cfg)
        stats = {"fast_path": info}
        if same:
            result.data_match, result.column_stats = True, stats
            return
    if mode == "sampled":
        sample = sample_keys(left, keys, max(1, int(cfg.sample_size_keyed))).cache()
        try:
            n = sample.count()
            found = compare_keyed(Pair(only_keys(left, sample, keys), only_keys(right, sample, keys), keys, values, cfg, agreed))
        finally:
            sample.unpersist()
        stats = {"sampled": {"requested_keys": max(1, int(cfg.sample_size_keyed)), "actual_keys_sampled": n, "empty_sample": n == 0}} | stats
    elif partition is not None:
        spec = PartitionSpec(partition.column, partition.strategy, partition.buckets, list(partition.boundaries), mapped_name(partition, cfg), partition.max_partitions)
        found = compare_partitioned(Pair(left, right, keys, values, cfg, agreed), spec)
        whole = (left.count(), right.count())
        stats = {"partitioned_by": {"column": partition.column, "strategy": partition.strategy, "n_partitions": len(found.partitions)}, "partitions": [asdict(p) for p in found.partitions]}
        found.row_count_left, found.row_count_right = whole
    else:
        found = compare_keyed(Pair(left, right, keys, values, cfg, agreed))
    fill(result, found)
    result.column_stats = stats
    result.data_match = found.clean()


def mapped_name(partition: PartitionSpec, cfg: ReconConfig) -> str:
    """The right side's partition column under the names it has after align()."""
    back = {r: l for l, r in cfg.column_mapping.items()}
    return back.get(partition.right(), partition.right())


def fill(result: ReconResult, found: KeyedResult) -> None:
    for c in ("row_count_left", "row_count_right", "missing_in_left", "missing_in_right", "changed_rows", "duplicate_keys_left", "duplicate_keys_right"):
        setattr(result, c, getattr(found, c))
    result.sample_mismatches = found.samples


def rename_back(diff: SchemaDiff, cfg: ReconConfig, right: DataFrame) -> SchemaDiff:
    """A schema difference is told in the right side's names, as they are in its files."""
    names = {l: r for l, r in cfg.column_mapping.items() if r in right.columns}
    there = lambda c: c.removesuffix("__right_only") if c.removesuffix("__right_only") in right.columns else c
    out = lambda c: names.get(c, c)
    keyed = lambda d: {out(k): v for k, v in d.items()}
    return SchemaDiff(diff.match, [there(c) for c in diff.missing_in_left], list(diff.missing_in_right), keyed(diff.type_mismatches), [out(c) for c in diff.common_columns], keyed(diff.logical_left), {out(there(k)): v for k, v in diff.logical_right.items()}, keyed(diff.logical_type_mismatches))
