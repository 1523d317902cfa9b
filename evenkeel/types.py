"""What comparisons are made of and give back."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class SchemaDiff:
    match: bool
    missing_in_left: list[str] = field(default_factory=list)
    missing_in_right: list[str] = field(default_factory=list)
    type_mismatches: dict[str, dict[str, str]] = field(default_factory=dict)
    common_columns: list[str] = field(default_factory=list)
    logical_left: dict[str, str] = field(default_factory=dict)
    logical_right: dict[str, str] = field(default_factory=dict)
    logical_type_mismatches: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass
class ExecutionMetrics:
    elapsed_sec: float = 0.0
    engine: str = "spark"
    bytes_scanned: int | None = None


@dataclass
class PartitionSpec:
    """Slices of a keyed comparison: by value, by hash bucket, or by half-open (lo, hi) ranges of a column."""

    column: str
    strategy: str = "value"
    buckets: int = 16
    boundaries: list[tuple[Any, Any]] = field(default_factory=list)
    right_column: str | None = None
    max_partitions: int | None = 1000

    def right(self) -> str:
        return self.right_column or self.column


@dataclass
class PartitionResult:
    partition: Any
    row_count_left: int = 0
    row_count_right: int = 0
    missing_in_left: int = 0
    missing_in_right: int = 0
    changed_rows: int = 0
    duplicate_keys_left: int = 0
    duplicate_keys_right: int = 0
    match: bool = True


@dataclass
class HashCompareResult:
    match: bool
    left_checksum: str
    right_checksum: str
    columns_hashed: list[str] = field(default_factory=list)
    algo: str = "xxhash64"


@dataclass
class KeyedResult:
    """Counters and example rows of a keyed comparison."""

    row_count_left: int = 0
    row_count_right: int = 0
    missing_in_left: int = 0
    missing_in_right: int = 0
    changed_rows: int = 0
    duplicate_keys_left: int = 0
    duplicate_keys_right: int = 0
    samples: dict[str, list[dict[str, Any]]] = field(default_factory=dict)
    partitions: list[PartitionResult] = field(default_factory=list)

    def clean(self) -> bool:
        counters = (self.missing_in_left, self.missing_in_right, self.changed_rows, self.duplicate_keys_left, self.duplicate_keys_right)
        return not any(counters) and self.row_count_left == self.row_count_right
