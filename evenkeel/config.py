"""Settings of a comparison."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from evenkeel.errors import ConfigError


@dataclass
class ReconConfig:
    """How values are normalised, which columns count, and how much is sampled.

    tolerances are absolute and by column, under the left side's name or the right's. column_mapping maps left names to
    right names. sample_limit bounds each bucket of example rows; 0 turns them off.
    """

    trim_strings: bool = False
    case_sensitive: bool = True
    null_equals_empty: bool = False
    decimal_scale: int | None = None
    timestamp_tz: str | None = None
    tolerances: dict[str, float] = field(default_factory=dict)
    columns: list[str] | None = None
    exclude_columns: list[str] = field(default_factory=list)
    column_mapping: dict[str, str] = field(default_factory=dict)
    ignore_column_order: bool = True
    sample_limit: int = 100
    sample_size_keyed: int = 1000
    chunk_size: int = 100_000
    infer_logical_types: bool = True
    infer_sample_size: int = 10_000
    fast_path: bool = True
    row_hash: bool = False

    def with_changes(self, **changes: Any) -> ReconConfig:
        """A copy with the changes that are not None."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ConfigError(f"unknown setting: {', '.join(sorted(unknown))}")
        return replace(self, **{k: v for k, v in changes.items() if v is not None})
