"""The result of a comparison."""

from __future__ import annotations

import datetime
import decimal
import json
import math
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from evenkeel.types import ExecutionMetrics, SchemaDiff

EXIT_CODES = {"MATCH": 0, "MISMATCH": 1, "ERROR": 2}
#: The counters in the order in which all reports show them.
COUNTERS = ("missing_in_left", "missing_in_right", "changed_rows", "duplicate_keys_left", "duplicate_keys_right")


@dataclass
class ReconResult:
    status: str
    row_count_left: int = 0
    row_count_right: int = 0
    schema_match: bool = False
    data_match: bool = False
    missing_in_left: int = 0
    missing_in_right: int = 0
    changed_rows: int = 0
    duplicate_keys_left: int = 0
    duplicate_keys_right: int = 0
    schema_diff: SchemaDiff | None = None
    column_stats: dict[str, Any] = field(default_factory=dict)
    sample_mismatches: dict[str, list[dict[str, Any]]] = field(default_factory=dict)
    execution_metrics: ExecutionMetrics = field(default_factory=ExecutionMetrics)
    error: str | None = None
    compare_mode: str = "keyed"
    keys: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return EXIT_CODES.get(self.status, 1)

    @property
    def partitions(self) -> list[dict[str, Any]]:
        return (self.column_stats or {}).get("partitions") or []

    def to_dict(self) -> dict[str, Any]:
        return plain(asdict(self))

    def to_json(self, path: str | None = None, indent: bool = False) -> str:
        layout = {"indent": 2} if indent else {"separators": (",", ":")}
        return kept(json.dumps(self.to_dict(), ensure_ascii=False, **layout), path)

    def to_html(self, path: str | None = None, title: str = "Reconciliation report", detail: str = "full") -> str:
        from evenkeel.reports.html import render

        return kept(render(self, title, detail), path)

    def to_csv(self, path: str | None = None, layout: str = "diff") -> str:
        from evenkeel.reports.csv import render

        return kept(render(self, layout), path)

    def to_text(self, path: str | None = None, detail: str = "diff") -> str:
        from evenkeel.reports.text import render

        return kept(render(self, detail), path)

    def to_junit(self, path: str | None = None, suite_name: str = "evenkeel") -> str:
        from evenkeel.reports.junit import render

        return kept(render(self, suite_name), path)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row: status, counts, flags and counters."""
        row = (self.status, self.row_count_left, self.row_count_right, self.schema_match, self.data_match, *(getattr(self, c) for c in COUNTERS))
        schema = "status string, row_count_left long, row_count_right long, schema_match boolean, data_match boolean, " + ", ".join(f"{c} long" for c in COUNTERS)
        return spark.createDataFrame([row], schema)

    def summary(self) -> str:
        lines = [("status", self.status), ("compare_mode", self.compare_mode), ("row_count_left", f"{self.row_count_left:,}"), ("row_count_right", f"{self.row_count_right:,}")]
        lines += [("schema_match", self.schema_match), ("data_match", self.data_match), *((c, f"{getattr(self, c):,}") for c in COUNTERS)]
        lines += [("elapsed_sec", f"{self.execution_metrics.elapsed_sec:.3f}"), ("engine", self.execution_metrics.engine)]
        lines += [("error", self.error)] if self.error else []
        out = [f"{name:<21}: {value}" for name, value in lines]
        if drift := self.drift():
            out += ["", "schema_diff:", *drift]
        return "\n".join(out)

    def drift(self) -> list[str]:
        """What differs between the schemas, a line each."""
        d = self.schema_diff
        if d is None:
            return []
        out = [f"  {side:<21}: {', '.join(names)}" for side, names in (("missing_in_left", d.missing_in_left), ("missing_in_right", d.missing_in_right)) if names]
        if d.logical_type_mismatches:
            out += ["  logical_type_mismatches:", *(f"    {c}: left={t['left']} right={t['right']}" for c, t in d.logical_type_mismatches.items())]
        return out


def kept(text: str, path: str | None) -> str:
    if path:
        Path(path).write_bytes(text.encode("utf-8"))
    return text


def plain(value: Any) -> Any:
    """A value with only what JSON has; numbers that are none become null."""
    match value:
        case dict():
            return {str(k): plain(v) for k, v in value.items()}
        case list() | tuple():
            return [plain(v) for v in value]
        case decimal.Decimal():
            return float(value)
        case float() if not math.isfinite(value):
            return None
        case datetime.date() | datetime.time():
            return value.isoformat()
        case datetime.timedelta():
            return value.total_seconds()
        case bytes() | bytearray():
            return bytes(value).decode("utf-8", "replace")
        case _:
            return value
