"""CSV: example rows tagged with their bucket, or the headline figures as metric and value."""

import csv
import io

from evenkeel.result import COUNTERS

BUCKETS = ("missing_in_left", "missing_in_right", "changed")
TAG = "__bucket"


def render(result, layout: str = "diff") -> str:
    if layout not in ("diff", "summary"):
        raise ValueError(f"layout must be 'diff' or 'summary', not {layout!r}")
    out = io.StringIO()
    sheet = csv.writer(out)
    sheet.writerows(differences(result) if layout == "diff" else figures(result))
    return out.getvalue()


def figures(result):
    yield "metric", "value"
    yield from ((n, getattr(result, n)) for n in ("status", "compare_mode"))
    yield "keys", "|".join(result.keys)
    yield from ((n, getattr(result, n)) for n in ("row_count_left", "row_count_right", "schema_match", "data_match", *COUNTERS))
    yield "elapsed_sec", f"{result.execution_metrics.elapsed_sec:.6f}"
    yield "engine", result.execution_metrics.engine
    if result.error:
        yield "error", result.error


def differences(result):
    rows = [{TAG: bucket} | row for bucket in BUCKETS for row in (result.sample_mismatches or {}).get(bucket) or ()]
    columns = list(dict.fromkeys([TAG, *(c for row in rows for c in row)]))
    yield columns
    for row in rows:
        yield ["" if row.get(c) is None else str(row[c]) for c in columns]
