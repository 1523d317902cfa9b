"""Plain text with fixed-width sections."""

from evenkeel.reports.csv import BUCKETS, figures

WIDEST = 40
DETAILS = ("summary", "diff", "full")


def render(result, detail: str = "diff") -> str:
    if detail not in DETAILS:
        raise ValueError(f"detail must be one of {', '.join(DETAILS)}, not {detail!r}")
    rows = [(n, f"{v:,}" if type(v) is int else v) for n, v in list(figures(result))[1:]]
    width = max(len(n) for n, _ in rows)
    parts = ["=" * 72, f"  Reconciliation report: {result.status}", "=" * 72, *(f"  {n:<{width}} : {v}" for n, v in rows)]
    if detail != "summary":
        parts += ["", *(["Schema diff", "-" * 72, *result.drift()] if result.drift() else ["Schema diff: schemas match." if result.schema_diff else "Schema diff: not made."])]
        for bucket in BUCKETS:
            if found := (result.sample_mismatches or {}).get(bucket):
                parts += ["", f"{bucket.replace('_', ' ').title()} ({len(found)} sample row{'s' * (len(found) != 1)})", "-" * 72, table(found)]
    if detail == "full" and result.partitions:
        parts += ["", "Partitions", "-" * 72, table(result.partitions)]
    return "\n".join(parts) + "\n"


def cell(value) -> str:
    text = "" if value is None else " ".join(str(value).split("\n"))
    return text if len(text) <= WIDEST else text[: WIDEST - 1] + "…"


def table(rows) -> str:
    columns = list(dict.fromkeys(c for row in rows for c in row))
    grid = [columns, *([cell(row.get(c)) for c in columns] for row in rows)]
    widths = [max(len(line[i]) for line in grid) for i in range(len(columns))]
    lines = ["  " + "  ".join(f"{v:<{w}}" for v, w in zip(line, widths, strict=True)).rstrip() for line in grid]
    return "\n".join([lines[0], "  " + "  ".join("-" * w for w in widths), *lines[1:]])
