"""A self-contained HTML page: figures, schema differences, a heat map of partitions, example rows."""

from html import escape

from evenkeel.reports.csv import BUCKETS, figures

DETAILS = ("summary", "diff", "full")
STYLE = """body{font:14px/1.4 sans-serif;margin:2em;max-width:75em}table{border-collapse:collapse;margin:.5em 0 1.5em}
td,th{border:1px solid #ccc;padding:.25em .6em;text-align:left}.MATCH{color:#17692f}.MISMATCH,.ERROR{color:#a3161b}"""


def render(result, title: str = "Reconciliation report", detail: str = "full") -> str:
    if detail not in DETAILS:
        raise ValueError(f"detail must be one of {', '.join(DETAILS)}, not {detail!r}")
    body = [f"<h1>{escape(title)}</h1>", f'<p class="{result.status}"><b>{result.status}</b></p>', table(["metric", "value"], list(figures(result))[1:])]
    if detail != "summary":
        body.append(schema(result.schema_diff))
    if detail == "full":
        body.append(heat_map(result.partitions))
        for bucket in BUCKETS:
            if rows := (result.sample_mismatches or {}).get(bucket):
                columns = list(dict.fromkeys(c for row in rows for c in row))
                body += [f"<h2>{bucket.replace('_', ' ')}</h2>", table(columns, [[row.get(c) for c in columns] for row in rows])]
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body>\n' + "\n".join(x for x in body if x) + "\n</body></html>\n"


def table(columns, rows, styles=None) -> str:
    head = "".join(f"<th>{escape(str(c))}</th>" for c in columns)
    lines = []
    for i, row in enumerate(rows):
        style = f' style="{styles[i]}"' if styles else ""
        lines.append(f"<tr{style}>" + "".join(f"<td>{'' if v is None else escape(str(v))}</td>" for v in row) + "</tr>")
    return f"<table><tr>{head}</tr>" + "".join(lines) + "</table>"


def schema(diff) -> str:
    if diff is None:
        return ""
    rows = [(side, c, "", "") for side in ("missing_in_left", "missing_in_right") for c in getattr(diff, side)]
    for what in ("type_mismatches", "logical_type_mismatches"):
        rows += [(what, c, t["left"], t["right"]) for c, t in getattr(diff, what).items()]
    return "<h2>Schema</h2>" + (table(["difference", "column", "left", "right"], rows) if rows else "<p>Schemas match.</p>")


def heat_map(parts) -> str:
    """Partitions from green (none) to red (the largest share of bad rows)."""
    if not parts:
        return ""
    share = [(p["missing_in_left"] + p["missing_in_right"] + p["changed_rows"]) / max(1, p["row_count_left"] + p["row_count_right"]) for p in parts]
    most = max(share) or 1
    columns = list(parts[0])
    return "<h2>Partitions</h2>" + table(columns, [[p[c] for c in columns] for p in parts], [f"background:hsl({120 * (1 - s / most):.0f},70%,88%)" for s in share])
