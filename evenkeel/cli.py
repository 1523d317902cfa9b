"""The command line: evenkeel compare --left KIND:PLACE --right KIND:PLACE --keys ..."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable, Sequence
from typing import Any

from evenkeel.config import ReconConfig
from evenkeel.errors import SourceError
from evenkeel.plans.compare import MODES, compare
from evenkeel.result import EXIT_CODES, ReconResult
from evenkeel.sources import AvroFile, CsvFile, ExcelFile, FixedWidthFile, JdbcQuery, JsonFile, OrcFile, ParquetFile, PostgresSource, Source, SqlQuery, SqlTable, XmlFile
from evenkeel.types import PartitionSpec

log = logging.getLogger("evenkeel.cli")


def two(rest: str, kind: str, what: str) -> tuple[str, str]:
    """A place and what follows its last #."""
    place, mark, tail = rest.rpartition("#")
    if not mark:
        raise argparse.ArgumentTypeError(f"a {kind!r} source needs '#{what}'")
    return place, tail


def fixed_columns(text: str) -> list[tuple[str, int, int]]:
    try:
        return [(n.strip(), int(s), int(k)) for n, s, k in (part.split(":") for part in text.split(","))]
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"fixed-width columns are name:start:length,..., not {text!r}") from e


#: By kind, a source from what follows the first colon.
KINDS: dict[str, Callable[[str], Source]] = {
    "csv": CsvFile,
    "tsv": lambda rest: CsvFile(rest, {"delim": "\t"}),
    "psv": lambda rest: CsvFile(rest, {"delim": "|"}),
    "parquet": ParquetFile,
    "json": JsonFile,
    "orc": OrcFile,
    "avro": AvroFile,
    "xml": lambda rest: XmlFile(*two(rest, "xml", "record-path")) if "#" in rest else XmlFile(rest),
    "excel": lambda rest: ExcelFile(*two(rest, "excel", "sheet")) if "#" in rest else ExcelFile(rest),
    "fixedwidth": lambda rest: FixedWidthFile(two(rest, "fixedwidth", "columns")[0], fixed_columns(rest.rpartition("#")[2])),
    "sqltable": lambda rest: SqlTable(*two(rest, "sqltable", "table")),
    "sqlquery": lambda rest: SqlQuery(*two(rest, "sqlquery", "query")),
    "postgres": lambda rest: PostgresSource(*two(rest, "postgres", "table")),
    "postgres-query": lambda rest: PostgresSource(two(rest, "postgres-query", "query")[0], query=rest.rpartition("#")[2]),
    "jdbc": lambda rest: JdbcQuery(two(rest, "jdbc", "query")[0], query=rest.rpartition("#")[2]),
}
KINDS |= {"fixed": KINDS["fixedwidth"], "postgresquery": KINDS["postgres-query"]}
REPORTS = {"html": ReconResult.to_html, "junit": ReconResult.to_junit, "json": ReconResult.to_json, "csv": ReconResult.to_csv, "text": ReconResult.to_text}


def parse_source(text: str) -> Source:
    kind, colon, rest = text.partition(":")
    kind = kind.strip().lower()
    if not colon or kind not in KINDS:
        raise argparse.ArgumentTypeError(f"a source is KIND:PLACE with a KIND of {', '.join(sorted(KINDS))}, not {text!r}")
    try:
        return KINDS[kind](rest)
    except SourceError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def number(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text.strip())
        except ValueError:
            pass
    return text.strip()


def parse_tolerance(text: str) -> tuple[str, float]:
    column, equals, value = text.partition("=")
    if not equals or not isinstance(number(value), int | float):
        raise argparse.ArgumentTypeError(f"a tolerance is column=number, not {text!r}")
    return column.strip(), float(value)


def parse_partition(text: str) -> PartitionSpec:
    column, _, rest = text.partition(":")
    strategy, _, args = rest.partition(":")
    try:
        match strategy or "value":
            case "value":
                return PartitionSpec(column)
            case "hash":
                return PartitionSpec(column, "hash", buckets=int(args or 16))
            case "range":
                return PartitionSpec(column, "range", boundaries=[(number(lo), number(hi)) for lo, hi in (r.split(",") for r in args.split(";"))])
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"cannot read partition {text!r}") from e
    raise argparse.ArgumentTypeError(f"unknown partition strategy {strategy!r}")


def parse_report(text: str) -> tuple[str, str]:
    kind, colon, path = text.partition(":")
    if not colon or not path or kind.strip().lower() not in REPORTS:
        raise argparse.ArgumentTypeError(f"a report is FORMAT:PATH with a FORMAT of {', '.join(REPORTS)}, not {text!r}")
    return kind.strip().lower(), path


def names(text: str) -> list[str]:
    return [n.strip() for n in text.split(",") if n.strip()]


#: For --left-type and the like: the flags that each kind needs, and its source.
LEGACY: dict[str, tuple[tuple[str, ...], Callable[..., Source]]] = {
    "csv": (("path",), CsvFile),
    "parquet": (("path",), ParquetFile),
    "json": (("path",), JsonFile),
    "excel": (("path",), ExcelFile),
    "sqltable": (("conn", "table"), SqlTable),
    "sqlquery": (("conn", "query"), SqlQuery),
    "postgres": (("conn", "table"), PostgresSource),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evenkeel", description="Compare two datasets.")
    p = top.add_subparsers(dest="command", required=True).add_parser("compare", help="compare two sources")
    for side in ("left", "right"):
        p.add_argument(f"--{side}", type=parse_source, metavar="KIND:PLACE")
        p.add_argument(f"--{side}-type", choices=sorted(LEGACY), help=argparse.SUPPRESS)
        for flag in ("path", "conn", "table", "query"):
            p.add_argument(f"--{side}-{flag}", help=argparse.SUPPRESS)
    p.add_argument("--keys", "-k", type=names, action="extend", default=[], help="key columns; may be repeated, or have commas")
    p.add_argument("--columns", type=names)
    p.add_argument("--exclude", type=names)
    p.add_argument("--tolerance", type=parse_tolerance, action="append", default=[], metavar="COLUMN=NUMBER")
    p.add_argument("--partition", type=parse_partition, metavar="COLUMN[:STRATEGY[:ARGS]]")
    p.add_argument("--mode", type=str.lower, choices=MODES, default="keyed")
    p.add_argument("--sample-limit", type=int, default=10)
    p.add_argument("--hash-only", action="store_true", help="the same as --mode hash")
    p.add_argument("--row-hash", action="store_true", help="compare rows by one hash")
    p.add_argument("--report", type=parse_report, action="append", default=[], metavar="FORMAT:PATH")
    for kind in ("html", "junit", "json"):
        p.add_argument(f"--{kind}", help=argparse.SUPPRESS)
    p.add_argument("--fail-on", type=str.lower, choices=("never", "mismatch", "error"), default="mismatch")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--verbose", "-v", action="store_true")
    return top


def side_of(p: argparse.ArgumentParser, args: argparse.Namespace, side: str) -> Source:
    if (given := getattr(args, side)) is not None:
        return given
    kind = getattr(args, f"{side}_type")
    if not kind:
        p.error(f"--{side} is missing")
    flags, make = LEGACY[kind]
    values = [getattr(args, f"{side}_{f}") for f in flags]
    for flag, value in zip(flags, values, strict=True):
        if not value:
            p.error(f"--{side}-type {kind} needs --{side}-{flag}")
    return make(*values)


def exit_code(result: ReconResult, fail_on: str) -> int:
    if fail_on == "never":
        return 0
    code = EXIT_CODES.get(result.status, 1)
    return code if fail_on == "mismatch" or result.status == "ERROR" else 0


def main(argv: Sequence[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in ("compare", "-h", "--help"):
        argv.insert(0, "compare")
    p = parser()
    try:
        args = p.parse_args(argv)
        sides = [side_of(p, args, side) for side in ("left", "right")]
    except SystemExit as e:
        return int(e.code or 0)
    level = "INFO" if args.verbose else os.environ.get("EVENKEEL_LOG_LEVEL", "WARNING").upper()
    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("evenkeel").setLevel(level if level in logging.getLevelNamesMapping() else "WARNING")
    config = ReconConfig(sample_limit=args.sample_limit, row_hash=args.row_hash)
    result = compare(*sides, keys=args.keys, compare_mode="hash" if args.hash_only else args.mode, columns=args.columns, exclude_columns=args.exclude, tolerances=dict(args.tolerance), partition=args.partition, config=config)
    for part in result.partitions:
        log.info("partition %s: left %s, right %s, missing %s/%s, changed %s", part["partition"], part["row_count_left"], part["row_count_right"], part["missing_in_left"], part["missing_in_right"], part["changed_rows"])
    if not args.quiet:
        print(result.summary())
    for kind, path in [*args.report, *((k, getattr(args, k)) for k in ("html", "junit", "json") if getattr(args, k))]:
        REPORTS[kind](result, path)
    return exit_code(result, args.fail_on)


if __name__ == "__main__":
    sys.exit(main())
