"""Files that Spark's own readers take: CSV and kin, Parquet, JSON, ORC, fixed-width text."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.errors import SourceError
from evenkeel.functions.names import named
from evenkeel.sources.base import Source, spark_path

#: CSV options by the names that callers use, and Spark's names for them.
CSV_OPTIONS = {"delim": "sep", "delimiter": "sep", "sep": "sep", "quote": "quote", "escape": "escape", "header": "header", "nullstr": "nullValue", "null_value": "nullValue", "encoding": "encoding", "comment": "comment", "dateformat": "dateFormat", "timestampformat": "timestampFormat", "ignore_errors": "mode", "all_varchar": "inferSchema", "auto_detect": "inferSchema", "sample_size": "samplingRatio", "max_line_size": "maxCharsPerColumn", "decimal_separator": "locale", "skip": "skip"}


def head_lines(spark: SparkSession, path: str, n: int = 20) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The delimiter of delimited text, told from its first lines; a comma if nothing tells."""
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=",;|\t").delimiter
    except csv.Error:
        return max(",\t;|", key=lambda d: lines[0].count(d)) if lines else ","


@dataclass
class CsvFile(Source):
    """Delimited text with a header unless options say otherwise; the delimiter is found if not given. Types are inferred."""

    path: str
    options: dict[str, Any] = field(default_factory=dict)
    keep = True

    def load(self, spark: SparkSession) -> DataFrame:
        path, skip = spark_path(self.path), 0
        out: dict[str, Any] = {"header": True, "inferSchema": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "preferDate": True}
        for name, value in self.options.items():
            target = CSV_OPTIONS.get(name.lower())
            if target is None:
                raise SourceError(f"unknown CSV option {name!r}; known: {', '.join(sorted(CSV_OPTIONS))}")
            if target == "skip":
                skip = int(value)
            elif name == "ignore_errors":
                out["mode"] = "DROPMALFORMED" if value else "FAILFAST"
            elif name == "all_varchar":
                out["inferSchema"] = not value
            elif name == "sample_size":
                out["inferSchema"] = True  # all rows are looked at, so that types hold
            elif name == "decimal_separator":
                out["locale"] = "de-DE" if value == "," else "en-US"
            else:
                out[target] = value
        if "sep" not in out:
            out["sep"] = sniff_delimiter(head_lines(spark, path)[skip:])
        if skip:
            rows = drop_first_lines(spark.read.text(path).select("value", "_metadata"), skip)
            return spark.read.options(**out).csv(rows.select("value").rdd.map(lambda r: r[0]))
        return spark.read.options(**out).csv(path)


def drop_first_lines(lines: DataFrame, n: int) -> DataFrame:
    """lines (value, _metadata) without the first n of each file: those in the file's first split are numbered in its order."""
    first = F.col("_metadata.file_block_start") == 0
    order = Window.partitionBy("_metadata.file_path").orderBy("__row")
    rows = lines.withColumn("__row", F.monotonically_increasing_id())
    opening = rows.where(first).withColumn("__number", F.row_number().over(order)).where(F.col("__number") > n).drop("__number")
    return opening.unionByName(rows.where(~first)).drop("__row")


@dataclass
class ParquetFile(Source):
    """Parquet files: a path, a glob, or a folder, with its Hive partitions."""

    path: str

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(spark_path(self.path))


@dataclass
class OrcFile(Source):
    path: str
    columns: list[str] | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        df = spark.read.orc(spark_path(self.path))
        return df.select(*map(named, self.columns)) if self.columns else df


@dataclass
class JsonFile(Source):
    """JSON lines, or one array of objects; options: format ("newline_delimited", "array" or "auto") and Spark's own."""

    path: str
    options: dict[str, Any] = field(default_factory=dict)
    keep = True

    def load(self, spark: SparkSession) -> DataFrame:
        path, options = spark_path(self.path), dict(self.options)
        layout = options.pop("format", "auto")
        if layout not in ("auto", "array", "newline_delimited"):
            raise SourceError(f"unknown JSON format {layout!r}")
        if layout == "auto":
            first = next((line.strip() for line in head_lines(spark, path) if line.strip()), "")
            layout = "array" if first.startswith("[") else "newline_delimited"
        return spark.read.options(mode="FAILFAST", multiLine=layout == "array", **options).json(path)


@dataclass
class FixedWidthFile(Source):
    """Text columns cut from each line at 1-based places (name, start, length), which may overlap. All are strings, kept as they stand unless trim_values."""

    path: str
    columns: Sequence[tuple[str, int, int]] = ()
    skip_rows: int = 0
    trim_values: bool = False
    encoding: str = "utf-8"

    def __post_init__(self):
        if not self.columns:
            raise SourceError("a fixed-width file needs columns=[(name, start, length), ...]")
        for name, start, length in self.columns:
            if int(start) < 1 or int(length) < 1:
                raise SourceError(f"fixed-width column {name!r}: start and length count from 1, not {start} and {length}")

    def load(self, spark: SparkSession) -> DataFrame:
        lines = spark.read.text(spark_path(self.path))
        if self.skip_rows > 0:
            lines = drop_first_lines(lines.select("value", "_metadata"), self.skip_rows)
        return lines.select(*(carve(F.col("value"), start, length, self.trim_values).alias(name) for name, start, length in self.columns))


def carve(line, start: int, length: int, trim: bool = False):
    piece = F.substring(line, int(start), int(length))
    return F.trim(piece) if trim else piece
