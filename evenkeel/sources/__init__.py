"""Sources, and source() which picks one by a path's extension."""

from __future__ import annotations

from typing import Any
from urllib.parse import urlsplit

from evenkeel.errors import SourceError
from evenkeel.sources.base import DataFrameSource, Source
from evenkeel.sources.databases import JdbcQuery, OdbcQuery, PostgresSource, SqlQuery, SqlTable
from evenkeel.sources.decoded import AvroFile, ExcelFile, MainframeFile, XmlFile
from evenkeel.sources.files import CsvFile, FixedWidthFile, JsonFile, OrcFile, ParquetFile

__all__ = ["AvroFile", "CsvFile", "DataFrameSource", "ExcelFile", "FixedWidthFile", "JdbcQuery", "JsonFile", "MainframeFile", "OdbcQuery", "OrcFile", "ParquetFile", "PostgresSource", "Source", "SqlQuery", "SqlTable", "XmlFile", "source"]

#: By extension: the class, and options that the caller's add to.
EXTENSIONS: dict[str, tuple[type[Source], dict[str, Any]]] = {
    "csv": (CsvFile, {}),
    "tsv": (CsvFile, {"delim": "\t"}),
    "psv": (CsvFile, {"delim": "|"}),
    "txt": (CsvFile, {}),
    "dat": (CsvFile, {}),
    "parquet": (ParquetFile, {}),
    "pq": (ParquetFile, {}),
    "json": (JsonFile, {}),
    "ndjson": (JsonFile, {"format": "newline_delimited"}),
    "jsonl": (JsonFile, {"format": "newline_delimited"}),
    "xml": (XmlFile, {}),
    "xlsx": (ExcelFile, {}),
    "xls": (ExcelFile, {}),
    "avro": (AvroFile, {}),
    "orc": (OrcFile, {}),
}


def source(path: str, *, fixed_width: bool = False, mainframe: bool = False, **settings: Any) -> Source:
    """The source for a path or URL by its extension, or by what it is said to be; settings go to its class."""
    if mainframe or fixed_width:
        return (MainframeFile if mainframe else FixedWidthFile)(path, **settings)
    name = urlsplit(path).path if "://" in path else path
    stem, dot, extension = name.rpartition(".")
    if not dot or extension.lower() not in EXTENSIONS:
        raise SourceError(f"no source for the extension of {path!r}; known: {', '.join(sorted(EXTENSIONS))}, or say fixed_width=True or mainframe=True")
    kind, options = EXTENSIONS[extension.lower()]
    if options:
        settings["options"] = options | settings.get("options", {})
    return kind(path, **settings)
