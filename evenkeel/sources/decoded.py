"""Files that need decoding in Python: XML paths, Avro, mainframe records, Excel sheets. One file is one task's work, or one record's."""

from __future__ import annotations

import decimal
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Any
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evenkeel.errors import SourceError
from evenkeel.sources.base import Source, spark_path


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(spark_path(path)).select("content")


def decoded(files: DataFrame, names: list[str], types: list[T.DataType], rows_of) -> DataFrame:
    """A row for each tuple that rows_of makes of a file's bytes, in batches of bounded length."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for content in batch.column(0):
                for row in rows_of(content.as_py()):
                    held.append(row)
                    if len(held) >= 5000:
                        yield as_batch(held)
                        held = []
        yield as_batch(held)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.mapInArrow(run, schema)


# ---- XML


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def text_of(element: ET.Element | None) -> str | None:
    return ((element.text or "").strip() or None) if element is not None else None


@dataclass
class XmlFile(Source):
    """Records at record_path; columns maps names to paths below a record (@name is an attribute). Without columns: attributes as @name and the text of direct children. All strings."""

    path: str
    record_path: str = "."
    columns: dict[str, str] | None = None
    namespaces: dict[str, str] = field(default_factory=dict)
    encoding: str | None = None
    keep = True

    def __post_init__(self):
        if self.columns is not None and not self.columns:
            raise SourceError("XML columns may not be empty; leave them out to find them")
        if not self.record_path:
            raise SourceError("an XML file needs a record_path")

    def records(self, content: bytes) -> list[ET.Element]:
        root = ET.fromstring(content.decode(self.encoding) if self.encoding else content)
        path = self.record_path.strip()
        if path in (".", "/"):
            return [root]
        path = path.removeprefix("/" + local(root.tag)).lstrip("/") if path.startswith("/") and not path.startswith("//") else path
        plain = path.removeprefix("./").removeprefix("//")
        if re.fullmatch(r"[\w.-]+", plain):  # one name: wherever it stands
            return [e for e in root.iter() if local(e.tag) == plain]
        return root.findall("." + path if path.startswith("//") else path, self.namespaces)

    def value(self, record: ET.Element, path: str) -> str | None:
        path, _, attribute = path.rpartition("@") if "@" in path else (path, "", "")
        element = record if path.rstrip("/") in ("", ".") else record.find(path.rstrip("/"), self.namespaces)
        return (element.get(attribute) if element is not None else None) if attribute else text_of(element)

    def fields(self, record: ET.Element) -> dict[str, str | None]:
        if self.columns is not None:
            return {name: self.value(record, path) for name, path in self.columns.items()}
        return {f"@{local(k)}": v for k, v in record.attrib.items()} | {local(e.tag): text_of(e) for e in record}

    def load(self, spark: SparkSession) -> DataFrame:
        files = binary_files(spark, self.path)
        if self.columns is not None:
            names = list(self.columns)
        else:
            seen = decoded(files, ["name"], [T.StringType()], lambda content: [(n,) for n in dict.fromkeys(n for r in self.records(content) for n in self.fields(r))])
            names = list(dict.fromkeys(r[0] for r in seen.collect()))  # a few names a file
            if not names:
                raise SourceError(f"no records at {self.record_path!r} in {self.path}")
        return decoded(files, names, [T.StringType()] * len(names), lambda content: [tuple(map(self.fields(r).get, names)) for r in self.records(content)])


# ---- Avro


class AvroReader:
    """Rows of an Avro object container file: primitives, logical dates and times, unions, arrays, maps, nested records."""

    def __init__(self, content: bytes):
        self.data, self.at, self.known = content, 0, {}
        if self.take(4) != b"Obj\x01":
            raise SourceError("not an Avro object container file")
        meta = self.map(lambda: self.bytes())
        self.schema = json.loads(meta["avro.schema"])
        self.codec = meta.get("avro.codec", b"null").decode()
        if self.codec not in ("null", "deflate"):
            raise SourceError(f"Avro codec {self.codec!r} is not supported; null and deflate are")
        self.marker = self.take(16)
        self.learn(self.schema)

    def take(self, n: int) -> bytes:
        piece = self.data[self.at : self.at + n]
        if len(piece) != n:
            raise SourceError("the Avro file ends early")
        self.at += n
        return piece

    def long(self) -> int:
        shift = value = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return (value >> 1) ^ -(value & 1)

    def bytes(self) -> bytes:
        return self.take(self.long())

    def blocks(self, one):
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            for _ in range(n):
                yield one()

    def map(self, value) -> dict:
        return dict(self.blocks(lambda: (self.bytes().decode(), value())))

    def learn(self, schema) -> None:
        if isinstance(schema, list):
            for s in schema:
                self.learn(s)
        elif isinstance(schema, dict):
            if "name" in schema:
                self.known[schema["name"]] = schema
                if "namespace" in schema:
                    self.known[f"{schema['namespace']}.{schema['name']}"] = schema
            for inner in [schema.get("items"), schema.get("values"), *(f["type"] for f in schema.get("fields", ()))]:
                self.learn(inner)

    def read(self, schema):
        if isinstance(schema, list):
            return self.read(schema[self.long()])
        logical = schema.get("logicalType") if isinstance(schema, dict) else None
        kind = schema["type"] if isinstance(schema, dict) else schema
        if isinstance(kind, dict | list):
            return self.read(kind)
        match kind:
            case "null":
                return None
            case "boolean":
                return self.take(1) == b"\x01"
            case "int" | "long":
                return dated(self.long(), logical)
            case "float":
                return struct.unpack("<f", self.take(4))[0]
            case "double":
                return struct.unpack("<d", self.take(8))[0]
            case "bytes" | "fixed":
                raw = self.bytes() if kind == "bytes" else self.take(schema["size"])
                return decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-schema.get("scale", 0)) if logical == "decimal" else raw
            case "string":
                return self.bytes().decode()
            case "enum":
                return schema["symbols"][self.long()]
            case "array":
                return list(self.blocks(lambda: self.read(schema["items"])))
            case "map":
                return self.map(lambda: self.read(schema["values"]))
            case "record" | "error":
                return {f["name"]: self.read(f["type"]) for f in schema["fields"]}
            case _:
                if kind not in self.known:
                    raise SourceError(f"unknown Avro type {kind!r}")
                return self.read(self.known[kind])

    def rows(self) -> Iterator[dict]:
        whole = self.data, len(self.data)
        while self.at < whole[1]:
            n, block = self.long(), self.bytes()
            marker = self.take(16)
            if marker != self.marker:
                raise SourceError("an Avro block does not end with the file's marker")
            back, self.data, self.at = self.at, zlib.decompress(block, -15) if self.codec == "deflate" else block, 0
            for _ in range(n):
                yield self.read(self.schema)
            self.data, self.at = whole[0], back


def dated(value: int, logical: str | None):
    match logical:
        case "date":
            return date(1970, 1, 1) + timedelta(value)
        case "timestamp-millis" | "local-timestamp-millis":
            return datetime(1970, 1, 1) + timedelta(milliseconds=value)
        case "timestamp-micros" | "local-timestamp-micros":
            return datetime(1970, 1, 1) + timedelta(microseconds=value)
        case "timestamp-nanos" | "local-timestamp-nanos":  # Spark's timestamps count microseconds
            return datetime(1970, 1, 1) + timedelta(microseconds=value // 1000)
        case _:
            return value


def avro_type(schema, known: dict) -> T.DataType:
    """The Spark type of an Avro type; a union of more than one type besides null is a string."""
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        return avro_type(rest[0], known) if len(rest) == 1 else T.StringType()
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, dict | list):
        return avro_type(kind, known)
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if logical == "date":
        return T.DateType()
    if logical and "timestamp" in logical:
        return T.TimestampNTZType()
    simple = {"null": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "fixed": T.BinaryType(), "string": T.StringType(), "enum": T.StringType()}
    if kind in simple:
        return simple[kind]
    if kind == "array":
        return T.ArrayType(avro_type(schema["items"], known))
    if kind == "map":
        return T.MapType(T.StringType(), avro_type(schema["values"], known))
    if kind in ("record", "error"):
        return T.StructType([T.StructField(f["name"], avro_type(f["type"], known)) for f in schema["fields"]])
    return avro_type(known[kind], known)


def as_string(value: Any) -> str | None:
    if isinstance(value, bytes):
        try:
            return value.decode()
        except UnicodeDecodeError:
            return value.hex()
    return None if value is None else str(value)


def unwrapped(value: Any) -> Any:
    """The value in a one-entry {type: value}, as some writers leave a union."""
    if isinstance(value, dict) and len(value) == 1:
        name = next(iter(value))
        if name in ("boolean", "int", "long", "float", "double", "bytes", "string") or "." in name:
            return value[name]
    return value


@dataclass
class AvroFile(Source):
    path: str
    batch_size: int = 5000
    flatten_unions: bool = True
    keep = True

    def load(self, spark: SparkSession) -> DataFrame:
        files = binary_files(spark, self.path)
        first = files.limit(1).collect()
        if not first:
            raise SourceError(f"no Avro file at {self.path}")
        reader = AvroReader(bytes(first[0][0]))
        names = [f["name"] for f in reader.schema["fields"]]
        types = [avro_type(f["type"], reader.known) for f in reader.schema["fields"]]
        texts = {n for n, t in zip(names, types, strict=True) if isinstance(t, T.StringType)}
        flat = unwrapped if self.flatten_unions else lambda v: v
        return decoded(files, names, types, lambda content: (tuple(as_string(flat(r[n])) if n in texts else flat(r[n]) for n in names) for r in AvroReader(bytes(content)).rows()))


# ---- Mainframe records

#: Signs of packed and zoned numbers, by the sign half-byte.
PLUS, MINUS = frozenset((0xC, 0xF, 0xA, 0xE)), frozenset((0xD, 0xB))


def signed(digits: list[int], sign: int, scale: int) -> decimal.Decimal | None:
    if not digits or any(d > 9 for d in digits) or sign not in PLUS | MINUS:
        return None
    return decimal.Decimal((int(sign in MINUS), tuple(digits), -scale))


def packed(raw: bytes, scale: int = 0) -> decimal.Decimal | None:
    """A packed decimal: two digits a byte, the sign in the last half-byte. What is not one is None."""
    halves = [h for b in raw for h in (b >> 4, b & 15)]
    return signed(halves[:-1], halves[-1], scale) if halves else None


def zoned(raw: bytes, scale: int = 0, encoding: str = "cp037") -> decimal.Decimal | None:
    """A zoned decimal: digits of the encoding, and in the last byte a digit in the low half, the sign in the high half. What is not one is None."""
    body = raw[:-1].decode(encoding, "replace")
    if not raw or re.search("[^0-9]", body):
        return None
    return signed([*map(int, body), raw[-1] & 15], raw[-1] >> 4, scale)


@dataclass
class MainframeFile(Source):
    """Records of fixed length, or lines. fields: dicts with name, start (from 1), length, and type text, int, comp3, zoned or binary; comp3 and zoned take scale."""

    path: str
    fields: list[dict[str, Any]] = field(default_factory=list)
    record_length: int | None = None
    encoding: str = "cp037"
    skip_bytes: int = 0
    chunk_records: int = 10_000
    trim: bool = True
    keep = True

    KINDS = {"text": "text", "string": "text", "int": "int", "comp3": "packed", "packed": "packed", "zoned": "zoned", "binary": "binary", "comp": "binary", "comp4": "binary"}

    def __post_init__(self):
        if not self.fields:
            raise SourceError("a mainframe file needs fields")
        for f in self.fields:
            if not {"name", "start", "length"} <= f.keys() or int(f["start"]) < 1 or int(f["length"]) < 1:
                raise SourceError(f"mainframe field {f.get('name')!r} needs a name, and start and length from 1")
            if f.get("type", "text").lower() not in self.KINDS:
                raise SourceError(f"unknown mainframe field type {f['type']!r}")
            if self.record_length and int(f["start"]) + int(f["length"]) - 1 > self.record_length:
                raise SourceError(f"mainframe field {f['name']!r} runs over the record's end")
        if self.record_length is not None and self.record_length < 1:
            raise SourceError("record_length must be at least 1")

    def kind(self, f: dict) -> str:
        return self.KINDS[f.get("type", "text").lower()]

    def spark_type(self, f: dict) -> T.DataType:
        kind, scale = self.kind(f), int(f.get("scale", 0))
        if kind in ("packed", "zoned"):
            digits = 2 * int(f["length"]) - 1 if kind == "packed" else int(f["length"])
            return T.DecimalType(min(38, max(digits, scale, 1)), scale)
        return T.LongType() if kind in ("int", "binary") else T.StringType()

    def value(self, raw: bytes, f: dict):
        kind, scale = self.kind(f), int(f.get("scale", 0))
        try:
            if kind in ("packed", "zoned"):
                number = packed(raw, scale) if kind == "packed" else zoned(raw, scale, self.encoding)
                return number if number is None or number.adjusted() < 38 - scale else None
            if kind == "binary":
                return int.from_bytes(raw, "big", signed=True) if 0 < len(raw) <= 8 else None
            text = raw.decode(self.encoding, "replace")
            if kind == "int":
                number = int(text.strip()) if re.fullmatch(r"[+-]?[0-9]{1,25}", text.strip()) else None
                return number if number is not None and -(1 << 63) <= number < 1 << 63 else None
            return text.strip() if self.trim else text
        except (ValueError, LookupError, decimal.DecimalException):
            return None

    def records(self, content: bytes) -> Iterator[bytes]:
        data = content[self.skip_bytes :]
        if self.record_length:
            yield from (data[i : i + self.record_length] for i in range(0, len(data) - self.record_length + 1, self.record_length))
        else:
            yield from (line for line in re.split(rb"\r?\n", data) if line.strip())

    def row(self, record: bytes) -> tuple:
        return tuple(self.value(record[int(f["start"]) - 1 : int(f["start"]) - 1 + int(f["length"])], f) for f in self.fields)

    def load(self, spark: SparkSession) -> DataFrame:
        names, types = [f["name"] for f in self.fields], [self.spark_type(f) for f in self.fields]
        return decoded(binary_files(spark, self.path), names, types, lambda content: map(self.row, self.records(bytes(content))))


# ---- Excel

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))


def column_number(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


class Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        xml = lambda name: ET.fromstring(self.zip.read(name))
        book = xml("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        self.sheets = {s.get("name"): "xl/" + targets[s.get(_LINK)].removeprefix("/xl/") for s in book.iter(f"{_MAIN}sheet")}
        self.shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in xml("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            formats = styles.find(f"{_MAIN}cellXfs")
            self.dates = [int(x.get("numFmtId", 0)) in _DATE_FORMATS | own for x in (formats if formats is not None else ())]

    def cell(self, c: ET.Element):
        kind, v = c.get("t"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind in ("str", "e", "d"):
            return v.text if kind != "e" else None
        number = float(v.text)
        style = int(c.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return datetime(1899, 12, 30) + timedelta(days=number)
        return int(number) if number.is_integer() and abs(number) < 2**53 else number

    def rows(self, sheet: str | None) -> list[list]:
        name = next(iter(self.sheets)) if sheet is None else sheet
        if name not in self.sheets:
            raise SourceError(f"no sheet {name!r}; there are {', '.join(self.sheets)}")
        out = []
        for row in ET.fromstring(self.zip.read(self.sheets[name])).iter(f"{_MAIN}row"):
            cells: dict[int, Any] = {}
            for c in row.iter(f"{_MAIN}c"):
                cells[column_number(c.get("r")) if c.get("r") else len(cells)] = self.cell(c)
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def common_type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    for types, out in (({bool}, T.BooleanType()), ({int}, T.LongType()), ({int, float}, T.DoubleType()), ({datetime}, T.TimestampNTZType())):
        if kinds and kinds <= types:
            return out
    return T.StringType()


@dataclass
class ExcelFile(Source):
    """A sheet (the first by default) of a workbook, which by its format has at most 1,048,576 rows; it is read on the driver."""

    path: str
    sheet: str | None = None
    has_header: bool = True

    def load(self, spark: SparkSession) -> DataFrame:
        found = binary_files(spark, self.path).limit(1).collect()
        if not found:
            raise SourceError(f"no workbook at {self.path}")
        try:
            rows = Workbook(bytes(found[0][0])).rows(self.sheet)
        except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
            raise SourceError(f"{self.path} is no workbook of the zipped XML kind: {e}") from e
        width = max(map(len, rows), default=0)
        rows = [r + [None] * (width - len(r)) for r in rows]
        head = [str(v) if v is not None else f"column{i}" for i, v in enumerate(rows.pop(0))] if self.has_header and rows else [f"column{i}" for i in range(width)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * width
        types = [common_type(list(c)) for c in columns]
        fit = lambda v, t: v if v is None else str(v) if isinstance(t, T.StringType) else float(v) if isinstance(t, T.DoubleType) else v
        data = [tuple(fit(v, t) for v, t in zip(r, types, strict=True)) for r in rows]
        return spark.createDataFrame(data, T.StructType([T.StructField(n, t) for n, t in zip(head, types, strict=True)]))
