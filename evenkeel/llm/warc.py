"""WARC archives with a two-level capture index.

Records are gzip members in archive files; the index holds, for each record, its key (reversed host and
path of the URL, then page_id) and the place of its member. Keys are sorted into shards by range, a
shard into compressed blocks of BLOCK_LINES lines, and beside each shard lies its sparse directory, the
first key and place of each block. A lookup finds the shard by the shards' first keys (one short row a
shard), binary-searches the shard's directory, reads and unpacks one block, binary-searches that, and
reads the record's byte range from the archive.

Files go to the shared scratch folder through pyarrow.fs (local paths, s3, gs, hdfs), under names that
hold the task attempt: what a lost attempt has left is never named by a committed index row.

Of records with equal payloads (equal SHA-1 and length) of LEAST_SHARED bytes or more, the one with the
largest page_id is the response and the others revisit it. Equal payloads are found on digests alone;
pages then meet their verdict by (page_id, digest), so a payload that a third of all pages have is not
gathered anywhere.

Defined cases: a null html is empty; a null url has the empty key; a null page_id counts as smaller than
all; rows that repeat page_id and payload are alike and get one verdict, a record each; an empty table
gives no rows; further columns play no part.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import materialise, scratch_path, small_batches

LEAST_SHARED = 1000
BLOCK_LINES = 256
ARCHIVE_BYTES = 64 << 20
WARC_DATE = "2024-01-01T00:00:00Z"
SHARDS_BYTES = 64 << 20  # the table of shards' first keys may have so many bytes
#: Bytes of records that a task fetches at most, about; with less to fetch, up to FETCH_TASKS tasks fetch this many at least.
FETCH_BYTES, FETCH_TASKS, LEAST_FETCH_BYTES = 128 << 20, 64, 4 << 20


def url_key(url: str | None) -> str:
    """Reversed host, ")" and the rest: http://www.A.example.com:80/x?y -> com,example,a,www)/x?y"""
    rest = (url or "").split("://", 1)[-1]
    at = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = rest[:at].rsplit("@", 1)[-1].lower(), rest[at:]
    name = host.rsplit(":", 1)[0] if host.rsplit(":", 1)[-1].isdigit() else host
    return (",".join(reversed(name.split("."))) + ")" + path).replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D") if rest else ""


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
        f"WARC-Date: {WARC_DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-ID: {'null' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse(member: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (None in a revisit) of a gzip member."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
    if raw[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its Content-Length says")
    head, _, payload = block.partition(b"\r\n\r\n")
    page = fields["X-Page-ID"]
    out = {"page_id": None if page == "null" else int(page), "record_type": fields["WARC-Type"], "refers_to": None, "payload": None}
    if out["record_type"] == "response":
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
    else:
        length = next(int(h.split(b":")[1]) for h in head.split(b"\r\n") if h.lower().startswith(b"content-length:"))
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        out |= {"payload_bytes": length, "payload_digest": digest, "refers_to": int(fields["X-Refers-To-Page"])}
    return out


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(root)
    return system, path


def attempt_name() -> str:
    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"


class Appender:
    """Files of at most about so many bytes, each opened when it is first written to."""

    def __init__(self, root: str, kind: str, most: int):
        self.system, self.root = opened(root)
        self.system.create_dir(self.root, recursive=True)
        self.kind, self.most, self.n, self.out, self.at, self.name = kind, most, 0, None, 0, ""

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at + len(data) > self.most:
            self.close()
        if self.out is None:
            self.name, self.at = f"{self.kind}-{attempt_name()}-{self.n}", 0
            self.out = self.system.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.n += 1
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Ranges:
    """Byte ranges of files in a folder; a few files stay open."""

    def __init__(self, root: str):
        self.system, self.root = opened(root)
        self.files: OrderedDict = OrderedDict()

    def read(self, name: str, offset: int | None = None, length: int = 0) -> bytes:
        if offset is None:
            with self.system.open_input_file(f"{self.root}/{name}") as f:
                return f.read()
        if name not in self.files:
            if len(self.files) >= 16:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.system.open_input_file(f"{self.root}/{name}")
        self.files.move_to_end(name)
        return self.files[name].read_at(length, offset)


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    slim = rows.select("page_id", "digest", F.octet_length("payload").alias("size"))
    first = slim.where(F.col("size") >= LEAST_SHARED).groupBy("digest", "size").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null")
    later = slim.join(first, ["digest", "size"]).where("not (page_id <=> winner)").select("page_id", "digest", F.col("winner").alias("refers_to")).distinct()
    later = later.select(F.col("page_id").alias("p"), F.col("digest").alias("g"), "refers_to")
    return rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("g")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(rows: DataFrame, root: str) -> DataFrame:
    """Write a record for each row of verdicts(); gives urlkey, page_id, file, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Appender(root, "archive", ARCHIVE_BYTES)
        for batch in batches:
            page, url, payload, digest, refers = (batch.column(i).to_pylist() for i in range(5))
            places = [out.add(record(*row)) for row in zip(page, url, payload, digest, refers, strict=True)]
            columns = [pa.array([url_key(u) for u in url], pa.string()), batch.column(0), *(pa.array([p[k] for p in places], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["urlkey", "page_id", "file", "offset", "length"])
        out.close()

    return rows.mapInArrow(run, "urlkey string, page_id long, file string, offset long, length long")


def sort_key(urlkey: str, page_id: int | None) -> bytes:
    """Sorts as (urlkey, page_id) do in Spark, null first: the key's bytes, a zero byte, the number in biased big-endian form."""
    return urlkey.encode() + b"\x00" + (b"\x00" if page_id is None else b"\x01" + struct.pack(">Q", page_id + (1 << 63)))


def write_index(entries: DataFrame, root: str) -> DataFrame:
    """Sort entries into shards of compressed blocks; gives a row per shard: its first key, index file, directory file and the bytes of its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Appender(root, "index", 1 << 62)
        lines: list[bytes] = []
        directory: list[bytes] = []
        first, block_key, total = None, b"", 0

        def flush():
            name, offset, length = out.add(zlib.compress(b"\n".join(lines), 6))
            directory.append(b"\t".join([block_key.hex().encode(), str(offset).encode(), str(length).encode()]))
            lines.clear()
            return name

        name = ""
        for batch in batches:
            for urlkey, page_id, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                key = sort_key(urlkey, page_id)
                first = key if first is None else first
                total += length
                block_key = block_key if lines else key
                lines.append(b"\t".join([key.hex().encode(), file.encode(), str(offset).encode(), str(length).encode()]))
                if len(lines) == BLOCK_LINES:
                    name = flush()
        if lines:
            name = flush()
        out.close()
        rows = []
        if first is not None:
            sparse = Appender(root, "directory", 1 << 62)
            rows.append((first, name, sparse.add(b"\n".join(directory))[0], total))
            sparse.close()
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["first_key", "index", "directory", "bytes"])

    ordered = entries.repartitionByRange("urlkey", "page_id").sortWithinPartitions("urlkey", "page_id")
    return ordered.mapInArrow(run, "first_key binary, index string, directory string, bytes long")


class Shard:
    """One shard of the index: its directory in memory, and the block last read."""

    def __init__(self, ranges: Ranges, index: str, directory: str):
        self.ranges, self.index = ranges, index
        rows = [line.split(b"\t") for line in ranges.read(directory).split(b"\n")]
        self.keys = [bytes.fromhex(r[0].decode()) for r in rows]
        self.places = [(int(r[1]), int(r[2])) for r in rows]
        self.held: tuple[int, list[bytes], list[list[bytes]]] = (-1, [], [])

    def block(self, k: int) -> tuple[list[bytes], list[list[bytes]]]:
        if self.held[0] != k:
            rows = [line.split(b"\t") for line in zlib.decompress(self.ranges.read(self.index, *self.places[k])).split(b"\n")]
            self.held = (k, [bytes.fromhex(r[0].decode()) for r in rows], rows)
        return self.held[1:]

    def find(self, key: bytes) -> list[tuple[str, int, int]]:
        """Places of all records with this key; a key that repeats may run over blocks."""
        k = max(0, bisect.bisect_left(self.keys, key) - 1)
        out = []
        while k < len(self.keys) and self.keys[k] <= key:
            keys, rows = self.block(k)
            for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                out.append((rows[i][1].decode(), int(rows[i][2]), int(rows[i][3])))
            k += 1
        return out


def lookup(captures: DataFrame, shards: DataFrame, root: str, schema: str = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long") -> DataFrame:
    """The records of the captures (page_id, url): a row per record found, read from the archives."""
    held = shards.collect()  # a row per index shard, bounded below
    table = sorted((bytes(r[0]), r[1], r[2]) for r in held)
    size = sum(r[3] for r in held)
    tasks = max(1, -(-size // FETCH_BYTES), min(FETCH_TASKS, -(-size // LEAST_FETCH_BYTES)))
    if sum(len(k) + len(i) + len(d) for k, i, d in table) > SHARDS_BYTES:
        raise ValueError("the index has too many shards for one table of first keys; write it with fewer partitions")
    shared = captures.sparkSession.sparkContext.broadcast(table)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [k for k, _, _ in shared.value]
        for batch in batches:
            keys = [sort_key(url_key(u), p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            # A key that repeats may have its first records at the end of the shard before.
            spans = [range(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)) for k in keys]
            rows = [(s, k) for k, span in zip(keys, spans, strict=True) for s in span]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.binary())], ["shard", "key"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(root)
        at, shard = -1, None
        names = [c.split()[0] for c in schema.split(", ")]
        types = {"long": pa.int64(), "string": pa.string()}
        kinds = [types[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            rows = []
            for s, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != at:
                    at, shard = s, Shard(ranges, *shared.value[s][1:])
                rows += [parse(ranges.read(*place)) for place in shard.find(key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)

    routed = captures.select("page_id", F.col("url").cast("string")).distinct().mapInArrow(route, "shard int, key binary").distinct()
    # By range, so that a block of the index is read by one or two tasks.
    return routed.repartitionByRange(tasks, "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(fetch, schema)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write archives and index for pages (page_id, url, html); the shards' table, and the folder of the files."""
    small_batches(pages.sparkSession)
    root = scratch_path(pages.sparkSession, "warc")
    entries = materialise(write_archives(verdicts(pages), root), "captures")
    return materialise(write_index(entries, root), "shards"), root


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives."""
    shards, root = archive(pages)
    return lookup(pages, shards, root)


REPORT_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN n >= {LEAST_SHARED} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= {LEAST_SHARED} AND page_id <> top THEN top END AS refers_to
FROM d"""
