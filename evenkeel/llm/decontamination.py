"""Benchmark decontamination with suffix arrays over blocks of the training text.

A task cuts its documents into blocks of whole texts. A block's suffix array holds the suffixes that
can match at all: those whose first words (up to three) stand so in a benchmark item. Every benchmark
suffix is binary-searched in every block's array; the range found is all its verbatim occurrences,
which are then extended to their longest. No row is shuffled. The benchmark is read in blocks of
BENCHMARK_BYTES, each sent to the executors as a file-backed broadcast, so its size is not bounded by
the driver's or a worker's memory.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is WINDOW consecutive
words of an item; an item with fewer words, but not none, is one window.

Defined cases: a null or empty text has no words and is clean; a null item text has no window; a
null item_id counts as the item "null"; rows that repeat an item_id are one item; repeated documents
each get a row; an empty table gives no rows; further columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import fresh_name, small_batches
from evenkeel.llm.wordscan import ALNUM, Words, blocks, scan_column

WINDOW = 10
BENCHMARK_BYTES = 32 << 20
SEED = 3

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("longest", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("longest", pa.int64()),
        ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))),
    ]
)


class Suffixes:
    """The benchmark suffixes at which a window starts, over a vocabulary of dense word numbers (0: any other word)."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = scan_column(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.labels = [i for i, _ in items]
        self.vocab_hash, at = np.unique(words.hashes, return_index=True)
        self.vocab = [words.bytes_of(k) for k in at]
        ids = np.searchsorted(self.vocab_hash, words.hashes).astype(np.int64) + 1
        n = np.diff(words.doc_ptr)
        width = np.minimum(n, window)
        doc = words.doc_of
        inside = np.arange(len(ids)) - words.doc_ptr[doc]
        self.at = np.flatnonzero(inside + width[doc] <= n[doc])
        self.item, self.width = doc[self.at], width[doc[self.at]]
        self.left = n[self.item] - inside[self.at]
        self.ids = np.append(ids, np.zeros(window, np.int64))
        keys = np.stack([np.where(t < self.width, self.ids[self.at + t], 0) for t in range(window)], 1) if len(self.at) else np.zeros((0, window), np.int64)
        self.low = as_keys(keys)
        self.high = as_keys(np.where(np.arange(window) < self.width[:, None], keys, 0xFFFFFFFF))
        self.seed = int(min(SEED, self.width.min())) if len(self.at) else SEED
        self.seeds = np.unique(seed_of([keys[:, t] for t in range(self.seed)], len(self.vocab)))
        self.window = window

    def number(self, words: Words) -> np.ndarray:
        if not len(self.vocab_hash):
            return np.zeros(len(words.hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocab_hash, words.hashes), len(self.vocab_hash) - 1)
        return np.where(self.vocab_hash[at] == words.hashes, at + 1, 0)


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows, ">u4").view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.zeros(0, "S4")


def seed_of(columns: list[np.ndarray], base: int) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = out * np.uint64(base + 2) + c.astype(np.uint64)
    return out


def suffix_array(ids: np.ndarray, doc_end: np.ndarray, bench: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (first WINDOW words, 0 beyond the text's end) and their positions."""
    at = np.flatnonzero(ids > 0)
    if bench.seed > 1 or len(bench.seeds):
        at = at[at + bench.seed <= doc_end[at]]
        found = seed_of([ids[at + t] for t in range(bench.seed)], len(bench.vocab)) if len(at) else np.zeros(0, np.uint64)
        slot = np.minimum(np.searchsorted(bench.seeds, found), len(bench.seeds) - 1)
        at = at[bench.seeds[slot] == found]
    padded = np.append(ids, np.zeros(bench.window, ids.dtype))
    keys = as_keys(np.stack([np.where(at + t < doc_end[at], padded[at + t], 0) for t in range(bench.window)], 1)) if len(at) else np.zeros(0, "S4")
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def occurrences(words: Words, bench: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each verbatim occurrence: its position, the number of the benchmark suffix, its longest length in words."""
    none = np.zeros(0, np.int64)
    if not len(bench.at) or not len(words.hashes):
        return none, none, none
    ids = bench.number(words)
    doc_end = words.doc_ptr[1:][words.doc_of]
    while True:
        keys, at = suffix_array(ids, doc_end, bench)
        lo, hi = np.searchsorted(keys, bench.low, "left"), np.searchsorted(keys, bench.high, "right")
        count = np.maximum(hi - lo, 0)
        suffix = np.repeat(np.arange(len(count)), count)
        pos = at[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        # The words themselves decide, not their hashes: a word that only collides loses its number.
        used = np.unique(np.concatenate([none, *(pos[bench.width[suffix] > t] + t for t in range(bench.window))]))
        wrong = [k for k in used.tolist() if words.bytes_of(k) != bench.vocab[ids[k] - 1]]
        if not wrong:
            break
        ids[wrong] = 0
    length = bench.width[suffix].copy()
    live = np.arange(len(pos))
    while len(live):  # extend to the longest verbatim match
        live = live[(length[live] < bench.left[suffix[live]]) & (pos[live] + length[live] < doc_end[pos[live]])]
        live = live[ids[pos[live] + length[live]] == bench.ids[bench.at[suffix[live]] + length[live]]]
        length[live] += 1
    return pos, suffix, length


def judge(words: Words, benches: Iterator[Suffixes]) -> pa.Array:
    n_docs = len(words.doc_ptr) - 1
    total = len(words.hashes)
    cover = np.zeros(total + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(n_docs)]
    longest = np.zeros(n_docs, np.int64)
    doc = words.doc_of
    for bench in benches:
        pos, suffix, length = occurrences(words, bench)
        if not len(pos):
            continue
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + bench.width[suffix], -1)
        np.maximum.at(longest, doc[pos], length)
        for d, i in np.unique(np.stack([doc[pos], bench.item[suffix]], 1), axis=0).tolist():
            items[d].add(bench.labels[i])
    hit = np.cumsum(cover[:-1]) > 0
    out = []
    for d in range(n_docs):
        a, b = int(words.doc_ptr[d]), int(words.doc_ptr[d + 1])
        inside = hit[a:b]
        n_hit = int(inside.sum())
        spans = []
        if n_hit:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
            spans = [{"first_word": int(s), "n_words": int(e - s)} for s, e in zip(edges[::2], edges[1::2], strict=True)]
        names = sorted(items[d])
        out.append((b - a, n_hit, len(names), names, hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0, int(longest[d]), spans))
    return pa.array([dict(zip(_ARROW.names, row, strict=True)) for row in out], _ARROW)


def read_blocks(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple[str, str]]]:
    held: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text.encode())
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", window: int = WINDOW, name: str = "decontamination", most_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """docs with one more column, a struct of RESULT. The column is called name, with underscores added if docs has it."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = [spark.sparkContext.broadcast(Suffixes(items, window)) for items in read_blocks(benchmark, bench_id, bench_text, most_bytes)]
    name = fresh_name(docs.columns, name)
    text_at = docs.columns.index(text_col)

    def benches() -> Iterator[Suffixes]:
        for b in shared:
            yield b.value
            if len(shared) > 1:
                b._value = None  # one block at a time in memory; the next text block reads it again from its file
                del b._value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_at):
                words = scan_column(part.column(text_at), ALNUM)
                yield pa.RecordBatch.from_arrays([*part.columns, judge(words, benches())], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, RESULT)]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    marked = annotate(docs, benchmark, **kw)
    verdict = marked.columns[-1]
    return marked.where(~F.col(f"`{verdict}`.contaminated")).drop(verdict)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and longest)."""
    marked = annotate(docs.select("doc_id", "text"), benchmark)
    verdict = F.col(marked.columns[-1])
    return marked.select("doc_id", *(verdict[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")))


REPORT_SQL = rf"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (SELECT item_id, w, least(len(w), {WINDOW}) AS width FROM i WHERE len(w) > 0),
x AS (SELECT item_id, width, q, array_to_string(w[q:q + width - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS q FROM v)),
p AS (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS place FROM w, (SELECT DISTINCT width FROM v)),
h AS (SELECT doc_id, place, p.width, item_id, place - q AS diagonal FROM p JOIN x ON x.width = p.width AND x.gram = array_to_string(w[place:place + p.width - 1], ' ')),
g AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, diagonal, width ORDER BY place) AS run FROM h),
y AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, width + count(*) - 1 AS n FROM g GROUP BY doc_id, item_id, diagonal, width, run) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, place + unnest(range(0, width)) AS word FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(m.n, 0) AS n_hit, coalesce(k.n, 0) AS n_items, sha256(coalesce(k.items, '')) AS items_sha256, coalesce(m.n, 0) > 0 AS contaminated,
    coalesce(y.longest, 0) AS longest
FROM w LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN y USING (doc_id)"""
