"""Packing token pieces into sequences by minimum bin slack.

Each document becomes token ids with END at the end. Whole CAPACITY-long pieces are cut from its front
and fill a sequence each; what remains, of 1 to CAPACITY - 1 ids, is packed with others. Only the
number of remainders of each length matters for that, a table of at most CAPACITY rows: while any
are left, the longest is fixed and a subset-sum over the lengths still there, as bits of one integer,
finds the reachable filling closest to CAPACITY; the lengths' counts are traced back, and the filling
is used as often as the counts allow. The plan, a few thousand rows at most, then deals the pieces to
sequences by their rank among those of their length, found by counts of input part and length.

Defined cases: a null or empty text is END alone; a null doc_id is kept; repeated documents are packed
each; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import materialise, small_batches

CAPACITY = 2048
END = 1
CACHE_WORDS = 800_000

#: Texts of these characters only are cut by the pattern below just as the tokenizer cuts them.
_PLAIN = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
#: White space to Python's patterns only; and what may be a special token.
_ODD = re.compile("[\x1c-\x1f]|<\\|")


class Encoder:
    """Token ids of texts; ids of pieces that were seen before come from a bounded table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a piece
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces in the table: words by one call for many, others one by one."""
        if len(self.known) + len(pieces) > CACHE_WORDS:
            self.known.clear()
        words = [p for p in pieces if p.isalpha()]
        for at in range(0, len(words), 4000):
            some = words[at : at + 4000]
            ids = self.encode(" ".join(some))
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                data, bounds = ids.tobytes(), (4 * ends).tolist()
                self.known.update(zip(some, (data[a:b] for a, b in zip([0, *bounds], bounds, strict=False)), strict=True))
        for p in pieces:
            if p not in self.known:
                self.known[p] = self.encode(p).tobytes()

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, END last."""
        end = np.array([END], "<u4").tobytes()
        cuts = [_PIECE.findall(t.lower()) if _PLAIN.fullmatch(t) and not _ODD.search(t) else None for t in texts]
        known = self.known
        new = set().union(*(c for c in cuts if c)).difference(known)
        if len(known) + len(new) > CACHE_WORDS:  # the table starts anew
            new = set().union(*(c for c in cuts if c))
        if new:
            self.learn(new)
        return [self.encode(t).tobytes() + end if c is None else b"".join(map(known.__getitem__, c)) + end for t, c in zip(texts, cuts, strict=True)]

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, and its place: input part and number among that part's pieces of its length."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path())
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.all_ids(texts), strict=True):
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, seen[length]))
                    seen[length] += 1
            types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the lengths in counts, at most so many of each, whose sum is closest to capacity from below."""
    mask = (1 << (capacity + 1)) - 1
    reach, trail = 1, []
    for length in sorted(counts, reverse=True):
        before = reach
        left, step = min(counts[length], capacity // length), 1
        while left:  # counts in binary pieces
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left, step = left - take, step * 2
        trail.append((length, before))
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, before in reversed(trail):
        used = 0
        while not before >> total & 1:
            total, used = total - length, used + 1
        if used:
            chosen[length] = used
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Fillings and how many sequences have each; together they use up the histogram."""
    left = {k: n for k, n in histogram.items() if n}
    out = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = Counter(fill({k: n for k, n in rest.items() if n and k <= capacity - longest}, capacity - longest)) + Counter({longest: 1})
        times = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append((times, dict(chosen)))
    return out


def deals(fillings: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces of this length in a sequence, offset of the first): how ranks become places."""
    rank: Counter[int] = Counter()
    sequence, out = 0, []
    for times, chosen in fillings:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            out.append((length, rank[length], times * n, sequence, n, offset))
            rank[length] += times * n
            offset += n * length
        sequence += times
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = materialise(cut(docs, path, capacity), "pieces")
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("length", "part", earlier.alias("earlier"))
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most CAPACITY rows
    fillings = plan(histogram, capacity)
    table = np.array(sorted(deals(fillings)), np.int64).reshape(-1, 6)
    starts = np.cumsum([0, *(times for times, _ in fillings)])[:-1]
    filled = np.array([sum(k * n for k, n in chosen.items()) for _, chosen in fillings], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 1 << 48
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length * wide + rank, "right") - 1] if len(length) else table[:0]
            k = rank - row[:, 1]
            sequence = row[:, 3] + k // row[:, 4]
            offset = row[:, 5] + k % row[:, 4] * length
            total = filled[np.searchsorted(starts, sequence, "right") - 1] if len(length) else filled[:0]
            power = (total & (total - 1)) == 0
            columns = [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset), pa.array(np.where(power, total, capacity))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"]
    ranked = pieces.join(offsets, ["length", "part"]).select(*names[:5], (F.col("nth") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(run, ", ".join(f"{n} long" for n in names))
