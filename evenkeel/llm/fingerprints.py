"""Document fingerprints by randomised edit embedding, with bit-sampled banding and verification.

A text is walked in blocks of BLOCK characters, all with the same randomness: step j of a block writes
the character under the walk, and a random bit of (j, character), the same for all texts, says whether
the walk moves on. Texts a few edits apart soon walk together again, so their edit distance becomes a
Hamming distance of what is written. A fingerprint is a sample of those steps: step j of block b has a
random height, and a text keeps the steps of at least its level, the smallest that leaves at most
SAMPLES; each gives one hex digit, a random function of the step and the character written, or a dot
where the walk has passed the end of its block. Levels are nested, so fingerprints of texts of any two
lengths compare at the higher of their levels.

The likeness of two fingerprints is the share of equal digits among the steps at which either has one.
Digits chosen at random make the bands by which near_pairs() finds candidates; each candidate is
verified by likeness.

Defined cases: null and empty texts have the fingerprint "0:", whose likeness is 1 to itself and 0 to
others; equal texts have equal fingerprints; texts of any length are walked whole, block by block;
rows that repeat a doc_id, and null doc_ids (which come last in descending order), stand in the order
of their texts; an empty table gives no rows; of a single document the next one is itself; further
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import small_batches
from evenkeel.llm.wordscan import mix

BLOCK = 1024
STEPS = 3 * BLOCK
SAMPLES = 256
BANDS, BAND_DIGITS = 24, 6
#: Rows that a task of the neighbour search has, about.
ROWS_A_PART = 20_000
#: Ranges of the neighbour search at most, as each row is held against their edges. Beyond that ranges grow, and their sorts spill.
MOST_PARTS = 4096

_rng = np.random.default_rng(20240229)
#: Whether the walk moves on at step j over a character of class c.
MOVES = _rng.integers(0, 2, (STEPS, 256), np.uint8)


def symbols_of(text: str) -> np.ndarray:
    """Code points as classes 1 to 255; 0 is the end of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (mix(points) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def height(keys: np.ndarray) -> np.ndarray:
    """A random height for each step number: h or more with probability 2^-h."""
    low = mix(keys.astype(np.uint64) ^ np.uint64(0x51ED270B27D7D9A5))
    return np.bitwise_count((low & -low.astype(np.int64).astype(np.uint64)) - np.uint64(1)).astype(np.int64)


def level_for(n_chars: int) -> int:
    level = 0
    while STEPS // BLOCK * n_chars >> level > SAMPLES:
        level += 1
    return level


_heights: dict[int, list[np.ndarray]] = {}


def kept_steps(block: int, level: int) -> np.ndarray:
    """The steps of a block that a text of this level samples, ascending."""
    key = block * 64 + level
    if key not in _heights:
        if len(_heights) > 20_000:
            _heights.clear()
        _heights[key] = np.flatnonzero(height(np.arange(STEPS) + block * STEPS) >= level)
    return _heights[key]


def n_steps(n_chars: int, block: int) -> int:
    """How many steps of a block stand for a text of so many characters."""
    return STEPS // BLOCK * max(0, min(BLOCK, n_chars - block * BLOCK))


def walk(texts: list[np.ndarray]) -> list[np.ndarray]:
    """What each block's walk writes, all blocks of all texts in step: per text an array (blocks, STEPS)."""
    counts = [-(-len(t) // BLOCK) for t in texts]
    total = sum(counts)
    grid = np.zeros((total, BLOCK + 1), np.uint8)
    sizes = np.zeros(total, np.int64)
    k = 0
    for t, c in zip(texts, counts, strict=True):
        for b in range(c):
            piece = t[b * BLOCK : (b + 1) * BLOCK]
            grid[k, : len(piece)] = piece
            sizes[k] = len(piece)
            k += 1
    order = np.argsort(-sizes, kind="stable")
    grid, sizes = grid[order], sizes[order]
    written = np.zeros((STEPS, total), np.uint8)
    at = np.arange(total) * (BLOCK + 1)
    last = at + sizes
    flat = grid.ravel()
    live = np.searchsorted(-sizes * (STEPS // BLOCK), -np.arange(STEPS), "left")  # blocks that have a step j
    for j in range(STEPS):
        n = int(live[j])
        if not n:
            break
        c = flat[at[:n]]
        written[j, :n] = c
        at[:n] += MOVES[j][c]
        np.minimum(at[:n], last[:n], out=at[:n])
    back = np.empty(total, np.int64)
    back[order] = np.arange(total)
    written = np.ascontiguousarray(written.T)[back]
    out, k = [], 0
    for c in counts:
        out.append(written[k : k + c])
        k += c
    return out


_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
_PAST = np.uint8(ord("."))


def sample(written: np.ndarray, n_chars: int) -> str:
    level, parts = level_for(n_chars), []
    for b in range(len(written)):
        steps = kept_steps(b, level)
        steps = steps[steps < n_steps(n_chars, b)]
        value = mix((steps + b * STEPS).astype(np.uint64) * np.uint64(256) + written[b, steps])
        digit = np.where(written[b, steps] > 0, _DIGITS[(value >> np.uint64(60)).astype(np.int64)], _PAST)
        parts.append(digit.tobytes().decode())
    return f"{n_chars}:{''.join(parts)}"


def fingerprints(texts: list[str], most_chars: int = 1 << 21) -> list[str]:
    """A fingerprint for each text; equal texts are walked once."""
    unique = {t: None for t in texts}
    group: list[str] = []
    size = 0

    def finish():
        symbols = [symbols_of(t) for t in group]
        for t, s, w in zip(group, symbols, walk(symbols), strict=True):
            unique[t] = sample(w, len(s))

    for t in list(unique):
        group.append(t)
        size += len(t) + BLOCK
        if size > most_chars:
            finish()
            group, size = [], 0
    if group:
        finish()
    return [unique[t] for t in texts]


def digits(fingerprint: str) -> tuple[int, list[np.ndarray]]:
    n, _, rest = fingerprint.partition(":")
    n, data, out, at = int(n), np.frombuffer(rest.encode(), np.uint8), [], 0
    level = level_for(n)
    for b in range(-(-n // BLOCK)):
        k = int(np.searchsorted(kept_steps(b, level), n_steps(n, b)))
        out.append(data[at : at + k])
        at += k
    return n, out


def likeness(one: str, two: str) -> float:
    """The share of equal digits among the steps at which either text has one, at the higher level of the two."""
    if one == two:
        return 1.0
    (n, a), (m, b) = digits(one), digits(two)
    if n < m:
        n, a, m, b = m, b, n, a
    level, low = level_for(n), level_for(m)
    equal = total = 0
    for k, x in enumerate(a):
        y = b[k] if k < len(b) else x[:0]
        if low < level and len(y):
            steps = kept_steps(k, low)[: len(y)]
            y = y[height(steps + k * STEPS) >= level]
        y = np.append(y, np.full(len(x) - len(y), _PAST))
        equal += int(((x == y) & (x != _PAST)).sum())
        total += int(((x != _PAST) | (y != _PAST)).sum())
    return equal / total if total else 0.0


def bands(fingerprint: str) -> list[str]:
    """Keys of BANDS bit samples: BAND_DIGITS of the digits at each of a few levels near the text's own."""
    n, parts = digits(fingerprint)
    own, out = level_for(n), []
    for level in (own, own + 1):
        steps = [(b * STEPS + s, d) for b, part in enumerate(parts) for s, d in zip(kept_steps(b, own)[: len(part)].tolist(), part.tolist(), strict=True) if d != _PAST and (own == level or height(np.array([b * STEPS + s]))[0] >= level)]
        for band in range(BANDS):
            rank = sorted(range(len(steps)), key=lambda i: hashlib.blake2b(f"{band}/{steps[i][0]}".encode(), digest_size=8).digest())[:BAND_DIGITS]
            if len(rank) == BAND_DIGITS:
                out.append(f"{level}/{band}/" + "".join(f"{steps[i][0]}{chr(steps[i][1])}." for i in rank))
    return out


def short_keys(fingerprint: str, least: float) -> list[str]:
    """A key for each digit of a fingerprint that one too short for bands may be alike; two without a common key share no digit."""
    n, parts = digits(fingerprint)
    if not n or level_for(n):
        return []
    found = [(b, s, d) for b, part in enumerate(parts) for s, d in enumerate(part.tolist()) if d != _PAST]
    return [f"short/{b}/{s}/{chr(d)}" for b, s, d in found] if len(found) * least < BAND_DIGITS else []


def near_pairs(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """All pairs (a, b, likeness) of ids whose fingerprints share a band and are alike: prints has id and fingerprint.

    Equal fingerprints are one class first, and each class meets all others of its bands, so a band of
    m different fingerprints makes up to m (m - 1) / 2 candidates; only ids are dealt by band. A
    fingerprint of too few digits for a band is held against all that share a digit with it.
    """

    def cut(batches):
        for batch in batches:
            ids, keys = [], []
            for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key in bands(f) + short_keys(f, least):
                    ids.append(i)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["id", "band"])

    def check(batches):
        for batch in batches:
            a, x, b, y = (batch.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([likeness(p, q) for p, q in zip(x, y, strict=True)], pa.float64())], ["a", "b", "likeness"])

    classes = prints.groupBy("fingerprint").agg(F.min("id").alias("id")).select("id", "fingerprint")
    keyed = classes.select("id", "fingerprint").mapInArrow(cut, "id long, band string").select("id", F.xxhash64("band").alias("band"))
    one, two = keyed.select(F.col("id").alias("a"), "band"), keyed.select(F.col("id").alias("b"), "band")
    met = one.join(two, "band").where("a < b").select("a", "b").distinct()
    x, y = (classes.select(F.col("id").alias(i), F.col("fingerprint").alias(f)) for i, f in (("a", "x"), ("b", "y")))
    pairs = met.join(x, "a").join(y, "b").select("a", "x", "b", "y")
    return pairs.mapInArrow(check, "a long, b long, likeness double").where(F.col("likeness") >= least)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next document in descending order of doc_id (after the last, the first).

    Documents are dealt to ranges of doc_id by quantiles; each range also gets the first row of the next
    range that has one. Only the quantiles come to the driver, MOST_PARTS at most.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    if not n:
        return rows.withColumn("next_text", F.col("text"))
    parts = min(MOST_PARTS, -(-n // ROWS_A_PART))
    cuts = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    edges = sorted({int(c) for c in cuts})
    # Range 0 has the largest ids; null is after the smallest.
    bucket = F.array_size(F.filter(F.lit(edges), lambda e: F.coalesce(F.col("doc_id") <= e, F.lit(True)))) if edges else F.lit(0)
    rows = rows.withColumn("part", bucket)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("top"))
    texts = rows.join(F.broadcast(heads.withColumnRenamed("part", "p")), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("top")), "left_semi")
    first = texts.groupBy("part").agg(F.min("text").alias("text"))  # one row a range
    one = heads.join(first, "part")
    ring = Window.orderBy(F.col("part"))  # over one row a range
    before = F.coalesce(F.lag("part").over(ring), F.max("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    extra = one.select(F.col("top").alias("doc_id"), "text", before.alias("part"))
    both = rows.withColumn("own", F.lit(0)).unionByName(extra.withColumn("own", F.lit(1)))
    lead = F.lead("text").over(Window.partitionBy("part").orderBy("own", *order))
    return both.select("doc_id", "text", lead.alias("next_text"), "own").where("own = 0").drop("own")


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
            prints = fingerprints([*texts, *changed, *following])
            n = len(texts)
            own, other, after = prints[:n], prints[n : 2 * n], prints[2 * n :]
            columns = [
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(own, pa.string()),
                pa.array(other, pa.string()),
                pa.array([likeness(x, y) for x, y in zip(own, other, strict=True)], pa.float64()),
                pa.array([likeness(x, y) for x, y in zip(own, after, strict=True)], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)
