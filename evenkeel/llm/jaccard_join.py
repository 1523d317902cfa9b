"""Exact Jaccard self-join on word 5-grams by a token-group matrix, reported as connected components.

A document's set is its distinct shingles of five words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased); fewer
words make one shingle of the whole sequence; no words, no set and no link. Two documents link when
100 * |intersection| >= 75 * |union|.

1. Documents with the same set are one class; only its smallest doc_id goes on. A count by bucket of
   shingle hash (a table of fixed size) gives every shingle a rarity, and so all sets one order.
2. Matrix rows (shingle, class) are made for the rarest n - ceil(0.75 n) + 1 shingles of each set: two
   sets that link share one of them. One shuffle by shingle, read as sorted runs, keeps the shingles
   that more than one class has.
3. Of two sets a, b with c common matrix rows, |a & b| <= c + max(n_a - p_a, n_b - p_b), p the number of
   matrix rows of a set, and a link needs |a & b| >= 3/7 (n_a + n_b): this bounds c from below, by sizes.
4. Similar classes are gathered in groups: in each of ROUNDS rounds a class meets its PIVOTS best pivots,
   of those that its shingles name (under another random order each round) the ones with most common rows
   that pass the bound, and is verified against them. Whoever meets is of one group; whoever links, of one
   component. A round costs a few comparisons a class, however large a group of copies is.
5. The rows gathered by group are the token-group matrix: each group's matrix shingles, with the least and
   largest set, the first place and the longest rest of shared rows among the members that have the shingle.
   All that two sets have in common stands from their first common shingle on, so its places and rests bound
   |a & b| and c; only groups that pass at some shingle, as if it were the first, are opened. A group is also opened for its own members outside
   its largest component. Opening goes block by block, for any number of members: no pair is made but a link,
   and pairs within a component, which cannot change it, give none.
6. Components by label propagation with pointer jumping over the links found.

Hashes are 64 bits; a class goes by 64 bits of its set's digest, and rows find their class by 128. A link
is decided on the shingle hashes of the two whole texts. Of a class one text is cut again for this, found by
its hash.

Defined cases: null and empty texts and texts of white space have n_shingles 0 and are their own
component; rows that repeat a doc_id each get a row, and are one node; a null doc_id with words is a
node that sorts after all others; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import discard, materialise, small_batches
from evenkeel.llm.components import components
from evenkeel.llm.wordscan import NON_SPACE, Words, blocks, mix, rolling, scan_column

SHINGLE = 5
SIMILARITY = 75  # per cent
BUCKETS = 1 << 20
CHUNK = 1 << 14  # buckets in one row of partial counts
LEAST_MARKS, MOST_MARKS = 1 << 20, 1 << 30  # bits; at most 128 MB
PIVOTS = 4  # for a class in a round
DEALT = 500  # pairs of a pivot that meet one copy of its set
ROUNDS = 2
BLOCK = 1 << 17  # shingles

SALT = np.uint64(0xD6E8FEB86659FD93)
NOTHING = np.zeros(0, np.uint64)


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit sums over a set; the first names its class."""
    one, two = mix(s).sum(dtype=np.uint64), mix(s ^ SALT).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def shingles(words: Words) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    grams = rolling(words.hashes, SHINGLE)
    for a, b in zip(words.doc_ptr[:-1].tolist(), words.doc_ptr[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        else:
            yield rolling(words.hashes[a:b], b - a) if b > a else grams[:0]


def prefix_length(n: int) -> int:
    return n - -(-SIMILARITY * n // 100) + 1


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) or not len(a):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SIMILARITY * (len(a) + len(b) - common)


def each_set(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in blocks(batch, text_at):
            yield part, list(shingles(scan_column(part.column(text_at), NON_SPACE)))


def text_hashes() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("x"), F.xxhash64(F.lit(7), text).alias("y")]


def describe_sets(docs: DataFrame) -> DataFrame:
    """doc_id, the size of its set, a 128-bit digest of the set, and two hashes of the text; and of each task BUCKETS / CHUNK rows (chunk, counts) of how many shingles fall in each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.uint32)
        for part, sets in each_set(batches, 1):
            for s in sets:
                np.add.at(total, bucket(s), np.uint32(1))
            h = [digest(s) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in h], pa.int64()), pa.array([y for _, y in h], pa.int64())]
            none = [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, part.column(2), part.column(3), *none], names)
        chunks = total.reshape(-1, CHUNK)
        at = np.flatnonzero(chunks.any(1))
        counts = [pa.array(at.astype(np.int32)), pa.array([chunks[k].astype("<u4").tobytes() for k in at], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), pa.int64()) for _ in names[:6]), *counts], names)

    names = ["doc_id", "n_shingles", "h1", "h2", "x", "y", "chunk", "counts"]
    return docs.select("doc_id", "text", *text_hashes()).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, x long, y long, chunk int, counts binary")


def bucket_counts(described: DataFrame) -> np.ndarray:
    """How many shingles of all documents fall in each of BUCKETS buckets: a table of fixed size. What receives a chunk adds its rows up as they come."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(data, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary())], ["chunk", "counts"])

    rows = described.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(BUCKETS, np.int64)
    for k, data in rows.collect():
        out[k * CHUNK : (k + 1) * CHUNK] += np.frombuffer(bytes(data), "<i8")
    return out


def matrix_rows(docs: DataFrame, counts) -> DataFrame:
    """(shingle, class, place) for the rarest shingles of every set, in the order that all sets have, once for each class in a block of texts."""

    def run(batches):
        rarity = counts.value
        for _, sets in each_set(batches, 0):
            rows: dict[tuple[int, int], np.ndarray] = {}
            for s in sets:
                if len(s) and (name := digest(s)) not in rows:
                    rows[name] = s[np.lexsort((s, rarity[bucket(s)]))[: prefix_length(len(s))]]
            of = np.repeat(np.array([h1 for h1, _ in rows], np.int64), [len(s) for s in rows.values()])
            at = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(s), dtype=np.int32) for s in rows.values())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([NOTHING, *rows.values()]).view(np.int64)), pa.array(of), pa.array(at)], ["s", "h1", "at"])

    return docs.mapInArrow(run, "s long, h1 long, at int")


def shared_rows(rows: DataFrame) -> DataFrame:
    """The matrix rows whose shingle more than one class has, each once: one shuffle, then sorted runs read in bounded memory."""

    def run(batches):
        last = None  # the row before: shingle, class, place, whether it has been given out
        for batch in batches:
            s, c, at = (batch.column(k).to_numpy() for k in range(3))
            if last is not None:
                s, c, at = np.append(last[0], s), np.append(last[1], c), np.append(last[2], at)
            new = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))[: len(s)]
            s, c, at = s[new], c[new], at[new]
            if not len(s):
                continue
            before = np.append(False, s[1:] == s[:-1])
            keep = before | np.append(before[1:], False)
            given = keep.copy()
            if last is not None and last[3]:
                keep[0] = False
                given[0] = True
            last = (s[-1], c[-1], at[-1], bool(given[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(c[keep]), pa.array(at[keep])], ["s", "h1", "at"])

    return rows.repartition("s").sortWithinPartitions("s", "h1").mapInArrow(run, "s long, h1 long, at int")


def placed_rows(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """s, h1, n, at, r, rest: the shared matrix rows, with how many the class has, and how many of those from this row on in the order of places."""
    each = shared.groupBy("h1").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("v")).join(classes.select("h1", "n"), "h1")
    each = each.select("h1", "n", F.size("v").alias("r"), F.posexplode("v").alias("k", "e"))
    return each.select("e.s", "h1", "n", "e.at", "r", (F.col("r") - F.col("k")).alias("rest"))


def marks_of(names: DataFrame) -> np.ndarray:
    """A packed bit table in which the bits of all the names (a hash each) are set: 16 bits a name, within bounds. A full table lets all pass, which costs time, not results."""
    size = min(MOST_MARKS, max(LEAST_MARKS, 1 << (16 * max(1, names.count())).bit_length()))

    def set_bits(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            bit = (batch.column(0).to_numpy().view(np.uint64) % np.uint64(size)).astype(np.int64)
            np.bitwise_or.at(bits, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()] if bits.any() else [], pa.binary())], ["bits"])

    out = np.zeros(size // 8, np.uint8)
    for (data,) in names.coalesce(8).mapInArrow(set_bits, "bits binary").toLocalIterator():  # 8 tables at most, one by one
        out |= np.frombuffer(bytes(data), np.uint8)
    return out


class Sets:
    """The whole sets (sorted shingle hashes) of the classes asked for so far, each cut once from one text (x, its hash) of the class."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes, self.tables = docs, classes, []

    def get(self, names: DataFrame) -> DataFrame:
        """(h1, elements) of the classes named (h1), and of others asked for before."""
        for held in self.tables:
            names = names.join(held.select("h1"), "h1", "left_anti")
        names = materialise(names.join(self.classes.select("h1", "x"), "h1"), "names")
        if names.limit(1).count() or not self.tables:
            self.tables.append(materialise(self._cut(names), "sets"))
        discard(names)
        return reduce(DataFrame.union, self.tables)

    def _cut(self, names: DataFrame) -> DataFrame:
        """Texts are read where they lie: a bit table of bounded size tells by their hashes which are cut, and of a class's copies a task gives one."""
        marks = self.docs.sparkSession.sparkContext.broadcast(marks_of(names.select("x")))

        def wanted(batches):
            bits = marks.value
            given: set[int] = set()
            for batch in batches:
                x = batch.column(1).to_numpy().view(np.uint64)
                bit = (x % np.uint64(8 * len(bits))).astype(np.int64)
                at = [int(k) for k in np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) if not (x[k] in given or given.add(x[k]))]
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at))], ["text"])

        def run(batches):
            given: set[int] = set()
            for _, sets in each_set(wanted(batches), 0):
                out = {}
                for s in sets:
                    if len(s) and (name := digest(s)[0]) not in given:
                        given.add(name)
                        out[name] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.large_binary()).cast(pa.binary())], ["h1", "elements"])

        texts = self.docs.select("text", text_hashes()[0])
        return texts.mapInArrow(run, "h1 long, elements binary").join(names, "h1", "left_semi").dropDuplicates(["h1"])


def verify(pairs: DataFrame, sets: Sets) -> DataFrame:
    """pairs (a, b) with linked: whether the two classes' whole sets link.

    A class that many pairs name as b is dealt out: its set goes once to every DEALT of them.
    """

    def run(batches):
        for batch in batches:
            linked = [links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    pairs = materialise(pairs, "pairs")
    whole = sets.get(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct())
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("shares"))
    one = pairs.join(shares, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"))
    one = one.join(whole.select(F.col("h1").alias("a"), F.col("elements").alias("of_a")), "a")
    two = whole.join(shares.withColumnRenamed("b", "h1"), "h1").select(F.col("h1").alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("elements").alias("of_b"))
    out = materialise(one.join(two, ["b", "share"]).select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, linked boolean"), "verified")
    discard(pairs)
    return out


def least_common(n: Column, lo: Column, hi: Column) -> Column:
    """How many common matrix rows a set of n shingles needs for a link with one of lo to hi; null where no size fits."""
    low = F.greatest(lo, F.ceil(n * SIMILARITY / 100))
    high = F.least(hi, F.floor(n * 100 / SIMILARITY))
    need = lambda m: (n + m) * SIMILARITY / (100 + SIMILARITY) - F.greatest(n, m) * SIMILARITY / 100
    # Over m the need rises up to n and falls from there on, so its least is at an end.
    return F.when(low <= high, F.least(need(low), need(high)))


def may_link(n: Column, at: Column, rest: Column, lo: Column, hi: Column, at2: Column, rest2: Column) -> Column:
    """Whether a set of n shingles may link with one of lo to hi, if the first shingle both have stands at these places (at2: or later) and starts these rests of their shared rows.

    All that both have stands from there on in either set; it is SIMILARITY / (100 + SIMILARITY) of both sizes.
    """
    low = F.greatest(lo, F.ceil(n * SIMILARITY / 100))
    high = F.least(hi, F.floor(n * 100 / SIMILARITY))
    placed = ((n - at) * (100 + SIMILARITY) >= (n + low) * SIMILARITY) & ((high - at2) * (100 + SIMILARITY) >= (n + high) * SIMILARITY)
    return (low <= high) & placed & (F.least(rest, rest2) >= least_common(n, lo, hi))


def meetings(rows: DataFrame) -> DataFrame:
    """(h1, open), with repeats: the groups that a class must be compared with, by the bounds. rows: s, h1, n, at, rest, label, own (the classes of that group).

    Of two groups the one with fewer classes asks and the other is opened (of equals, that of the smaller label asks).
    """
    rows = rows.repartition("s")  # one exchange for the matrix and the join
    matrix = rows.groupBy("s", F.col("label").alias("open"), F.col("own").alias("m")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("at").alias("at2"), F.max("rest").alias("rest2"))
    asks = (F.col("m") > F.col("own")) | ((F.col("m") == F.col("own")) & (F.col("open") > F.col("label")))
    x, y = rows.alias("x"), matrix.alias("y")
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & asks & may_link(*(F.col(c) for c in ("n", "at", "rest", "lo", "hi", "at2", "rest2"))))
    return met.select("h1", "open")


def best_pivots(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a class and the PIVOTS pivots, of other groups, with most common rows among those that this round's orders name, where the bound allows a link."""
    orders = [F.min(F.struct(F.xxhash64(F.lit(turn * PIVOTS + k), "h1").alias("rank"), F.col("h1").alias("b"), F.col("label").alias("of"), F.col("n").alias("m"), F.col("r").alias("r2"))) for k in range(PIVOTS)]
    rows = rows.repartition("s")  # one exchange for the pivots and the join
    pivot = lambda v: F.struct(v["b"].alias("b"), v["of"].alias("of"), v["m"].alias("m"), v["r2"].alias("r2"))
    named = rows.groupBy("s").agg(F.array_distinct(F.transform(F.array(*orders), pivot)).alias("v")).select("s", F.explode("v").alias("v")).select("s", "v.*")
    least = least_common(F.col("n"), F.col("m"), F.col("m"))
    met = rows.join(named, "s").where("label <> of").where(F.least("r", "r2") >= least).groupBy(F.col("h1").alias("a"), "n", "b", "m").agg(F.count("*").alias("c"))
    met = met.where(F.col("c") >= least)
    most = F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), False), 1, PIVOTS)  # of at most PIVOTS pivots a row
    return met.groupBy("a").agg(most.alias("v")).select("a", F.explode("v").alias("v")).select("a", "v.b")


def asking(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(open, h1): the classes that a group must be opened for: those of its members that its largest component has not, and classes of other groups that qualify.

    members: h1, open (the group), label (the component), n.
    """
    parts = members.groupBy("open", "label").agg(F.count("*").alias("m"))
    main = parts.groupBy("open").agg(F.max(F.struct("m", "label")).alias("v")).select("open", F.col("v.label").alias("main"))
    inside = members.join(main, "open").where("label <> main").select("open", "h1")
    owns = members.groupBy("open").agg(F.count("*").alias("own"))
    of = members.join(owns, "open").select("h1", F.col("open").alias("label"), "own")
    outside = meetings(rows.join(of, "h1")).select("open", "h1")
    return inside.union(outside).distinct()


def opened(rows: DataFrame, members: DataFrame, sets: Sets) -> DataFrame:
    """Links (a, b) between a class that asks and members of the group opened for it, one for each component that the class meets in a block.

    Classes that ask and members are dealt to blocks of about BLOCK shingles; a task has one block of either.
    """

    def compare(asks: pa.Table, held: pa.Table) -> pa.Table:
        a, b, linked = asks.column("h1").to_pylist(), held.column("h1").to_numpy(), []
        owned = [np.frombuffer(x.as_py(), np.uint64) for x in held.column("elements")]
        size, of, label = np.array([len(x) for x in owned]), held.column("label").to_numpy(), asks.column("label").to_pylist()
        every, owner = np.concatenate(owned), np.repeat(np.arange(len(owned)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for k, x in enumerate(asks.column("elements")):
            own = np.frombuffer(x.as_py(), np.uint64)
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            count = hi - lo
            at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(owned))
            hit = np.flatnonzero((100 * common >= SIMILARITY * (len(own) + size - common)) & (of != label[k]))
            linked += [(a[k], int(b[i])) for i in hit[np.unique(of[hit], return_index=True)[1]]]
        return pa.table({"a": pa.array([x for x, _ in linked], pa.int64()), "b": pa.array([y for _, y in linked], pa.int64())})

    asks = materialise(asking(rows, members), "asks")
    there = members.join(asks.select("open").distinct(), "open", "left_semi")
    asks = asks.join(members.select("h1", "label", "n"), "h1").select("open", "h1", "label", "n")
    whole = sets.get(asks.select("h1").union(there.select("h1")).distinct())
    blocks_of = lambda df, name: df.groupBy("open").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias(name))
    blocks = blocks_of(asks, "asked").join(blocks_of(there, "held"), "open")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    mine = lambda name: F.pmod(F.xxhash64("h1"), F.col(name)).cast("int")
    one = asks.join(blocks, "open").join(whole, "h1").select("open", mine("asked").alias("x"), every("held").alias("y"), "h1", "label", "elements")
    two = there.join(blocks, "open").join(whole, "h1").select("open", every("asked").alias("x"), mine("held").alias("y"), "h1", "label", "elements")
    key = ["open", "x", "y"]
    two = two.toDF(*two.columns)  # columns of its own, as both sides stem from members
    links_found = materialise(one.groupBy(*key).cogroup(two.groupBy(*key)).applyInArrow(lambda x, y: compare(x, y) if x.num_rows and y.num_rows else compare_none(), "a long, b long"), "opened")
    discard(asks)
    return links_found


def compare_none() -> pa.Table:
    return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def merge(labels: DataFrame, links_found: DataFrame) -> DataFrame:
    """labels after the groups of linked classes become one."""
    la = labels.select(F.col("h1").alias("a"), F.col("label").alias("u"))
    lb = labels.select(F.col("h1").alias("b"), F.col("label").alias("v"))
    edges = materialise(links_found.join(la, "a").join(lb, "b").where("u <> v").select("u", "v").distinct(), "edges")
    joined = components(edges)
    out = labels.join(joined.select(F.col("node").alias("label"), F.col("component").alias("to")), "label", "left")
    return materialise(out.select("h1", F.coalesce("to", "label").alias("label")), "labels")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of the rows of docs (which has doc_id and text): doc_id, n_shingles, h1, h2, x, y; and the classes of sets: h1, h2, doc_id (the smallest), group (h1 of a class)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    described = materialise(describe_sets(docs), "sets", "zstd")
    sets = described.where("chunk is null").drop("chunk", "counts")
    classes = materialise(sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min("x").alias("x")), "classes")
    texts = docs.select("text")
    counts = spark.sparkContext.broadcast(bucket_counts(described))
    shared = materialise(shared_rows(matrix_rows(texts, counts)), "shared")
    rows = materialise(placed_rows(shared, classes), "rows")
    discard(shared)
    sizes = rows.select("h1", "n").distinct()
    labels = materialise(sizes.select("h1", F.col("h1").alias("label")), "labels")
    held = Sets(texts, classes)
    tried = []
    for turn in range(ROUNDS):
        labelled = rows.join(labels, "h1") if turn else rows.withColumn("label", F.col("h1"))
        tried.append(verify(best_pivots(labelled, turn), held))
        labels = merge(labels, tried[-1].where("linked"))
    groups = merge(sizes.select("h1", F.col("h1").alias("label")), reduce(DataFrame.union, tried))
    members = groups.select("h1", F.col("label").alias("open")).join(labels, "h1").join(sizes, "h1")
    members = materialise(members.select("h1", "open", "label", "n"), "grouped")
    labels = merge(labels, opened(rows, members, held))
    for t in (rows, members, *tried, *held.tables):
        discard(t)
    named = classes.join(labels, "h1", "left").withColumn("group", F.coalesce("label", "h1"))
    return sets, materialise(named.select("h1", "h2", "doc_id", "group"), "members")


def classify(docs: DataFrame) -> DataFrame:
    """One row per row of docs (which has doc_id and text): doc_id, n_shingles, component_id."""
    sets, named = grouped(docs)
    smallest = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    of_class = materialise(named.join(smallest, "group").select("h1", "h2", "component_id"), "members")
    out = sets.join(of_class, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id (null last); documents without words stay.

    A document is a doc_id (which may be null, or repeat with other texts) and a text, known by two hashes, and is
    judged by its own text's group; of several with the smallest doc_id, that of the least hash stays. Rows that
    repeat a doc_id and its text are one document, and one of them stays.
    """
    sets, classes = grouped(docs)
    own = sets.where("n_shingles > 0").join(classes.select("h1", "h2", "group"), ["h1", "h2"])
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("d"), "x", "y")
    own = materialise(own.groupBy("group", "doc_id", "x", "y").agg(F.count("*").alias("count")).select("group", place.alias("place"), "count"), "places")
    first = own.groupBy("group").agg(F.min("place").alias("first"))
    others = own.join(first, "group").where("place <> first").select("place")
    repeated = own.where("count > 1").select("place")

    def listed(places: DataFrame) -> tuple[DataFrame, Column]:
        out = places.select(*(F.col(f"place.{c}").alias(f"__{c}") for c in ("d", "x", "y")))
        x, y = text_hashes()
        return out, F.col("doc_id").eqNullSafe(F.col("__d")) & (x == F.col("__x")) & (y == F.col("__y"))

    rest = docs.join(*listed(others), "left_anti")
    if not repeated.limit(1).count():
        return rest
    return rest.join(*listed(repeated), "left_anti").unionByName(rest.join(*listed(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))


REPORT_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS g FROM w
), n AS (SELECT doc_id, len(g) AS n FROM s), e AS (SELECT doc_id, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * k >= {SIMILARITY} * (p.n + q.n - k)),
b AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT u, v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(n.doc_id, min(r.v)), n.doc_id) AS component_id FROM n LEFT JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n"""
