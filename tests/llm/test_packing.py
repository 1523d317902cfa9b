import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from evenkeel.llm import packing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType())])


def exact(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.tokenizer_path())


def test_ids_are_the_tokenizers(encoder):
    odd = ["a<|endoftext|>b", "it's I'M don't 12_3 a__b", "\x1c x\x85y\x0b z ﬁ", "É É é", "²³", "a b", "ß ẞ İ", "x'S 'sx", "foo...bar  'll''ve", "_a_'_", "ªº", "", "  "]
    r = random.Random(2)
    odd += ["".join(r.choice("aé'st _9.\n\x1fÀ²ǅ字") for _ in range(40)) for _ in range(200)]
    for text in odd:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == exact(encoder.tokenizer, text), repr(text)


def best_fill(counts, capacity):
    sums = {0}
    for k, n in counts.items():
        sums = {s + i * k for s in sums for i in range(n + 1) if s + i * k <= capacity}
    return max(sums)


def test_fill_is_closest_to_capacity():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(r.randrange(0, 6))}
        capacity = r.randrange(0, 60)
        chosen = packing.fill(counts, capacity)
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == best_fill(counts, capacity)


def test_every_id_is_in_one_piece_and_sequences_have_no_gaps(spark, encoder):
    r = random.Random(4)
    texts = [None, "", "same text", "same text", "word " * 9000] + ["".join(r.choice(["the ", "Étion ", "x1 ", "of. "]) for _ in range(r.randrange(1, 900))) for _ in range(60)]
    rows = [(i if i != 7 else None, t, "kept") for i, t in enumerate(texts)] + [(3, "same text", "again")]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, t in enumerate(texts):
        ids = np.array(exact(encoder.tokenizer, t), "<u4")
        pieces = sorted(by_doc[i if i != 7 else None], key=lambda p: p.start)
        copies = 2 if i == 3 else 1
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY and {p.padded_to for p in pieces} == {at if at & (at - 1) == 0 else packing.CAPACITY}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert len(by_sequence) <= -(-sum(p.length for p in got) // packing.CAPACITY) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
