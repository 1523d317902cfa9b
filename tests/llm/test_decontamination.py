import hashlib
import random
import re

from pyspark.sql import types as T

from evenkeel.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("decontamination", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        n = min(10, len(iw))
        for j in range(len(iw) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[j : j + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    names = sorted(found)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def fixture():
    r = random.Random(5)
    voc = ["the", "of", "Élan", "x1", "ab", "straße", "to", "a", "Z", "q9"]
    make = lambda n: " ".join(r.choice(voc) for _ in range(n))
    items = [(i, make(r.choice([3, 9, 10, 14, 30]))) for i in range(12)] + [(12, None), (13, ""), (3, make(12))]
    docs = [(i, ", ".join(r.choice([make(9), items[r.randrange(12)][1], items[0][1][:15]]) for _ in range(r.randrange(6))), "kept") for i in range(60)]
    docs += [(60, None, None), (61, "", ""), (61, "", ""), (None, items[4][1].upper().replace("É", "é"), "x"), (62, items[5][1] + "\n" + "the " * 5000, "y")]
    return docs, items


def test_matches_brute_force_in_one_block_and_in_many(spark):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = sorted((repr(d), *brute(t, items)) for d, t, _ in docs)
    for most in (1 << 20, 60):
        out = dec.annotate(df, bench, most_bytes=most)
        assert out.columns == ["doc_id", "text", "decontamination", "decontamination_"]
        got = sorted((repr(r[0]), r[3].n_words, r[3].n_hit, r[3].n_items, r[3].items_sha256, r[3].contaminated) for r in out.collect())
        assert got == want


def test_spans_and_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x y " + item + " z", None), (2, "w1 w2", None)], DOCS)
    got = {r[0]: r[3] for r in dec.annotate(docs, spark.createDataFrame([(7, item)], ITEMS)).collect()}
    assert [tuple(s) for s in got[1].spans] == [(2, 20)] and got[1].longest == 20
    assert not got[2].contaminated and got[2].spans == []


def test_empty_tables_and_removal(spark):
    docs, items = fixture()
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)
    assert dec.annotate(none, bench).count() == 0
    df = spark.createDataFrame(docs, DOCS)
    assert dec.decontaminate(df, spark.createDataFrame([], ITEMS)).count() == len(docs)
    kept = dec.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not brute(t, items)[-1] for _, t, _ in docs)
