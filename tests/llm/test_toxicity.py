import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from evenkeel.llm import toxicity as tox
from evenkeel.llm.wordscan import ALNUM, scan_column

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("toxicity", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def outputs(text, stems=()):
    """What the composed grammar writes for each clause with a core word."""
    lexicon = tox.Lexicon(dict(stems))
    words = scan_column(pa.array([text]), ALNUM)
    data = words.data.tobytes()
    out = []
    for symbols in tox.clauses(words, data, lexicon, 0, len(words.starts), np.arange(len(words.starts))):
        state, row = 0, []
        for s in symbols:
            state, written = tox.GRAMMAR[state][s]
            row.append(written)
        out.append([w for w in row if w[0] in "IT" or w[2]])
    return out


def test_grammar():
    assert outputs("you idiot") == [[("I", 3, "aimed")]]
    assert outputs("an idiot, you know") == [[("I", 3, "")]]
    assert outputs("idiot that you are") == [[("I", 3, ""), ("Y", 3, "aimed")]]
    assert outputs("he is not an idiot") == [[("I", 3, "soft")]]
    assert outputs("they said it was stupid trash") == [[("I", 3, "quoted"), ("I", 3, "quoted")]]
    assert outputs("I will kill you") == [[("T", 0, ""), ("Y", 0, "aimed")]]
    assert outputs("nice day. nothing here") == []
    assert outputs("the lowenring ran", [("lowe", 1)]) == [[("I", 1, "")]]


def corpus(n=900, seed=3):
    r = random.Random(seed)
    voc = ["".join(r.choice("abcdeghimnorstu") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 7 == 0
        words = [r.choice(voc) for _ in range(r.randrange(10, 120))]
        if bad:
            for _ in range(r.randrange(1, 5)):
                words[r.randrange(len(words))] = r.choice(["scum", "zzq" + r.choice(voc)])
        rows.append((i, ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)), "x"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_learned_stems(spark):
    rows, labels = corpus()
    rows += [(None, "you scum", "x"), (10_000, None, "x"), (10_001, "", "x"), (10_001, "", "x"), (10_002, "word " * 60_000, "x")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), (50_000, 0, 1)], LABELS)
    model = tox.train(docs, marks)
    assert any(s.startswith("zzq") or "zzq".startswith(s) for s in model.stems)
    assert model == tox.train(docs.repartition(5), marks)
    got = {r.doc_id: r for r in tox.report(docs, marks).collect()}
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(900) if got[i].held_out} == set(held)
    assert sum(got[i].predicted == (i % 7 == 0) for i in held) >= 0.97 * len(held)
    assert not got[10_000].predicted and not got[10_001].predicted
    kept = tox.reject(docs, marks)
    assert kept.columns == docs.columns and {10_000, 10_001, 10_002} <= {r.doc_id for r in kept.collect()}


def test_negated_and_reported_clauses_score_lower(spark):
    rows, labels = corpus()
    model = tox.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    for trained in (model, tox.Model({}, tox.PRIOR)):
        of = lambda text: float(trained.scores(tox.features(scan_column(pa.array([text]), ALNUM), tox.Lexicon(trained.stems)))[0])
        for plain, others in {
            "he is an idiot": ["he is not an idiot", "he isn't an idiot", "he isn’t an idiot", "they said he is an idiot"],
            "we will hurt you": ["we will never hurt you", "we won't hurt you", "she claimed we will hurt you"],
        }.items():
            assert all(of(other) <= of(plain) for other in others)
        assert all(of(other) < of("he is an idiot") for other in ("he isn't an idiot", "he isn’t an idiot", "they said he is an idiot"))
    assert all(w * sign >= 0 for w, sign in zip(model.weights, tox.SIGNS))


def test_arc_weights():
    def weight(text):
        words = scan_column(pa.array([text]), ALNUM)
        state = total = 0
        for symbols in tox.clauses(words, words.data.tobytes(), tox.Lexicon({}), 0, len(words.starts), np.arange(len(words.starts))):
            for s in symbols:
                total += tox.ARC_WEIGHTS[state][s]
                state = tox.GRAMMAR[state][s][0]
        return total

    assert weight("you idiot") > weight("an idiot") > weight("never an idiot") > 0
    assert weight("a total idiot") > weight("a idiot") > weight("said a idiot")
    assert weight("we will burn you") > weight("we burn you") > weight("we burn") > weight("we never burn")


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    assert tox.train(docs, spark.createDataFrame(labels, LABELS)) == tox.train(docs, spark.createDataFrame(turned, LABELS))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you are a stupid worthless idiot, you scum", "x"), (2, "a calm text", "x")], DOCS)
    got = {r.doc_id: r.predicted for r in tox.report(docs, spark.createDataFrame([], LABELS)).collect()}
    assert got == {1: 1, 2: 0}
    assert tox.report(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
