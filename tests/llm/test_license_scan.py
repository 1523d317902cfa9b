import random
import re

from pyspark.sql import types as T

from evenkeel.llm import license_scan as ls

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("labels", T.StringType())])


def brute(text):
    """(n_base, first, last, base_labels) by looking at every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for label, phrase in ls.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark):
    r = random.Random(1)
    voc = ["MIT", "License", "apache", "general", "public", "license.", "é", "x1", "general public"]
    texts = [" ".join(r.choice(voc) for _ in range(r.randrange(0, 40))) for _ in range(80)]
    texts += [None, "", "mit license " * 4000, "mit\nLICENSE", "mitlicense", "general public licensed"]
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x")]
    got = sorted((repr(x.doc_id), x.n_base, x.first_word, x.last_word, x.base_labels) for x in ls.scan_licenses(spark.createDataFrame(rows, DOCS).repartition(3)).collect())
    assert repr(got) == repr(sorted((repr(d), *brute(t)) for d, t, _ in rows))


def test_longer_templates_survive_edits(spark):
    long = ls.TEMPLATES["mit"][1]
    words = long.split()
    texts = ["intro words here " + long + " tail", " ".join(words[:8] + ["newly"] + words[8:]), " ".join(words[:4]) + " something else", "This work is licensed under CC BY-NC 4.0.", "of the and to"]
    got = {x.doc_id: x for x in ls.scan_licenses(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOCS)).collect()}
    assert [got[i].labels for i in range(5)] == ["mit", "mit", "", "cc-by-nc", ""]
    assert got[0].score == 1.0 and 0.75 <= got[1].score <= 1 and got[4].score < 0.75 and got[0].n_base == 0


def test_empty_table(spark):
    assert ls.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
