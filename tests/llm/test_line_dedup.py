import hashlib
import random
import re

from pyspark.sql import types as T

from evenkeel.llm import line_dedup as ld

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("line_dedup", T.StringType())])


def token_set(line):
    w = re.findall(r"[^ \t\r\f\x0b]+", line.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """For each row its text after removal, by comparing every line with every earlier one."""
    documents = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    keys = {}
    seen = []
    for null, d, t in documents:
        stay = []
        for line in t.split("\n"):
            s = token_set(line)
            if not s:
                stay.append(line)
                continue
            if not any(100 * len(s & e) >= 75 * len(s | e) for e in seen):
                stay.append(line)
            seen.append(s)
        keys[null, d, t] = "\n".join(stay)
    return [None if t is None else keys[d is None, d or 0, t] for d, t in rows]


def fixture(seed):
    r = random.Random(seed)
    voc = ["the", "of", "a", "in"] + [f"é{i}" for i in range(150)]
    lines = [[r.choice(voc) for _ in range(r.choice([1, 4, 8, 30, 60]))] for _ in range(25)]
    rows = []
    for i in range(70):
        text = []
        for _ in range(r.randrange(1, 6)):
            w = list(lines[int(len(lines) * r.random() ** 2)])
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = r.choice(voc)
            text.append(r.choice([" ", "\t", "  "]).join(w).replace("the", r.choice(["the", "The"])))
        rows.append((i, "\n".join(text)))
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(d, t, len(t or ""), "x") for d, t in rows], DOCS).repartition(3)
    out = ld.mark(df)
    assert out.columns == [*df.columns, "line_dedup_"]
    return df, sorted(out.collect(), key=repr)


def check(spark, rows):
    # One document number has one text here, so that brute's order of equal numbers does not matter.
    df, got = result(spark, rows)
    assert sorted((repr(r.doc_id), repr(r["line_dedup_"].text)) for r in got) == sorted((repr(d), repr(t)) for (d, _), t in zip(rows, brute(rows), strict=True))
    return df


def test_matches_brute_force(spark):
    for seed in (1, 2, 3):
        check(spark, fixture(seed))


def test_odd_rows(spark):
    long = "\n".join(f"line {i} of {i * 7}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "same line here"), (5, "same line here"), (5, "same line here"), (6, " \t\nSame  line here\nnew words now"), (None, "same line here\nlast"), (8, long), (9, long + "\nmore text at the end")]
    df = check(spark, rows)
    kept = ld.deduplicate(df)
    assert kept.columns == df.columns
    by_id = {r.doc_id: r for r in kept.collect()}
    assert set(by_id) == {1, 2, 3, 4, 6, None, 8, 9}
    assert by_id[6].text == " \t\nnew words now" and by_id[6].n_chars == len(by_id[6].text)
    assert by_id[9].text == "more text at the end" and by_id[None].text == "last"


def test_empty_table(spark):
    assert ld.mark(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_no_python(spark):
    plan = ld.mark(spark.createDataFrame([(1, "a b", 3, "x")], DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def word_set(line):
    return frozenset(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()))


def word_fixture(seed):
    r = random.Random(seed)
    voc = ["the", "of", "a", "in"] + [f"é{i}" for i in range(150)]
    lines = [[r.choice(voc) for _ in range(r.choice([1, 2, 4, 8, 20]))] for _ in range(25)]
    rows = []
    for i in range(70):
        text = []
        for _ in range(r.randrange(1, 6)):
            w = list(lines[int(len(lines) * r.random() ** 2)])
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(voc)
            text.append(r.choice([" ", ", ", "  "]).join(w).replace("the", r.choice(["the", "The"])))
        rows.append((i, "\n".join(text)))
    return rows


def test_query_and_stage_match_brute_force_on_words(spark, monkeypatch):
    monkeypatch.setitem(globals(), "token_set", word_set)
    odd = [(100, None), (101, "...\nSame  line, here!\nnew words now"), (102, "same line here"), (103, "one two three four five six seven eight"), (104, "one two three FOUR, five six seven nine. eight")]
    for seed in (1, 2):
        rows = word_fixture(seed) + odd
        df = spark.createDataFrame([(d, t, len(t or ""), "x") for d, t in rows], DOCS).repartition(3)
        want = dict(zip((d for d, _ in rows), brute(rows), strict=True))
        got = {r.doc_id: r for r in ld.report(df).collect()}
        assert {d: r.text_sha256 for d, r in got.items()} == {d: None if t is None else hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
        assert got[102].n_removed == got[104].n_removed == 1 and got[101].n_removed == 0
        kept = {r.doc_id: r.text for r in ld.deduplicate(df).collect()}
        assert kept == {d: t for d, t in want.items() if t is None or any(map(word_set, t.split("\n"))) or not any(map(word_set, dict(rows)[d].split("\n")))}


def test_order_of_equal_and_missing_doc_ids(spark):
    from pyspark.sql import functions as F

    near = [f"alpha beta gamma delta epsilon zeta eta theta {w}" for w in "abcdefghijkl"]
    rows = [(7, f"{t}\nonly here {i} xyz") for i, t in enumerate(near[:6])] + [(None, t) for t in near[6:]] + [(7, near[0] + "\nonly here 0 xyz")]
    df = spark.createDataFrame([(d, t, len(t), "x") for d, t in rows], DOCS).repartition(3)
    key = {r.text: (r.a, r.b) for r in df.select("text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")).collect()}
    first = min((d is None, d or 0, *key[t]) for d, t in rows)
    for r in ld.mark(df, rule=ld.WORDS).collect():
        stays = (r.doc_id is None, r.doc_id or 0, *key[r.text]) == first
        lines = r.text.split("\n")
        assert r["line_dedup_"].text == "\n".join(lines if stays else lines[1:])
        assert r["line_dedup_"].emptied == (len(lines) == 1 and not stays)
