import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm import jaccard_join as jj
from evenkeel.llm.components import components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("component_id", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, *_) in enumerate(rows):
        g = find(i)
        groups[g] = d if groups.get(g) is None else min(groups[g], d if d is not None else groups[g])
    return sorted((repr(d), len(sets[i]), repr(groups[find(i)])) for i, (d, *_) in enumerate(rows))


def fixture(seed, n):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(400)]
    bases = [[r.choice(voc) for _ in range(r.choice([3, 6, 20, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases[:3] if r.random() < 0.6 else bases))
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = r.choice(voc)
        rows.append((i, (" " if r.random() < 0.5 else "\n").join(w).replace("w1", r.choice(["w1", "W1"])), "x"))
    return rows


def run(spark, rows):
    out = jj.classify(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    return sorted((repr(x.doc_id), x.n_shingles, repr(x.component_id)) for x in out)


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        rows = fixture(seed, 220)
        assert run(spark, rows) == brute(rows)


def test_bound_keeps_every_link():
    r = random.Random(9)
    for _ in range(300):
        n, m = r.randrange(1, 60), r.randrange(1, 60)
        if 100 * min(n, m) < 75 * max(n, m):
            continue
        least = -(-3 * (n + m) // 7)  # common elements of a link
        for common in range(least, min(n, m) + 1):
            order = list(range(n + m - common))
            r.shuffle(order)
            a, b = set(order[:n]), set(order[n - common :])
            p = lambda s: set(sorted(s)[: jj.prefix_length(len(s))])
            c = len(p(a) & p(b))
            assert c >= 1 and c >= (n + m) * 75 / 175 - max(n, m) * 75 / 100


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (4, "a b", "d"), (5, "A  B", "e"), (5, "A  B", "f"), (6, long, "g"), (7, long + " end", "h"), (None, "p q r s t u", "i"), (9, "p q r s t u", "j"), (8, "é ü", "k")]
    assert run(spark, rows) == brute(rows)
    assert jj.classify(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, "other", "z"), (3, "other", "z"), (4, None, "n"), (5, "", "m"), (None, "a b c d e f", "q")]
    df = spark.createDataFrame(rows, DOCS)
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5"]


def test_keep_one_judges_each_row_by_its_text(spark):
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (None, "clean and alone in its group", "x"), (None, "", "x"), (None, None, "x")]
    rows += [(3, "a b c d e f", "x"), (3, "a text that only this row has", "x"), (None, near, "x"), (None, near + " more", "x"), (7, "p q r s t u", "x"), (7, "P q r s t u", "x"), (7, "p q r s t u", "x")]
    kept = [(r.doc_id, r.text) for r in jj.keep_one(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
    plain = sorted(repr(x) for x in kept if x[1] not in (near, near + " more") and x[0] != 7)
    assert plain == sorted(repr(x) for x in [(1, "a b c d e f"), (None, "clean and alone in its group"), (None, ""), (None, None), (3, "a text that only this row has")])
    assert len(kept) == len(plain) + 2 and sum(d == 7 for d, _ in kept) == 1


def test_components_on_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 99)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def test_near_copies_without_links_do_not_meet(spark):
    r = random.Random(5)
    base = [f"b{i}" for i in range(170)]
    texts = []
    for i in range(80):  # six words of each differ, so that nearly no two link, but all share shingles
        own = set(r.sample(range(170), 6))
        texts.append((i, " ".join(f"e{i}x{k}" if k in own else w for k, w in enumerate(base)), "x"))
    docs = spark.createDataFrame(texts, DOCS).select("doc_id", "text")
    described = jj.describe_sets(docs)
    classes = described.where("n_shingles > 0").selectExpr("h1", "n_shingles AS n")
    counts = spark.sparkContext.broadcast(jj.bucket_counts(described))
    rows = jj.placed_rows(jj.shared_rows(jj.matrix_rows(docs.select("text"), counts)), classes)
    rows = rows.selectExpr("*", "h1 AS label", "1L AS own").cache()
    common = rows.alias("x").join(rows.alias("y"), "s").where("x.h1 < y.h1").count()
    assert common > 5000
    assert jj.meetings(rows).count() * 10 < common


def test_first_common_place_keeps_every_link(spark):
    rows = fixture(3, 160)
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    described = jj.describe_sets(docs)
    classes = described.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    counts = spark.sparkContext.broadcast(jj.bucket_counts(described))
    placed = jj.placed_rows(jj.shared_rows(jj.matrix_rows(docs.select("text"), counts)), classes).selectExpr("*", "h1 AS label", "1L AS own")
    met = {frozenset((x.h1, x.open)) for x in jj.meetings(placed).collect()}
    sets = {x.h1: shingle_set(rows[x.doc_id][1]) for x in classes.collect()}
    linked = [(a, b) for a, s in sets.items() for b, t in sets.items() if a < b and 100 * len(s & t) >= 75 * len(s | t)]
    assert len(linked) > 50
    assert not [(len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a, b in linked if frozenset((a, b)) not in met]
