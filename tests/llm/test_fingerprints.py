import hashlib
import random

from pyspark.sql import types as T

from evenkeel.llm import fingerprints as fp

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fingerprint", T.StringType())])


def plain_walk(text):
    """The embedding by its definition, one step at a time."""
    symbols, out = fp.symbols_of(text), []
    for b in range(-(-len(symbols) // fp.BLOCK)):
        piece = symbols[b * fp.BLOCK : (b + 1) * fp.BLOCK]
        i, row = 0, []
        for j in range(fp.STEPS // fp.BLOCK * len(piece)):
            c = int(piece[i]) if i < len(piece) else 0
            row.append(c)
            i = min(i + int(fp.MOVES[j][c]), len(piece))
        out.append(row)
    return out


def make(r, n):
    return "".join(r.choice("abcdefgh ijé\n😀") for _ in range(n))


def test_walk_matches_definition():
    r = random.Random(1)
    texts = [make(r, n) for n in (0, 1, 2, 50, 1023, 1024, 1025, 2500)]
    for t, w in zip(texts, fp.walk([fp.symbols_of(t) for t in texts]), strict=True):
        for got, want in zip(w, plain_walk(t), strict=True):
            assert got[: len(want)].tolist() == want


def test_likeness_follows_edit_distance():
    r = random.Random(2)
    for n in (200, 3000, 9000):
        means = []
        for edits in (0, n // 200, n // 20, n // 4):
            trials = []
            for _ in range(8):
                base = make(r, n)
                t = list(base)
                for _ in range(edits):
                    k = r.randrange(len(t))
                    t[k : k + r.randrange(2)] = r.choice(["", "x", "yz"])
                trials.append(fp.likeness(*fp.fingerprints([base, "".join(t)])))
            means.append(sum(trials) / len(trials))
        other = fp.likeness(*fp.fingerprints([make(r, n), make(r, n)]))
        assert means[0] == 1 and means[1] > means[2] > means[3] and means[1] > 0.5 > 0.4 > other
    a, b = fp.fingerprints([make(r, 300), make(r, 5000)])
    assert 0 <= fp.likeness(a, b) == fp.likeness(b, a) < 0.4
    assert fp.fingerprints([""])[0] == "0:" and fp.likeness("0:", "0:") == 1 and fp.likeness("0:", a) == 0


def brute(rows):
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    out = []
    for k, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + after[:n]
        a, b, c = fp.fingerprints([t, changed, after])
        out.append((repr(d), len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out)


def test_report_in_one_range_and_in_many(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i * 3 - 40, make(r, r.randrange(0, 400)), "x") for i in range(70)] + [(5, None, "x"), (None, "null id", "x"), (500, "twice", "x"), (500, "twice", "x"), (501, make(r, 30_000), "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    for size in (20_000, 9):
        monkeypatch.setattr(fp, "ROWS_A_PART", size)
        assert sorted((repr(x.doc_id), *list(x)[1:]) for x in fp.report(docs).collect()) == brute(rows)
    assert fp.report(spark.createDataFrame([], DOCS)).count() == 0
    one = fp.report(spark.createDataFrame([(1, "abcabc", "x")], DOCS)).first()
    assert one.near_next == 1 and one.n_chars == 6


def test_near_pairs(spark):
    r = random.Random(4)
    base = make(r, 2000)
    texts = [base, base[:900] + "Q" * 60 + base[960:], base, make(r, 2000), make(r, 1500)]
    prints = spark.createDataFrame(list(enumerate(fp.fingerprints(texts))), "id long, fingerprint string")
    assert [(x.a, x.b) for x in fp.near_pairs(prints).collect()] == [(0, 1)]


def test_near_pairs_in_crowded_bands(spark):
    r = random.Random(5)
    texts = ["a", "b", "ab", "ba", "aab", "aabb", "aabbc", "", "é"]
    for _ in range(3):
        base = make(r, 1200)
        for _ in range(25):
            t = list(base)
            for _ in range(r.randrange(1, 40)):
                k = r.randrange(len(t))
                t[k] = r.choice("xyz")
            texts.append("".join(t))
    prints = fp.fingerprints(texts)
    first = {f: i for i, f in reversed(list(enumerate(prints)))}
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and fp.likeness(prints[a], prints[b]) >= 0.75}
    got = {(x.a, x.b) for x in fp.near_pairs(spark.createDataFrame(list(enumerate(prints)), "id long, fingerprint string")).collect()}
    assert got <= want and len(want) > 200 and len(got) >= 0.9 * len(want)
    short = {(a, b) for a, b in want if a < 9 and b < 9}
    assert short <= got
    few = spark.createDataFrame(list(enumerate(fp.fingerprints(["a", "b", "ab"]))), "id long, fingerprint string")
    f = [x.fingerprint for x in few.collect()]
    assert {(x.a, x.b) for x in fp.near_pairs(few, 0.3).collect()} == {(a, b) for a in range(3) for b in range(a + 1, 3) if fp.likeness(f[a], f[b]) >= 0.3}
