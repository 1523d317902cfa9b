import hashlib
import random

from pyspark.sql import types as T

from evenkeel.llm import warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("payload", T.StringType())])


def fixture():
    r = random.Random(1)
    big = ["x" * 1000, "é" * 500, "y\r\n\r\n" * 300]
    rows = [(i, f"http://h{i % 5}.Example.org:8080/p/{i % 7}?q={i % 3}", r.choice([*big, big[0], "small", "z" * 999, f"own {i} " * 200]), "x") for i in range(-5, 400)]
    return rows + [(900, None, None, "x"), (901, "", "", "x"), (902, "no scheme\there", big[0], "x"), (902, "no scheme\there", big[0], "x"), (None, "http://n/", big[1], "x"), (903, "http://a/", "long " * 200_000, "x")]


def brute(rows):
    top = {}
    for p, _, h, _ in rows:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    out = []
    for p, _, h, _ in rows:
        data = (h or "").encode()
        t = top.get(h or "")
        again = len(data) >= 1000 and t is not None and p != t
        out.append((repr(p), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", repr(t if again else None)))
    return sorted(out)


def test_report_matches_brute_force(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, repr(r.refers_to)) for r in warc.report(df).collect())
    assert got == brute(rows)


def test_lookup_of_some_and_of_none(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, PAGES)
    shards, root = warc.archive(df)
    asked = df.where("page_id in (3, 77)").select("page_id", "url")
    assert sorted(r.page_id for r in warc.lookup(asked, shards, root).collect()) == [3, 77]
    nothing = spark.createDataFrame([(3, "http://other.org/"), (-99, "http://h1.example.org/")], "page_id long, url string")
    assert warc.lookup(nothing, shards, root).count() == 0


def test_keys_and_records():
    assert warc.url_key("http://www.A.example.com:80/x?y") == "com,example,a,www)/x?y"
    assert warc.url_key(None) == "" and warc.url_key("https://u@b.org") == "org,b)"
    keys = [warc.sort_key(*k) for k in (("a", None), ("a", -3), ("a", 5), ("a)", 0), ("b", 1))]
    assert keys == sorted(keys)
    digest = hashlib.sha1(b"body").hexdigest()
    one = warc.parse(warc.record(7, "http://a/\n", b"body", digest, None))
    assert (one["page_id"], one["payload"], one["payload_digest"], one["record_type"]) == (7, b"body", digest, "response")
    two = warc.parse(warc.record(6, None, b"body", digest, 7))
    assert (two["payload"], two["payload_bytes"], two["payload_digest"], two["refers_to"]) == (None, 4, digest, 7)


def test_empty_table(spark):
    assert warc.report(spark.createDataFrame([], PAGES)).count() == 0
