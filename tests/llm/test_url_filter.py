import datetime
import random

from pyspark.sql import types as T

from evenkeel.llm import url_filter as uf

CAPTURES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("day", T.DateType()), T.StructField("url_filter", T.StringType())])
ENTRIES = "key string, list string, day date, op string"
DAY = datetime.date(2024, 1, 1)


def at(n):
    return None if n is None else DAY + datetime.timedelta(n)


def brute(url, day, entries):
    head, mark, rest = (url or "").partition("://")
    host = rest.split("/")[0].split("?")[0].split("@")[-1].split(":")[0].lower().rstrip(".") if mark else ""
    if not host:
        return None, None, "none", True
    best = None
    parts = host.split(".")
    for k in range(len(parts)):
        key = ".".join(parts[k:])
        for kind in ("block", "allow"):
            days = {}
            for e in entries:
                if e[0] and e[0].lower().rstrip(".") == key and e[1] == kind and e[2] and e[3] in ("add", "remove") and day is not None and e[2] <= day:
                    days.setdefault(e[2], set()).add(e[3])
            if days and "add" in days[max(days)] and best is None:
                best = (key, kind)
    return host, best and best[0], best[1] if best else "none", not best or best[1] != "block"


def test_matches_brute_force(spark):
    r = random.Random(1)
    hosts = ["a.example.org", "b.example.org", "example.org", "org", "x.net", "EXAMPLE.org."]
    entries = [(r.choice([*hosts, None]), r.choice(["block", "allow", "odd"]), at(r.choice([*range(12), None])), r.choice(["add", "add", "remove", "odd"])) for _ in range(60)]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(['', 'me@'])}{r.choice(hosts)}{r.choice(['', ':80', '/p', '/p?q'])}" for _ in range(150)] + [None, "", "nothing", "http:///x"]
    rows = [(i, u, at(r.choice([*range(-2, 14), None])), "x") for i, u in enumerate(urls)] + [(3, urls[3], at(5), "x")] * 2 + [(None, urls[4], at(5), "x")]
    out = uf.judge(spark.createDataFrame(rows, CAPTURES).repartition(3), spark.createDataFrame(entries, ENTRIES))
    assert out.columns == ["page_id", "url", "day", "url_filter", "url_filter_"]
    got = sorted((repr(x.page_id), repr(tuple(x[4]))) for x in out.collect())
    assert got == sorted((repr(p), repr(brute(u, d, entries))) for p, u, d, _ in rows)


def test_empty_tables(spark):
    none, list_ = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], ENTRIES)
    assert uf.judge(none, list_).count() == 0
    row = uf.judge(spark.createDataFrame([(1, "http://a.b/", DAY, "x")], CAPTURES), list_).first()
    assert tuple(row[4]) == ("a.b", None, "none", True)


def test_one_key_with_thousands_of_entries(spark):
    entries = [("hot.example", "block", at(2 * d), "add" if d % 2 else "remove") for d in range(3000)] + [("hot.example", "allow", at(100), "add")]
    rows = [(i, "https://a.hot.example/p", at(37 * i % 6100 - 20), "x") for i in range(300)]
    out = uf.judge(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    last = {d: (d // 2) % 2 == 1 for d in range(6000)}
    for r in out.collect():
        d = (r.day - DAY).days
        blocked = last[d] if 0 <= d < 6000 else d >= 6000
        assert r["url_filter_"].list == ("block" if blocked else "allow" if d >= 100 else "none"), d
