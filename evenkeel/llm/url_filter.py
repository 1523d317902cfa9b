"""URL filters by a temporal list join. DataFrame operations only.

A list has dated entries: from a day on, a host or domain is added to or removed from the block or the
allow list. Entries become validity intervals, [day of an "add", day of the key's next entry on that
list). A capture is judged by the entries active on the day of its fetch, of its host and all parent
domains: the one with the longest key decides, and block beats allow on the same key.

The as-of join puts the starts and ends of a key's intervals and the days it is asked for in one order and
takes the last state before each day asked. A key has one row for a day there, however many captures ask,
and only keys that are listed come so far; so a key with thousands of entries, or asked by a third of all
captures, is a short list. The verdict hangs on host and day alone: captures meet it by that pair, a join
with one row on the other side, which Spark splits where a pair is hot.

Defined cases: a url without a host, or null, is not on any list; a null day is after no entry; of
entries for one key, list and day "add" counts; entries with a null key, day or an unknown operation are
left out; repeated captures each get a row; empty tables give no rows, an empty list no blocks; further
columns pass through, and added names that clash get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import fresh_name

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """key, list, since, until: when a key is on a list; until is null where it still is. entries: key, list, day, op."""
    good = entries.where("key is not null and day is not null and list in ('block', 'allow') and op in ('add', 'remove')")
    days = good.groupBy(F.rtrim(F.lower("key"), F.lit(".")).alias("key"), "list", F.col("day").cast("date").alias("since")).agg(F.min("op").alias("op"))
    until = F.lead("since").over(Window.partitionBy("key", "list").orderBy("since"))
    return days.withColumn("until", until).where("op = 'add'").select("key", "list", "since", "until")


def active_keys(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """key, day, list of the days asked for (key, day) on which the key is listed: an as-of join with intervals. Block beats allow."""
    ends = spans.where("until is not null").select("key", "list", F.col("until").alias("day"), F.lit(0).alias("turn"))
    starts = spans.select("key", "list", F.col("since").alias("day"), F.lit(1).alias("turn"))  # after an end of the same day
    changes = ends.union(starts)
    listed = asked.select("key", "day").distinct().join(spans.select("key").distinct(), "key", "left_semi")
    line = changes.union(listed.select("key", F.lit(None).cast("string"), "day", F.lit(2)))
    upto = Window.partitionBy("key").orderBy("day", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = lambda kind: F.last(F.when(F.col("list") == kind, F.col("turn") == 1), ignorenulls=True).over(upto)
    states = line.select("key", "day", "turn", on("block").alias("block"), on("allow").alias("allow")).where("turn = 2 and (block or allow)")
    return states.select("key", "day", F.when(F.col("block"), "block").otherwise("allow").alias("list"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """captures with a struct: host, matched (the deciding key), list ("block", "allow" or "none"), kept."""
    name = fresh_name(captures.columns, "url_filter")
    rows = captures.select(F.struct(*(F.col(f"`{c}`") for c in captures.columns)).alias("row"), host_of(F.col(f"`{url_col}`").cast("string")).alias("host"), F.col(f"`{day_col}`").cast("date").alias("day"))
    pairs = rows.where("host is not null and day is not null").select("host", "day").distinct()
    labels = F.split("host", r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = pairs.select("host", "day", F.explode(keys).alias("key"))
    active = asked.join(active_keys(asked, intervals(entries)), ["key", "day"])
    best = F.max(F.struct(F.length("key").alias("n"), "key", "list"))
    verdict = active.groupBy(F.col("host").alias("h"), F.col("day").alias("d")).agg(best.alias("v"))
    met = rows.join(verdict, (F.col("host") == F.col("h")) & (F.col("day") == F.col("d")), "left")
    listed = F.coalesce("v.list", F.lit("none"))
    out = F.struct("host", F.col("v.key").alias("matched"), listed.alias("list"), (listed != "block").alias("kept"))
    return met.select(*(F.col("row").getField(c).alias(c) for c in captures.columns), out.alias(name))


def example_days(pages: DataFrame) -> DataFrame:
    """pages with the day of fetch that the query gives them: two years from 2023, by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")).alias("day"))


def example_entries(pages: DataFrame) -> DataFrame:
    """The query's list, made of all hosts of pages: some added, some removed and added again, some allowed, and a domain."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    number = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int")
    rows = hosts.select("key", number.alias("k"))
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    first = F.col("k") % 500
    entry = lambda test, kind, when, op: F.when(test, F.struct(F.lit(kind).alias("list"), when.alias("day"), F.lit(op).alias("op")))
    each = F.array(
        entry(F.col("k") % 3 == 0, "block", day(first), "add"),
        entry(F.col("k") % 6 == 0, "block", day(first + 90), "remove"),
        entry(F.col("k") % 12 == 0, "block", day(first + 150), "add"),
        entry(F.col("k") % 5 == 1, "allow", day(first + 30), "add"),
    )
    own = rows.select("key", F.explode(each).alias("e")).where("e is not null").select("key", "e.list", "e.day", "e.op")
    domain = pages.sparkSession.createDataFrame([("example.org", "block", "2023-06-01", "add"), ("example.org", "block", "2024-03-01", "remove")], "key string, list string, day string, op string")
    return own.unionByName(domain.withColumn("day", F.col("day").cast("date")))


def report(pages: DataFrame) -> DataFrame:
    """page_id, host, fetched, matched, list, kept."""
    judged = judge(example_days(pages), example_entries(pages))
    v = F.col(judged.columns[-1])
    return judged.select("page_id", v["host"].alias("host"), F.col("day").cast("string").alias("fetched"), v["matched"].alias("matched"), v["list"].alias("list"), v["kept"].alias("kept"))


REPORT_SQL = r"""
WITH c AS (
    SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
        DATE '2023-01-01' + CAST(((page_id % 730) + 730) % 730 AS INTEGER) AS day
    FROM pages
), h AS (
    SELECT host AS key, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS k FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)
), e AS (
    SELECT key, 'block' AS list, DATE '2023-01-01' + CAST(k % 500 AS INTEGER) AS day, 'add' AS op FROM h WHERE k % 3 = 0
    UNION ALL SELECT key, 'block', DATE '2023-01-01' + CAST(k % 500 + 90 AS INTEGER), 'remove' FROM h WHERE k % 6 = 0
    UNION ALL SELECT key, 'block', DATE '2023-01-01' + CAST(k % 500 + 150 AS INTEGER), 'add' FROM h WHERE k % 12 = 0
    UNION ALL SELECT key, 'allow', DATE '2023-01-01' + CAST(k % 500 + 30 AS INTEGER), 'add' FROM h WHERE k % 5 = 1
    UNION ALL SELECT 'example.org', 'block', DATE '2023-06-01', 'add'
    UNION ALL SELECT 'example.org', 'block', DATE '2024-03-01', 'remove'
), d AS (SELECT key, list, day, min(op) AS op FROM e GROUP BY ALL),
i AS (SELECT *, lead(day) OVER (PARTITION BY key, list ORDER BY day) AS until FROM d),
v AS (
    SELECT p.host, p.day, max(struct_pack(n := length(i.key), block := i.list = 'block', key := i.key, list := i.list)) AS v
    FROM (SELECT DISTINCT host, day FROM c WHERE host IS NOT NULL AND day IS NOT NULL) p
    JOIN i ON i.op = 'add' AND (p.host = i.key OR ends_with(p.host, '.' || i.key)) AND i.day <= p.day AND (i.until IS NULL OR p.day < i.until)
    GROUP BY ALL
)
SELECT c.page_id, c.host, CAST(c.day AS VARCHAR) AS fetched, v.v.key AS matched, coalesce(v.v.list, 'none') AS list,
    coalesce(v.v.list, 'none') <> 'block' AS kept
FROM c LEFT JOIN v ON c.host = v.host AND c.day = v.day"""
