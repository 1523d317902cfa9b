"""Queries that go through what users call: compare() in its modes, sources by a round trip, reports parsed back.

They add to the catalogue's. The pair is the catalogue's orders and their perturbed copy.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sqlite3
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.config import ReconConfig
from evenkeel.plans.catalogue import CHANGED_SQL, ORACLE_SQL, ORDERS, QUERIES, SIDES_SQL, counters_sql, orders_right, query, read
from evenkeel.plans.compare import compare
from evenkeel.result import COUNTERS
from evenkeel.scratch import scratch_path
from evenkeel.sources import SqlTable, source
from evenkeel.types import PartitionSpec

__all__ = ["ORACLE_SQL", "QUERIES"]  # the catalogue's and these

NO_COUNTERS = ", ".join(f"0::BIGINT AS {c}" for c in COUNTERS)


def pair(spark, sf) -> tuple[DataFrame, DataFrame]:
    left = read(spark, sf, "orders")
    return left, orders_right(left)


def result_sql(counts: str, schema: str = "true", data: str | None = None) -> str:
    """A row of ReconResult.to_df() from a query of its counts."""
    clean = data or f"({' AND '.join(f'{c} = 0' for c in COUNTERS)} AND row_count_left = row_count_right)"
    return f"SELECT CASE WHEN {schema} AND {clean} THEN 'MATCH' ELSE 'MISMATCH' END AS status, row_count_left, row_count_right, {schema} AS schema_match, {clean} AS data_match, {', '.join(COUNTERS)} FROM ({counts})"


KEYED_SQL = f"WITH {SIDES_SQL} {result_sql(counters_sql(['o_orderkey'], ORDERS))}"
ROWS_SQL = f"SELECT (SELECT count(*) FROM L) AS row_count_left, (SELECT count(*) FROM R) AS row_count_right, {NO_COUNTERS}"
SAME_SQL = f"SELECT (SELECT count(*) FROM orders) AS row_count_left, (SELECT count(*) FROM orders) AS row_count_right, {NO_COUNTERS}"


@query("compare_keyed", KEYED_SQL)
def compare_keyed(spark, sf):
    return compare(*pair(spark, sf), keys="o_orderkey", spark=spark).to_df(spark)


@query("compare_keyed_without_fast_path", KEYED_SQL)
def compare_keyed_without_fast_path(spark, sf):
    return compare(*pair(spark, sf), keys=["o_orderkey"], config=ReconConfig(fast_path=False, sample_limit=0), spark=spark).to_df(spark)


@query("compare_equal", result_sql(SAME_SQL))
def compare_equal(spark, sf):
    left = read(spark, sf, "orders")
    return compare(left, left.repartition(3), keys="o_orderkey", spark=spark).to_df(spark)


@query("compare_tolerances", f"WITH {SIDES_SQL} {result_sql(counters_sql(['o_orderkey'], ORDERS).replace('a.o_totalprice IS DISTINCT FROM b.o_totalprice', 'abs(a.o_totalprice - b.o_totalprice) > 1'))}")
def compare_tolerances(spark, sf):
    return compare(*pair(spark, sf), keys="o_orderkey", tolerances={"o_totalprice": 1.0}, spark=spark).to_df(spark)


@query("compare_some_columns", f"WITH {SIDES_SQL} {result_sql(counters_sql(['o_orderkey'], ['o_custkey', 'o_totalprice']))}")
def compare_some_columns(spark, sf):
    return compare(*pair(spark, sf), keys="o_orderkey", columns=["o_custkey", "o_totalprice", "o_orderstatus"], exclude_columns=["o_orderstatus"], spark=spark).to_df(spark)


@query("compare_duplicates", f"WITH L AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), R AS (SELECT * FROM L WHERE l_orderkey % 300 <> 7) {result_sql(counters_sql(['l_orderkey', 'l_linenumber'], ['l_quantity']))}")
def compare_duplicates(spark, sf):
    left = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return compare(left, left.where("l_orderkey % 300 <> 7"), keys=["l_orderkey", "l_linenumber"], spark=spark).to_df(spark)


@query("compare_keys_of_two_types", f"WITH {SIDES_SQL} {result_sql(counters_sql(['o_orderkey'], ['o_custkey']))}")
def compare_keys_of_two_types(spark, sf):
    left, right = (df.select("o_orderkey", "o_custkey") for df in pair(spark, sf))
    return compare(left, right.withColumn("o_orderkey", F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))), keys="o_orderkey", spark=spark).to_df(spark)


@query("compare_rowcount", f"WITH {SIDES_SQL} {result_sql(ROWS_SQL, data='(row_count_left = row_count_right)')}")
def compare_rowcount(spark, sf):
    return compare(*pair(spark, sf), compare_mode="rowcount", spark=spark).to_df(spark)


@query("compare_schema", result_sql(f"SELECT 0::BIGINT AS row_count_left, 0::BIGINT AS row_count_right, {NO_COUNTERS}", schema="(SELECT count(*) = 0 FROM (SELECT unnest(['o_clerk'])))", data="true"))
def compare_schema(spark, sf):
    left, right = pair(spark, sf)
    return compare(left, right.withColumn("o_clerk", F.lit("x")), compare_mode="schema", spark=spark).to_df(spark)


@query("compare_names_only", f"WITH {SIDES_SQL} {result_sql(ROWS_SQL, data='(row_count_left = row_count_right)')}")
def compare_names_only(spark, sf):
    left, right = pair(spark, sf)
    return compare(left, right.withColumn("o_custkey", F.col("o_custkey").cast("string")), compare_mode="names_only", spark=spark).to_df(spark)


def hash_sql(differ: str) -> str:
    return f"WITH {SIDES_SQL} {result_sql(ROWS_SQL, data=f'(NOT EXISTS ({differ}))')}"


@query("compare_hash", hash_sql(f"(SELECT {', '.join(ORDERS)} FROM L EXCEPT ALL SELECT {', '.join(ORDERS)} FROM R) UNION ALL (SELECT {', '.join(ORDERS)} FROM R EXCEPT ALL SELECT {', '.join(ORDERS)} FROM L)"))
def compare_hash(spark, sf):
    return compare(*pair(spark, sf), keys="o_orderkey", compare_mode="hash", spark=spark).to_df(spark)


@query("compare_profile", f"WITH {SIDES_SQL} {result_sql(ROWS_SQL, data='(row_count_left = row_count_right)')}")
def compare_profile(spark, sf):
    return compare(*pair(spark, sf), compare_mode="profile", spark=spark).to_df(spark)


@query("compare_sampled", f"WITH {SIDES_SQL}, R2 AS (SELECT * FROM R WHERE o_orderkey IN (SELECT o_orderkey FROM L)) {result_sql(counters_sql(['o_orderkey'], ORDERS, 'L', 'R2'))}")
def compare_sampled(spark, sf):
    left, right = pair(spark, sf)
    config = ReconConfig(sample_size_keyed=left.count(), fast_path=False)  # all keys, so that SQL has the same sample
    return compare(left, right, keys="o_orderkey", compare_mode="sampled", config=config, spark=spark).to_df(spark)


PART_COUNTS = "SELECT p.s AS \"partition\", (SELECT count(*) FROM L WHERE o_orderstatus = p.s) AS row_count_left, (SELECT count(*) FROM R WHERE o_orderstatus = p.s) AS row_count_right FROM (SELECT o_orderstatus AS s FROM L UNION SELECT o_orderstatus FROM R) p"


@query("compare_partitioned", f"WITH {SIDES_SQL} {PART_COUNTS}")
def compare_partitioned(spark, sf):
    found = compare(*pair(spark, sf), keys="o_orderkey", partition=PartitionSpec("o_orderstatus"), spark=spark)
    return spark.createDataFrame([(p["partition"], p["row_count_left"], p["row_count_right"]) for p in found.partitions], "partition string, row_count_left long, row_count_right long")


@query("compare_without_keys", "SELECT 'ERROR' AS status, true AS told FROM (SELECT count(*) FROM orders)")
def compare_without_keys(spark, sf):
    found = compare(*pair(spark, sf), compare_mode="keyed", spark=spark)
    return spark.createDataFrame([(found.status, "keys" in (found.error or ""))], "status string, told boolean")


# ---- sources: a table written in a format and read by its source

NATION_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"


def nation(spark, sf) -> DataFrame:
    return read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))


def loaded(spark, path: str, **settings) -> DataFrame:
    df = source(path, **settings).load(spark)
    return df.select(F.col("id").cast("long").alias("id"), "name", F.col("region").cast("long").alias("region"))


def written(spark, df: DataFrame, extension: str, form: str, **options) -> str:
    path = f"{scratch_path(spark, 'source')}.{extension}"
    df.write.format(form).options(**options).save(path)
    return path


@query("source_csv", NATION_SQL)
def source_csv(spark, sf):
    return loaded(spark, written(spark, nation(spark, sf), "csv", "csv", header=True))


@query("source_tsv", NATION_SQL)
def source_tsv(spark, sf):
    return loaded(spark, written(spark, nation(spark, sf), "tsv", "csv", header=True, sep="\t"))


@query("source_psv", NATION_SQL)
def source_psv(spark, sf):
    return loaded(spark, written(spark, nation(spark, sf), "psv", "csv", header=True, sep="|"))


@query("source_parquet", NATION_SQL)
def source_parquet(spark, sf):
    return loaded(spark, written(spark, nation(spark, sf), "parquet", "parquet"))


@query("source_orc", NATION_SQL)
def source_orc(spark, sf):
    return loaded(spark, written(spark, nation(spark, sf), "orc", "orc"))


@query("source_json_lines", NATION_SQL)
def source_json_lines(spark, sf):
    return loaded(spark, written(spark, nation(spark, sf), "jsonl", "json"))


@query("source_json_array", NATION_SQL)
def source_json_array(spark, sf):
    one = nation(spark, sf).agg(F.to_json(F.collect_list(F.struct("id", "name", "region"))).alias("value"))
    return loaded(spark, written(spark, one.coalesce(1), "json", "text"))


@query("source_xml", NATION_SQL)
def source_xml(spark, sf):
    return loaded(spark, written(spark, nation(spark, sf).coalesce(1), "xml", "xml", rootTag="nations", rowTag="nation"), record_path="nation")


@query("source_fixed_width", NATION_SQL)
def source_fixed_width(spark, sf):
    line = F.concat(F.lpad(F.col("id").cast("string"), 6, " "), F.rpad("name", 30, " "), F.lpad(F.col("region").cast("string"), 4, " "))
    path = written(spark, nation(spark, sf).select(line.alias("value")), "dat", "text")
    return loaded(spark, path, fixed_width=True, columns=[("id", 1, 6), ("name", 7, 30), ("region", 37, 4)], trim_values=True)


@query("source_mainframe_lines", NATION_SQL)
def source_mainframe_lines(spark, sf):
    line = F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.rpad("name", 30, " "), F.lpad(F.col("region").cast("string"), 4, " "))
    path = written(spark, nation(spark, sf).select(line.alias("value")), "dat", "text")
    fields = [{"name": "id", "start": 1, "length": 6, "type": "int"}, {"name": "name", "start": 7, "length": 30}, {"name": "region", "start": 37, "length": 4, "type": "int"}]
    return loaded(spark, path, mainframe=True, fields=fields, encoding="ascii")


@query("source_sqlite", NATION_SQL)
def source_sqlite(spark, sf):
    path = scratch_path(spark, "source").removeprefix("file://") + ".db"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE nation (id INTEGER, name TEXT, region INTEGER)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", map(tuple, nation(spark, sf).collect()))  # 25 rows at any scale
    return SqlTable(f"sqlite:///{path}", "nation", chunk_size=10).load(spark)


@query("source_compare_csv_parquet", result_sql(f"SELECT (SELECT count(*) FROM nation) AS row_count_left, (SELECT count(*) FROM nation) AS row_count_right, {NO_COUNTERS}"))
def source_compare_csv_parquet(spark, sf):
    df = nation(spark, sf)
    sides = [source(written(spark, df, "csv", "csv", header=True)), source(written(spark, df, "parquet", "parquet"))]
    return compare(*sides, keys="id", spark=spark).to_df(spark)


# ---- reports: rendered, parsed back

METRICS_SQL = f"""WITH {SIDES_SQL}, c AS ({counters_sql(['o_orderkey'], ORDERS)}) SELECT metric, n FROM (UNPIVOT c ON COLUMNS(*) INTO NAME metric VALUE n)"""
METRICS = ("row_count_left", "row_count_right", *COUNTERS)


def compared(spark, sf):
    return compare(*pair(spark, sf), keys="o_orderkey", config=ReconConfig(sample_limit=5), spark=spark)


def metrics(spark, found: dict) -> DataFrame:
    return spark.createDataFrame([(m, int(str(found[m]).replace(",", ""))) for m in METRICS], "metric string, n long")


@query("report_json", METRICS_SQL)
def report_json(spark, sf):
    return metrics(spark, json.loads(compared(spark, sf).to_json()))


@query("report_csv_summary", METRICS_SQL)
def report_csv_summary(spark, sf):
    return metrics(spark, dict(csv.reader(io.StringIO(compared(spark, sf).to_csv(layout="summary")))))


@query("report_summary", METRICS_SQL)
def report_summary(spark, sf):
    return metrics(spark, dict(re.findall(r"^(\w+) *: (.*)$", compared(spark, sf).summary(), re.M)))


BUCKETS_SQL = f"""WITH {SIDES_SQL}, b AS (SELECT 'missing_in_right' AS bucket, o_orderkey FROM L WHERE o_orderkey NOT IN (SELECT o_orderkey FROM R)
    UNION ALL SELECT 'missing_in_left', o_orderkey FROM R WHERE o_orderkey NOT IN (SELECT o_orderkey FROM L)
    UNION ALL SELECT 'changed', o_orderkey FROM ({CHANGED_SQL.replace('count(*) AS changed_rows', 'l.o_orderkey')}))
    SELECT bucket, o_orderkey FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY o_orderkey) <= 5"""


@query("report_csv_diff", BUCKETS_SQL)
def report_csv_diff(spark, sf):
    rows = csv.DictReader(io.StringIO(compared(spark, sf).to_csv()))
    return spark.createDataFrame([(r["__bucket"], int(r["o_orderkey"])) for r in rows], "bucket string, o_orderkey long")


@query("report_junit", f"WITH {SIDES_SQL}, c AS ({counters_sql(['o_orderkey'], ORDERS)}) SELECT (row_count_left <> row_count_right OR missing_in_left + missing_in_right + changed_rows + duplicate_keys_left + duplicate_keys_right > 0) AS failed FROM c")
def report_junit(spark, sf):
    root = ET.fromstring(compared(spark, sf).to_junit())
    return spark.createDataFrame([(bool(root.findall(".//failure")),)], "failed boolean")
