"""Named reconciliation queries and the SQL that must give the same rows.

The right side of a pair is its left side, perturbed by rules on the key: rows left out, rows under new
keys, changed values, nulls. The same rules stand in the SQL as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.config import ReconConfig
from evenkeel.functions import logical as lt
from evenkeel.functions.names import named
from evenkeel.functions.values import normalised
from evenkeel.operators import fingerprint, keyed, partition, profile, sampling, schema
from evenkeel.operators.keyed import SLICE, Pair
from evenkeel.plans import scenarios
from evenkeel.plans.compare import align
from evenkeel.sources.files import carve
from evenkeel.types import PartitionSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ORDERS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LEFT_SQL = "L AS (SELECT * FROM orders)"
RIGHT_SQL = """R AS (
    SELECT CASE WHEN o_orderkey % 500 = 2 THEN o_orderkey + 1000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
        CASE WHEN o_orderkey % 700 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 500 <> 1)"""
SIDES_SQL = f"{LEFT_SQL}, {RIGHT_SQL}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def orders_right(left: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return left.where(k % 500 != 1).select(
        F.when(k % 500 == 2, k + 1000000).otherwise(k).alias("o_orderkey"),
        "o_custkey",
        F.when(k % 700 == 3, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 100 == 0, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


def orders(spark: SparkSession, sf: str, values: list[str] | None = None, **settings) -> Pair:
    left = read(spark, sf, "orders")
    return Pair(left, orders_right(left), ["o_orderkey"], ORDERS if values is None else values, ReconConfig(**settings))


def one_count(df: DataFrame, name: str = "changed_rows") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def diff_sql(columns: list[str], l: str = "l", r: str = "r") -> str:
    return " OR ".join(f"{l}.{c} IS DISTINCT FROM {r}.{c}" for c in columns)


CHANGED_SQL = f"SELECT count(*) AS changed_rows FROM L l JOIN R r ON l.o_orderkey = r.o_orderkey WHERE {diff_sql(ORDERS)}"


def counters(pair: Pair) -> DataFrame:
    """All counters of a keyed comparison in one row. Two plans of one row each meet."""
    found = keyed.key_counters(pair).withColumn("one", F.lit(1))
    changed = keyed.changed_rows(pair).agg(F.count("*").alias("changed_rows"), F.lit(1).alias("one"))
    return found.join(changed, "one").drop("one")


def counters_sql(keys: list[str], values: list[str], left: str = "L", right: str = "R") -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(keys)
    gone = lambda x, y: f"(SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {x} a WHERE NOT EXISTS (SELECT 1 FROM {y} b WHERE {on})))"
    dup = lambda x: f"(SELECT count(*) FROM (SELECT {cols} FROM {x} GROUP BY {cols} HAVING count(*) > 1))"
    return f"""SELECT (SELECT count(*) FROM {left}) AS row_count_left, (SELECT count(*) FROM {right}) AS row_count_right,
    {gone(right, left)} AS missing_in_left, {gone(left, right)} AS missing_in_right, {dup(left)} AS duplicate_keys_left, {dup(right)} AS duplicate_keys_right,
    (SELECT count(*) FROM {left} a JOIN {right} b ON {on} WHERE {diff_sql(values, 'a', 'b')}) AS changed_rows"""


# ---- the whole comparison


@query("keyed_summary", f"WITH {SIDES_SQL} {counters_sql(['o_orderkey'], ORDERS)}")
def keyed_summary(spark, sf):
    return counters(orders(spark, sf))


@query("keyed_full_outer", f"""WITH {SIDES_SQL} SELECT bucket, count(*) AS n FROM (
    SELECT CASE WHEN l.o_orderkey IS NULL THEN 'missing_in_left' WHEN r.o_orderkey IS NULL THEN 'missing_in_right'
        WHEN {diff_sql(ORDERS)} THEN 'changed' ELSE 'equal' END AS bucket
    FROM L l FULL OUTER JOIN R r ON l.o_orderkey = r.o_orderkey) GROUP BY bucket""")
def keyed_full_outer(spark, sf):
    pair = orders(spark, sf)
    groups = keyed.key_groups(pair)
    side = F.when(F.col("l_n").isNull(), "missing_in_left").when(F.col("r_n").isNull(), "missing_in_right").otherwise("met")
    changed = keyed.changed_rows(pair).select("o_orderkey", F.lit("changed").alias("changed"))
    bucket = F.coalesce("changed", F.when(F.col("side") == "met", "equal").otherwise(F.col("side"))).alias("bucket")
    return groups.select("o_orderkey", side.alias("side")).join(changed, "o_orderkey", "left").groupBy(bucket).agg(F.count("*").alias("n"))


CONVERSATIONS_SQL = "L AS (SELECT * FROM conversations), R AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN upper(text) ELSE text END AS text FROM conversations WHERE NOT (conv_id % 25 = 4 AND turn = 0))"


@query("composite_key", f"WITH {CONVERSATIONS_SQL} {counters_sql(['conv_id', 'turn'], ['role', 'text'])}")
def composite_key(spark, sf):
    left = read(spark, sf, "conversations")
    right = left.where(~((F.col("conv_id") % 25 == 4) & (F.col("turn") == 0))).withColumn("text", F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 1), F.upper("text")).otherwise(F.col("text")))
    return counters(Pair(left, right, ["conv_id", "turn"], ["role", "text"], ReconConfig()))


# ---- counts and names


@query("rowcount_pair", f"WITH {SIDES_SQL} SELECT (SELECT count(*) FROM L) AS row_count_left, (SELECT count(*) FROM R) AS row_count_right, (SELECT count(*) FROM L) = (SELECT count(*) FROM R) AS counts_match")
def rowcount_pair(spark, sf):
    pair = orders(spark, sf)
    tagged = pair.left.select(F.lit(True).alias("is_left")).unionAll(pair.right.select(F.lit(False)))
    sums = tagged.agg(F.count_if("is_left").alias("row_count_left"), F.count_if(~F.col("is_left")).alias("row_count_right"))
    return sums.withColumn("counts_match", F.col("row_count_left") == F.col("row_count_right"))


def drifted(spark, sf):
    left = read(spark, sf, "customer")
    right = left.withColumnRenamed("c_acctbal", "c_balance").withColumn("c_nationkey", F.col("c_nationkey").cast("string")).withColumn("c_custkey", F.col("c_custkey").cast("int"))
    return left, right, schema.compare_schemas(left.schema, right.schema, ReconConfig(infer_logical_types=False))


@query("schema_diff_names", "SELECT * FROM (VALUES ('c_acctbal', 'missing_in_right'), ('c_balance', 'missing_in_left'), ('c_custkey', 'common'), ('c_mktsegment', 'common'), ('c_name', 'common'), ('c_nationkey', 'common'), ('c_nationkey', 'type_mismatch')) t(column_name, side)")
def schema_diff_names(spark, sf):
    _, _, d = drifted(spark, sf)
    rows = [(c, side) for side, cs in (("missing_in_right", d.missing_in_right), ("missing_in_left", d.missing_in_left), ("common", d.common_columns), ("type_mismatch", d.type_mismatches)) for c in cs]
    return spark.createDataFrame(rows, "column_name string, side string")


@query("names_only", "SELECT count(*) AS row_count_left, count(*) AS row_count_right, false AS names_match, true AS counts_match FROM customer")
def names_only(spark, sf):
    left, right, d = drifted(spark, sf)
    both = left.select(F.lit(1).alias("l")).unionAll(right.select(F.lit(0))).agg(F.sum("l").alias("row_count_left"), F.sum(1 - F.col("l")).alias("row_count_right"))
    return both.select(F.col("row_count_left").cast("bigint"), F.col("row_count_right").cast("bigint"), F.lit(not (d.missing_in_left or d.missing_in_right)).alias("names_match"), (F.col("row_count_left") == F.col("row_count_right")).alias("counts_match"))


# ---- duplicates and missing keys


def lineitem(spark, sf) -> Pair:
    left = read(spark, sf, "lineitem")
    right = left.where("l_orderkey % 400 <> 7").withColumn("l_quantity", F.when(F.col("l_orderkey") % 200 == 5, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return Pair(left, right, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"], ReconConfig())


LINEITEM_SQL = "L AS (SELECT * FROM lineitem), R AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 200 = 5 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 400 <> 7)"


@query("dup_keys_left", "SELECT count(*) AS duplicate_keys FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def dup_keys_left(spark, sf):
    return one_count(dup_keys_groups(spark, sf), "duplicate_keys")


@query("dup_keys_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys_groups(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("missing_in_right", f"WITH {SIDES_SQL} SELECT DISTINCT o_orderkey FROM L WHERE o_orderkey NOT IN (SELECT o_orderkey FROM R)")
def missing_in_right(spark, sf):
    return keyed.missing_keys(orders(spark, sf), "right")


@query("missing_in_left", f"WITH {SIDES_SQL} SELECT DISTINCT o_orderkey FROM R WHERE o_orderkey NOT IN (SELECT o_orderkey FROM L)")
def missing_in_left(spark, sf):
    return keyed.missing_keys(orders(spark, sf), "left")


NULL_SQL = "L AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS event_id, event_type, value FROM events), R AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id END AS event_id, event_type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events)"


def events_with_nulls(spark, sf) -> Pair:
    base = read(spark, sf, "events")
    null_if = lambda n, c: F.when(F.col("event_id") % n != 0, F.col(c)).alias(c)
    return Pair(base.select(null_if(7, "event_id"), "event_type", "value"), base.select(null_if(11, "event_id"), "event_type", null_if(13, "value")), ["event_id"], ["event_type", "value"], ReconConfig())


@query("missing_null_keys", f"WITH {NULL_SQL} {counters_sql(['event_id'], ['event_type', 'value'])}")
def missing_null_keys(spark, sf):
    return counters(events_with_nulls(spark, sf))


# ---- changed rows


@query("changed_rows", f"WITH {SIDES_SQL} {CHANGED_SQL}")
def changed_rows(spark, sf):
    return one_count(keyed.changed_rows(orders(spark, sf)))


@query("changed_rows_sample", f"WITH {SIDES_SQL} SELECT l.o_orderkey, l.o_custkey AS o_custkey__left, r.o_custkey AS o_custkey__right, l.o_orderstatus AS o_orderstatus__left, r.o_orderstatus AS o_orderstatus__right FROM L l JOIN R r ON l.o_orderkey = r.o_orderkey WHERE {diff_sql(['o_custkey', 'o_orderstatus'])} ORDER BY 1 LIMIT 20")
def changed_rows_sample(spark, sf):
    return keyed.changed_rows(orders(spark, sf, ["o_custkey", "o_orderstatus"])).orderBy("o_orderkey").limit(20)


@query("changed_fanout", f"WITH {LINEITEM_SQL} SELECT count(*) AS changed_rows FROM L l JOIN R r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber WHERE {diff_sql(['l_partkey', 'l_suppkey', 'l_quantity'])}")
def changed_fanout(spark, sf):
    return one_count(keyed.changed_rows(lineitem(spark, sf)))


@query("lineitem_summary", f"WITH {LINEITEM_SQL} {counters_sql(['l_orderkey', 'l_linenumber'], ['l_partkey', 'l_suppkey', 'l_quantity'])}")
def lineitem_summary(spark, sf):
    return counters(lineitem(spark, sf))


@query("changed_row_hash", f"WITH {SIDES_SQL} {CHANGED_SQL}")
def changed_row_hash(spark, sf):
    return one_count(keyed.changed_rows(orders(spark, sf, row_hash=True)))


@query("changed_with_tolerance", f"""WITH {SIDES_SQL}, j AS (SELECT l.o_totalprice AS a, r.o_totalprice AS b FROM L l JOIN R r ON l.o_orderkey = r.o_orderkey)
SELECT 0.6::DOUBLE AS tolerance, count(*) AS changed_rows FROM j WHERE abs(a - b) > 0.6 UNION ALL SELECT 0.4, count(*) FROM j WHERE abs(a - b) > 0.4""")
def changed_with_tolerance(spark, sf):
    parts = [one_count(keyed.changed_rows(orders(spark, sf, ["o_totalprice"], tolerances={"o_totalprice": t}))).select(F.lit(t).alias("tolerance"), "changed_rows") for t in (0.6, 0.4)]
    return parts[0].unionAll(parts[1])


@query("changed_nullsafe", f"WITH {NULL_SQL} SELECT count(*) AS changed_rows FROM L l JOIN R r ON l.event_id = r.event_id WHERE {diff_sql(['event_type', 'value'])}")
def changed_nullsafe(spark, sf):
    return one_count(keyed.changed_rows(events_with_nulls(spark, sf)))


@query("changed_mixed_dtype_logical", """WITH L AS (SELECT p_partkey, p_size FROM part), R AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN '  ' || p_size ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part)
SELECT count(*) AS changed_rows FROM L l JOIN R r ON l.p_partkey = r.p_partkey WHERE l.p_size IS DISTINCT FROM TRY_CAST(nullif(trim(r.p_size), '') AS BIGINT)""")
def changed_mixed_dtype_logical(spark, sf):
    left = read(spark, sf, "part").select("p_partkey", "p_size")
    text = F.when(F.col("p_partkey") % 9 == 0, " ").when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("  "), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    right = left.select("p_partkey", text.alias("p_size"))
    agreed = lt.agreed(lt.infer(left), lt.infer(right), ["p_size"])
    return one_count(keyed.changed_rows(Pair(left, right, ["p_partkey"], ["p_size"], ReconConfig(), agreed)))


@query("changed_mixed_dtype_text", """WITH L AS (SELECT p_partkey, p_size FROM part), R AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'Size ' || p_size WHEN p_partkey % 4 = 0 THEN ' ' || p_size || ' ' WHEN p_partkey % 10 = 1 THEN '' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part)
SELECT count(*) AS changed_rows FROM L l JOIN R r ON l.p_partkey = r.p_partkey WHERE lower(trim(nullif(CAST(l.p_size AS VARCHAR), ''))) IS DISTINCT FROM lower(trim(nullif(r.p_size, '')))""")
def changed_mixed_dtype_text(spark, sf):
    left, k, size = read(spark, sf, "part").select("p_partkey", "p_size"), F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 6 == 0, F.concat(F.lit("Size "), size)).when(k % 4 == 0, F.concat(F.lit(" "), size, F.lit(" "))).when(k % 10 == 1, "").otherwise(size)
    return one_count(keyed.changed_rows(Pair(left, left.select("p_partkey", text.alias("p_size")), ["p_partkey"], ["p_size"], ReconConfig(trim_strings=True, case_sensitive=False))))


# ---- normalisation

STRINGS_SQL = "R AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' || upper(c_mktsegment) || ' ' WHEN c_custkey % 17 = 1 THEN '   ' ELSE c_mktsegment END AS s FROM customer)"


@query("norm_trim_lower_nullempty", f"WITH {STRINGS_SQL} SELECT nullif(lower(trim(s)), '') AS value, count(*) AS n FROM R GROUP BY 1")
def norm_trim_lower_nullempty(spark, sf):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    df = read(spark, sf, "customer").select(F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper(seg), F.lit(" "))).when(k % 17 == 1, "   ").otherwise(seg).alias("s"))
    cfg = ReconConfig(trim_strings=True, case_sensitive=False, null_equals_empty=True)
    return df.groupBy(normalised(F.col("s"), df.schema["s"].dataType, cfg).alias("value")).agg(F.count("*").alias("n"))


@query("norm_decimal_scale", "SELECT count(*) AS changed_rows FROM (SELECT o_totalprice AS a, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 0.25 ELSE 0.00001 END AS b FROM orders) WHERE round(a, 1) IS DISTINCT FROM round(b, 1)")
def norm_decimal_scale(spark, sf):
    left = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    right = left.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 10 == 0, 0.25).otherwise(0.00001))
    return one_count(keyed.changed_rows(Pair(left, right, ["o_orderkey"], ["o_totalprice"], ReconConfig(decimal_scale=1))))


@query("norm_timestamp_tz", "SELECT CAST(o_orderdate - INTERVAL 5 HOUR - INTERVAL 30 MINUTE AS VARCHAR) AS at, count(*) AS n FROM orders GROUP BY 1")
def norm_timestamp_tz(spark, sf):
    df = read(spark, sf, "orders")
    at = normalised(F.col("o_orderdate"), df.schema["o_orderdate"].dataType, ReconConfig(timestamp_tz="Asia/Kolkata"))
    return df.groupBy(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at")).agg(F.count("*").alias("n"))


# ---- columns


@query("exclude_columns", f"WITH {SIDES_SQL} SELECT count(*) AS changed_rows FROM L l JOIN R r ON l.o_orderkey = r.o_orderkey WHERE {diff_sql([c for c in ORDERS if c != 'o_totalprice'])}")
def exclude_columns(spark, sf):
    cfg = ReconConfig(exclude_columns=["o_totalprice"])
    pair = orders(spark, sf)
    return one_count(keyed.changed_rows(Pair(pair.left, pair.right, pair.keys, keyed.value_columns(["o_orderkey", *ORDERS], pair.keys, cfg), cfg)))


@query("columns_allowlist", f"WITH {SIDES_SQL} SELECT count(*) AS changed_rows FROM L l JOIN R r ON l.o_orderkey = r.o_orderkey WHERE {diff_sql(['o_orderstatus'])}")
def columns_allowlist(spark, sf):
    cfg = ReconConfig(columns=["o_orderstatus"])
    pair = orders(spark, sf)
    return one_count(keyed.changed_rows(Pair(pair.left, pair.right, pair.keys, keyed.value_columns(["o_orderkey", *ORDERS], pair.keys, cfg), cfg)))


@query("column_mapping", f"WITH {SIDES_SQL} SELECT count(*) AS changed_rows FROM L l JOIN R r ON l.o_orderkey = r.o_orderkey WHERE {diff_sql(['o_totalprice'])}")
def column_mapping(spark, sf):
    pair = orders(spark, sf)
    right = align(pair.left, pair.right.withColumnsRenamed({"o_orderkey": "id", "o_totalprice": "total"}), {"o_orderkey": "id", "o_totalprice": "total"})
    return one_count(keyed.changed_rows(Pair(pair.left, right, pair.keys, ["o_totalprice"], ReconConfig())))


# ---- fingerprints


def flags(left: DataFrame, right: DataFrame, columns: list[str], total: bool = True) -> DataFrame:
    both = fingerprint.fingerprints(left, right, columns, ReconConfig())
    seen = F.struct("n", "xor", "total") if total else F.struct("xor")
    return both.agg((F.count_distinct(seen) == 1).alias("matched"))


def same_rows_sql(left: str, right: str, cols: str) -> str:
    return f"SELECT NOT EXISTS (SELECT {cols} FROM {left} EXCEPT ALL SELECT {cols} FROM {right}) AND NOT EXISTS (SELECT {cols} FROM {right} EXCEPT ALL SELECT {cols} FROM {left}) AS matched"


EVENT = ["event_id", "user_id", "event_type", "value"]
EVENT_SQL = ", ".join(EVENT)


@query("fast_path_equal", f"WITH R AS (SELECT * FROM events ORDER BY value) {same_rows_sql('events', 'R', EVENT_SQL)}")
def fast_path_equal(spark, sf):
    left = read(spark, sf, "events")
    return flags(left, left.repartition(7, "user_id"), EVENT)


@query("fast_path_row_count_diff", f"WITH R AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id = 5) {same_rows_sql('events', 'R', EVENT_SQL)}")
def fast_path_row_count_diff(spark, sf):
    left = read(spark, sf, "events")
    return flags(left, left.unionAll(left.where("event_id = 5")), EVENT)


SWAP_SQL = "R AS (SELECT CASE event_id WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE event_id END AS event_id, user_id, event_type, value FROM events)"


@query("fast_path_swapped_keys", f"WITH {SWAP_SQL} {same_rows_sql('events', 'R', EVENT_SQL)}")
def fast_path_swapped_keys(spark, sf):
    left = read(spark, sf, "events")
    right = left.withColumn("event_id", F.when(F.col("event_id") == 1, 2).when(F.col("event_id") == 2, 1).otherwise(F.col("event_id")).cast("bigint"))
    return flags(left, right, EVENT)


@query("hash_mode_match", "SELECT true AS matched")
def hash_mode_match(spark, sf):
    left = read(spark, sf, "events")
    return flags(left, left.orderBy("value"), EVENT[1:], total=False)


@query("hash_mode_mismatch", "SELECT false AS matched")
def hash_mode_mismatch(spark, sf):
    left = read(spark, sf, "events")
    return flags(left, left.withColumn("value", F.when(F.col("event_id") == 3, -1.0).otherwise(F.col("value"))), EVENT[1:], total=False)


@query("hash_mode_xor_cancels", "SELECT true AS matched")
def hash_mode_xor_cancels(spark, sf):
    left = read(spark, sf, "events")
    extra = left.where("event_id = 5")
    return flags(left, left.unionAll(extra).unionAll(extra), EVENT[1:], total=False)


# ---- profiles and types


def profile_sql(table: str, columns: list[str], side: str | None = None) -> str:
    tail = f", '{side}' AS side" if side else ""
    one = "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\", min(CAST({c} AS VARCHAR)) AS min, max(CAST({c} AS VARCHAR)) AS max" + tail + f" FROM {table}"
    return " UNION ALL ".join(one.format(c=c) for c in columns)


@query("profile_orders", profile_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))
def profile_orders(spark, sf):
    return profile.profile(read(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("profile_events", profile_sql("events", ["event_id", "user_id", "event_type", "props"]))
def profile_events(spark, sf):
    return profile.profile(read(spark, sf, "events"), ["event_id", "user_id", "event_type", "props"])


PROFILE_COLUMNS = ["o_orderkey", "o_orderstatus", "o_custkey"]


@query("profile_pair", f"WITH {SIDES_SQL} {profile_sql('L', PROFILE_COLUMNS, 'left')} UNION ALL {profile_sql('R', PROFILE_COLUMNS, 'right')}")
def profile_pair(spark, sf):
    pair = orders(spark, sf)
    return profile.profile_pair(pair.left, pair.right, PROFILE_COLUMNS)


def as_texts(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    blank = F.when(F.col("event_id") % 8 == 0, " ")
    return e.select(
        F.col("event_id").cast("string").alias("t_integer"),
        blank.otherwise(F.col("value").cast("decimal(18,4)").cast("string")).alias("t_decimal"),
        F.date_format("ts", "yyyy-MM-dd").alias("t_date"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t_timestamp"),
        F.when(F.col("event_id") % 2 == 0, "yes").otherwise("No").alias("t_bool"),
        "event_type",
        F.lit(None).cast("string").alias("t_null"),
        "ts",
        "value",
    )


@query("infer_logical_types", "SELECT * FROM (VALUES ('t_integer', 'integer'), ('t_decimal', 'decimal'), ('t_date', 'date'), ('t_timestamp', 'timestamp'), ('t_bool', 'bool'), ('event_type', 'text'), ('t_null', 'null'), ('ts', 'timestamp'), ('value', 'decimal')) t(column_name, logical_type)")
def infer_logical_types(spark, sf):
    return spark.createDataFrame(list(lt.infer(as_texts(spark, sf)).items()), "column_name string, logical_type string")


@query("common_logical_types", "SELECT * FROM (VALUES ('event_id', 'integer'), ('ts', 'timestamp'), ('user_id', 'integer'), ('value', 'decimal')) t(column_name, logical_type)")
def common_logical_types(spark, sf):
    left = read(spark, sf, "events")
    right = left.select(*(named(c).cast("string").alias(c) if c != "value" else F.col("value").cast("decimal(18,4)").cast("string").alias(c) for c in left.columns))
    return spark.createDataFrame(list(lt.agreed(lt.infer(left), lt.infer(right), left.columns).items()), "column_name string, logical_type string")


# ---- samples


@query("sampled_full", f"WITH {LEFT_SQL}, R0 AS (SELECT * FROM orders), {RIGHT_SQL.replace('R AS', 'R1 AS')}, R AS (SELECT * FROM R1 WHERE o_orderkey IN (SELECT o_orderkey FROM L)) {counters_sql(['o_orderkey'], ORDERS)}")
def sampled_full(spark, sf):
    pair = orders(spark, sf)
    sample = sampling.sample_keys(pair.left, pair.keys, pair.left.select(*pair.keys).distinct().count())
    return counters(Pair(pair.left.join(sample, pair.keys, "left_semi"), pair.right.join(sample, pair.keys, "left_semi"), pair.keys, pair.values, pair.cfg))


@query("sampled_semi_join", f"WITH {SIDES_SQL} SELECT count(*) AS n FROM R WHERE o_orderkey IN (SELECT o_orderkey FROM L WHERE o_orderkey % 50 = 0)")
def sampled_semi_join(spark, sf):
    pair = orders(spark, sf)
    chosen = pair.left.where("o_orderkey % 50 = 0")
    sample = sampling.sample_keys(chosen, pair.keys, chosen.select(*pair.keys).distinct().count())
    return one_count(pair.right.join(sample, pair.keys, "left_semi"), "n")


# ---- partitions


def slice_sql(part: str, values: list[str], extra: str = "") -> str:
    """Counters for each slice p of L and R, which part lists."""
    same = "l.p IS NOT DISTINCT FROM r.p AND l.o_orderkey = r.o_orderkey"
    n = lambda f: f"coalesce((SELECT count(*) FROM {f}), 0)"
    return f"""SELECT p.label AS "partition", {n('L l WHERE l.p IS NOT DISTINCT FROM p.p')} AS row_count_left, {n('R r WHERE r.p IS NOT DISTINCT FROM p.p')} AS row_count_right,
    {n(f'R r WHERE r.p IS NOT DISTINCT FROM p.p AND NOT EXISTS (SELECT 1 FROM L l WHERE {same})')} AS missing_in_left,
    {n(f'L l WHERE l.p IS NOT DISTINCT FROM p.p AND NOT EXISTS (SELECT 1 FROM R r WHERE {same})')} AS missing_in_right,
    coalesce(c.n, 0) AS changed_rows FROM ({part}) p LEFT JOIN (SELECT l.p, count(*) AS n FROM L l JOIN R r ON {same} WHERE {diff_sql(values)} GROUP BY 1) c ON c.p IS NOT DISTINCT FROM p.p"""


def slice_rows(pair: Pair, spec: PartitionSpec) -> DataFrame:
    """The slices' counters as a DataFrame, under their labels, those without rows too."""
    spark = pair.left.sparkSession
    found = partition.slice_counters(partition.sliced(pair, spec)).drop("duplicate_keys_left", "duplicate_keys_right")
    if spec.strategy == "value":
        return found.withColumn("partition", F.col(SLICE).cast("string")).drop(SLICE)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(partition.slice_values(pair, spec))], f"{SLICE} int, partition string")
    out = labels.join(found, SLICE, "left").drop(SLICE)
    return out.select("partition", *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "partition"))


def with_p(sql: str, p: str) -> str:
    return sql.replace("L AS (SELECT * FROM orders)", f"L AS (SELECT *, {p} AS p FROM orders)").replace("R AS (", "R AS (SELECT *, " + p + " AS p FROM (").rstrip() + ")"


@query("partition_value", f"WITH {with_p(SIDES_SQL, 'o_orderstatus')} {slice_sql('SELECT DISTINCT p AS label, p FROM (SELECT p FROM L UNION SELECT p FROM R)', ORDERS)}")
def partition_value(spark, sf):
    return slice_rows(orders(spark, sf), PartitionSpec("o_orderstatus"))


NULL_PART = "nullif(o_orderpriority, '5-LOW')"


@query("partition_value_null", f"WITH {with_p(SIDES_SQL, NULL_PART)} {slice_sql('SELECT DISTINCT p AS label, p FROM (SELECT p FROM L UNION SELECT p FROM R)', ORDERS)}")
def partition_value_null(spark, sf):
    pair = orders(spark, sf)
    add = lambda df: df.withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return slice_rows(Pair(add(pair.left), add(pair.right), pair.keys, pair.values, pair.cfg), PartitionSpec("p"))


RANGES = [(0, 3000), (5000, 9000), (9000, 9001), (20_000_000, 30_000_000)]
RANGE_SQL = "CASE " + " ".join(f"WHEN o_orderkey >= {a} AND o_orderkey < {b} THEN {i}" for i, (a, b) in enumerate(RANGES)) + " END"
RANGE_LABELS = "SELECT label, p FROM (VALUES " + ", ".join(f"('[{a}, {b})', {i})" for i, (a, b) in enumerate(RANGES)) + ") v(label, p)"


@query("partition_range", f"WITH {with_p(SIDES_SQL, RANGE_SQL)} {slice_sql(RANGE_LABELS, ORDERS)}")
def partition_range(spark, sf):
    return slice_rows(orders(spark, sf), PartitionSpec("o_orderkey", "range", boundaries=RANGES))


#: Half-open ranges over the dates of all orders, with a gap of a month, and one without rows.
DATES = [("1900-01-01", "1997-01-01"), ("1997-01-01", "1999-06-01"), ("1999-07-01", "2100-01-01"), ("2100-01-01", "2200-01-01")]
DATE_SQL = "CASE " + " ".join(f"WHEN o_orderdate >= TIMESTAMP '{a}' AND o_orderdate < TIMESTAMP '{b}' THEN {i}" for i, (a, b) in enumerate(DATES)) + " END"
DATE_LABELS = "SELECT label, p FROM (VALUES " + ", ".join(f"('[{a}, {b})', {i})" for i, (a, b) in enumerate(DATES)) + ") v(label, p)"


@query("partition_range_dates", f"WITH {with_p(SIDES_SQL, DATE_SQL)} {slice_sql(DATE_LABELS, ORDERS)}")
def partition_range_dates(spark, sf):
    return slice_rows(orders(spark, sf), PartitionSpec("o_orderdate", "range", boundaries=DATES))


@query("partition_hash_totals", f"WITH {SIDES_SQL}, t AS ({counters_sql(['o_orderkey'], ORDERS)}) SELECT row_count_left, row_count_right, missing_in_left, missing_in_right, changed_rows, 8::BIGINT AS partitions FROM t")
def partition_hash_totals(spark, sf):
    rows = slice_rows(orders(spark, sf), PartitionSpec("o_orderkey", "hash", buckets=8))
    return rows.agg(*(F.sum(c).cast("bigint").alias(c) for c in rows.columns if c != "partition"), F.count("*").alias("partitions"))


MOVED_SQL = "L AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderstatus AS p FROM orders), R AS (SELECT *, o_orderstatus AS p FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 90 = 4 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders))"


@query("partition_moved_rows", f"WITH {MOVED_SQL} {slice_sql('SELECT DISTINCT p AS label, p FROM (SELECT p FROM L UNION SELECT p FROM R)', ['o_orderstatus', 'o_totalprice'])}")
def partition_moved_rows(spark, sf):
    left = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    right = left.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 90 == 4, "F").otherwise(F.col("o_orderstatus")))
    return slice_rows(Pair(left, right, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], ReconConfig()), PartitionSpec("o_orderstatus"))


@query("partition_union_values", f"WITH {SIDES_SQL} SELECT o_orderstatus AS value FROM L UNION SELECT o_orderstatus FROM R")
def partition_union_values(spark, sf):
    pair = orders(spark, sf)
    return partition.union_values(pair.left, pair.right, PartitionSpec("o_orderstatus"))


# ---- sources and nested values


@query("fixed_width_carve", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS id, trim(substring(rpad(n_name, 12, ' '), 1, 12)) AS name, substring(rpad(n_name, 12, ' '), 1, 3) AS short FROM nation")
def fixed_width_carve(spark, sf):
    line = F.concat(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.rpad("n_name", 12, " "))
    rows = read(spark, sf, "nation").select(line.alias("value"))
    return rows.select(carve(F.col("value"), 1, 4).alias("id"), carve(F.col("value"), 5, 12, True).alias("name"), carve(F.col("value"), 5, 3).alias("short"))


@query("json_props_compare", "WITH R AS (SELECT event_id, CASE WHEN event_id % 40 = 1 THEN '{\"other\":1}' ELSE props END AS props FROM events) SELECT count(*) AS changed_rows FROM events l JOIN R r ON l.event_id = r.event_id WHERE l.props IS DISTINCT FROM r.props")
def json_props_compare(spark, sf):
    left = read(spark, sf, "events").select("event_id", "props")
    right = left.withColumn("props", F.when(F.col("event_id") % 40 == 1, '{"other":1}').otherwise(F.col("props")))
    as_map = lambda df: df.select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    return one_count(keyed.changed_rows(Pair(as_map(left), as_map(right), ["event_id"], ["props"], ReconConfig(row_hash=True))))


@query("nested_array_compare", "WITH R AS (SELECT vec_id, CASE WHEN vec_id % 30 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings) SELECT count(*) AS changed_rows FROM embeddings l JOIN R r ON l.vec_id = r.vec_id WHERE l.embedding IS DISTINCT FROM r.embedding")
def nested_array_compare(spark, sf):
    left = read(spark, sf, "embeddings").select("vec_id", "embedding")
    right = left.withColumn("embedding", F.when(F.col("vec_id") % 30 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    return one_count(keyed.changed_rows(Pair(left, right, ["vec_id"], ["embedding"], ReconConfig())))


# ---- generated scenarios, by their arithmetic

BENCH_ROWS = 20_000


def bench_counts(spark: SparkSession, scenario: str) -> DataFrame:
    left, right = scenarios.pair(spark, scenario, BENCH_ROWS)
    return counters(Pair(left, right, ["id"], scenarios.VALUES, ReconConfig())).select("missing_in_left", "missing_in_right", "changed_rows")


_ids = f"(SELECT count(*) FROM range({BENCH_ROWS}) t(i) WHERE "


@query("bench_all_match", "SELECT 0::BIGINT AS missing_in_left, 0::BIGINT AS missing_in_right, 0::BIGINT AS changed_rows")
def bench_all_match(spark, sf):
    return bench_counts(spark, "all_match")


@query("bench_small_mismatch", f"SELECT {_ids} i % 5000 = 2) AS missing_in_left, {_ids} i % 5000 = 1) AS missing_in_right, {_ids} i % 1000 = 0) AS changed_rows")
def bench_small_mismatch(spark, sf):
    return bench_counts(spark, "small_mismatch")


@query("bench_large_mismatch", f"SELECT 0::BIGINT AS missing_in_left, 0::BIGINT AS missing_in_right, {_ids} i % 20 = 0) AS changed_rows")
def bench_large_mismatch(spark, sf):
    return bench_counts(spark, "large_mismatch")


@query("bench_precision_diff", f"SELECT 0::BIGINT AS missing_in_left, 0::BIGINT AS missing_in_right, {BENCH_ROWS}::BIGINT AS changed_rows")
def bench_precision_diff(spark, sf):
    return bench_counts(spark, "precision_diff")


@query("report_csv_diff_rows", f"""WITH {SIDES_SQL} SELECT 'missing_in_right' AS bucket, o_orderkey FROM L WHERE o_orderkey NOT IN (SELECT o_orderkey FROM R)
UNION ALL SELECT 'missing_in_left', o_orderkey FROM R WHERE o_orderkey NOT IN (SELECT o_orderkey FROM L)
UNION ALL SELECT 'changed', l.o_orderkey FROM L l JOIN R r ON l.o_orderkey = r.o_orderkey WHERE {diff_sql(ORDERS)}""")
def report_csv_diff_rows(spark, sf):
    pair = orders(spark, sf)
    parts = [("missing_in_right", keyed.missing_keys(pair, "right")), ("missing_in_left", keyed.missing_keys(pair, "left")), ("changed", keyed.changed_rows(pair))]
    tagged = [df.select(F.lit(bucket).alias("bucket"), "o_orderkey") for bucket, df in parts]
    return tagged[0].unionAll(tagged[1]).unionAll(tagged[2])
