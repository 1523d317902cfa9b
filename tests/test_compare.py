"""End-to-end comparisons of small pairs with results worked out by hand."""

import duckdb
import pytest

from evenkeel import CompareError, ConfigError, DataFrameSource, PartitionSpec, ReconConfig, Source, compare, hash_compare
from evenkeel.functions import logical as lt
from evenkeel.operators.schema import compare_schemas
from evenkeel.plans import catalogue, scenarios

PEOPLE = "id int, name string, amount double"


def pair(spark, left, right, schema, right_schema=None):
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, right_schema or schema)


def test_equal(spark):
    rows = [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)]
    r = compare(*pair(spark, rows, rows, PEOPLE), keys=["id"])
    assert (r.status, r.row_count_left, r.row_count_right, r.exit_code) == ("MATCH", 3, 3, 0)
    assert r.column_stats["fast_path"]["matched"] and r.column_stats["fast_path"]["row_count"] == 3


def test_all_counters(spark):
    left = [(1, "a", 10.0), (2, "b", 20.0), (3, "c", 30.0), (4, "d", 40.0)]
    right = [(1, "a", 10.0), (2, "b", 25.0), (4, "d", 40.0), (5, "e", 50.0), (5, "e", 50.0)]
    for settings in ({}, {"fast_path": False}):
        r = compare(*pair(spark, left, right, PEOPLE), keys="id", config=ReconConfig(**settings))
        assert (r.status, r.changed_rows, r.missing_in_left, r.missing_in_right, r.duplicate_keys_left, r.duplicate_keys_right) == ("MISMATCH", 1, 1, 1, 0, 1)
        assert r.sample_mismatches == {"missing_in_left": [{"id": 5}], "missing_in_right": [{"id": 3}], "changed": [{"id": 2, "name__left": "b", "name__right": "b", "amount__left": 20.0, "amount__right": 25.0}]}
    assert r.exit_code == 1


def test_tolerance_is_absolute_and_inclusive(spark):
    left, right = pair(spark, [(1, 10.0), (2, 20.0), (3, None)], [(1, 10.5), (2, 20.0), (3, None)], "id int, amount double")
    assert compare(left, right, keys="id", tolerances={"amount": 0.5}).status == "MATCH"
    assert compare(left, right, keys="id", tolerances={"amount": 0.4}).changed_rows == 1


def test_normalisation(spark):
    left, right = pair(spark, [(1, "Alice"), (2, "bob "), (3, "")], [(1, "alice"), (2, "BOB"), (3, None)], "id int, name string")
    assert compare(left, right, keys="id").changed_rows == 3
    cfg = ReconConfig(trim_strings=True, case_sensitive=False, null_equals_empty=True)
    assert compare(left, right, keys="id", config=cfg).status == "MATCH"
    assert compare(left, right, keys="id", config=ReconConfig(trim_strings=True, case_sensitive=False, null_equals_empty=True, fast_path=False)).status == "MATCH"
    close = pair(spark, [(1, 1.234)], [(1, 1.2341)], "id int, x double")
    assert compare(*close, keys="id", config=ReconConfig(decimal_scale=3)).status == "MATCH"


def test_mixed_types(spark):
    left, right = pair(spark, [(1, 10), (2, 20), (3, 30)], [(1, "10"), (2, ""), (3, "30")], "id int, amount int", "id int, amount string")
    r = compare(left, right, keys="id")
    assert (r.status, r.changed_rows) == ("MISMATCH", 1)
    left, right = pair(spark, [("1", "100"), ("2", " 100 "), ("3", "")], [(1, 100), (2, 100), (3, None)], "id string, amount string", "id bigint, amount bigint")
    r = compare(left, right, keys="id")
    assert r.status == "MATCH", r.summary()
    left, right = pair(spark, [(1, 10.0), (2, 5.0)], [(1, "10.001"), (2, "")], "id int, amount double", "id int, amount string")
    assert compare(left, right, keys="id", tolerances={"amount": 0.01}).changed_rows == 1
    left, right = pair(spark, [(1, "abc")], [(1, 5)], "id int, name string", "id int, name bigint")
    r = compare(left, right, keys="id", compare_mode="schema")
    assert not r.schema_match and r.schema_diff.logical_type_mismatches == {"name": {"left": "text", "right": "integer"}}


def test_swapped_values_are_changes(spark):
    r = compare(*pair(spark, [(1, "a"), (2, "b")], [(1, "b"), (2, "a")], "id int, v string"), keys="id")
    assert r.changed_rows == 2 and not r.column_stats["fast_path"]["matched"]


def test_null_keys(spark):
    left, right = pair(spark, [(None, 1), (None, 2), (1, 1)], [(None, 1), (1, 1)], "id int, v int")
    r = compare(left, right, keys="id")
    assert (r.missing_in_left, r.missing_in_right, r.duplicate_keys_left, r.changed_rows) == (1, 1, 1, 0)


def test_fast_path_ignores_duplicates_that_agree(spark):
    rows = [(1, 1), (1, 1), (None, 2)]
    assert compare(*pair(spark, rows, rows, "id int, v int"), keys="id").status == "MATCH"
    assert compare(*pair(spark, rows, rows, "id int, v int"), keys="id", config=ReconConfig(fast_path=False)).status == "MISMATCH"


def test_hashes_tell_where_nulls_are(spark):
    left, right = pair(spark, [(1, None, "a")], [(1, "a", None)], "id int, x string, y string")
    assert compare(left, right, keys="id").changed_rows == 1
    assert compare(left, right, keys="id", config=ReconConfig(row_hash=True)).changed_rows == 1
    assert not hash_compare(left, right).match


def test_row_hash_counts_as_columns_do(spark):
    left, right = scenarios.pair(spark, "small_mismatch", 10_000)
    for hashed in (False, True):
        r = compare(left, right, keys="id", config=ReconConfig(row_hash=hashed, sample_limit=3))
        assert (r.missing_in_left, r.missing_in_right, r.changed_rows) == scenarios.truth("small_mismatch", 10_000)
    assert [set(s) for s in r.sample_mismatches["changed"]] == [{"id"}] * 3


@pytest.mark.parametrize("scenario", scenarios.SCENARIOS)
def test_scenarios(spark, scenario):
    r = compare(*scenarios.pair(spark, scenario, 5000), keys="id")
    assert (r.missing_in_left, r.missing_in_right, r.changed_rows) == scenarios.truth(scenario, 5000)


def test_columns(spark):
    schema = "id int, v int, noise int"
    left, right = pair(spark, [(1, 1, 1)], [(1, 1, 2)], schema)
    assert compare(left, right, keys="id", exclude_columns=["noise"]).status == "MATCH"
    assert compare(left, right, keys="id", columns=["v"]).status == "MATCH"
    assert compare(left, right, keys="id").changed_rows == 1


def test_mapping(spark):
    left, right = pair(spark, [(1, 5.0)], [(1, 5.0)], "id int, amount double", "id int, total double")
    for mode in ("keyed", "hash", "profile", "sampled"):
        assert compare(left, right, keys="id", compare_mode=mode, config=ReconConfig(column_mapping={"amount": "total"})).status == "MATCH"
    changed = spark.createDataFrame([(1, 6.0)], "id int, total double")
    assert compare(left, changed, keys="id", config=ReconConfig(column_mapping={"amount": "total"})).changed_rows == 1
    stray, right = pair(spark, [(1, 5, "x")], [(1, 5)], "id int, a int, b string", "id int, b int")
    r = compare(stray, right, keys="id", config=ReconConfig(column_mapping={"a": "b"}))
    assert r.data_match and not r.schema_match and "b" not in r.column_stats["fast_path"]["columns_hashed"]


def test_odd_names(spark):
    left, right = pair(spark, [(1, 2)], [(1, 3)], "`id\"we.ird` int, `a``b` int")
    assert compare(left, right, keys=['id"we.ird']).changed_rows == 1


def test_modes(spark):
    left, right = pair(spark, [(1, "a"), (2, "b")], [("1", "a"), ("2", "b")], "id int, v string", "id string, v string")
    r = compare(left, right, compare_mode="names_only")
    assert r.status == "MATCH" and r.schema_diff.logical_left == {}
    assert compare(left, right, compare_mode="rowcount").data_match
    assert not compare(left, right.limit(1), compare_mode="rowcount").data_match
    r = compare(left, left, compare_mode="profile")
    assert r.column_stats["v"]["left"] == {"nulls": 0, "distinct": 2, "min": "a", "max": "b"}
    r = compare(left, left.orderBy("v"), keys="id", compare_mode="hash")
    assert r.status == "MATCH" and r.column_stats["hash"]["columns_hashed"] == ["v"] and len(r.column_stats["hash"]["left_checksum"]) == 16


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id int, v int")
    assert compare(none, none, keys="id").status == "MATCH"
    r = compare(none, spark.createDataFrame([(1, 1)], "id int, v int"), keys="id", compare_mode="sampled")
    assert r.column_stats["sampled"] == {"requested_keys": 1000, "actual_keys_sampled": 0, "empty_sample": True}


def test_sampled(spark):
    left = spark.range(100).selectExpr("id", "id * 2 as v")
    right = left.selectExpr("id", "if(id = 3, -1, v) as v")
    r = compare(left, right, keys="id", compare_mode="sampled", config=ReconConfig(sample_size_keyed=10))
    assert (r.row_count_left, r.row_count_right) == (10, 10) and r.column_stats["sampled"]["actual_keys_sampled"] == 10
    assert compare(left, right, keys="id", compare_mode="sampled").changed_rows == 1
    assert "sampled" in compare(left, right, compare_mode="sampled").error


def regions(spark):
    rows = [(i, "EU" if i <= 10 else "US", float(i)) for i in range(1, 21)]
    return pair(spark, rows, [(i, r, a + (i == 15)) for i, r, a in rows if i != 3], "id int, region string, amount double")


def test_partitions(spark):
    left, right = regions(spark)
    r = compare(left, right, keys="id", partition=PartitionSpec("region"))
    eu, us = r.column_stats["partitions"]
    assert (eu["partition"], eu["missing_in_right"], us["partition"], us["changed_rows"], us["missing_in_right"]) == ("EU", 1, "US", 1, 0)
    assert r.column_stats["partitioned_by"]["n_partitions"] == 2 and "fast_path" not in r.column_stats
    r = compare(left, left, keys="id", partition=PartitionSpec("id", "hash", buckets=4))
    assert r.status == "MATCH" and sum(p["row_count_left"] for p in r.column_stats["partitions"]) == 20 and len(r.column_stats["partitions"]) == 4
    r = compare(left, right, keys="id", partition=PartitionSpec("id", "range", boundaries=[(1, 11), (11, 16), (14, 21), (90, 99)]))
    assert [(p["partition"], p["missing_in_right"], p["changed_rows"]) for p in r.column_stats["partitions"]] == [("[1, 11)", 1, 0), ("[11, 16)", 0, 1), ("[14, 21)", 0, 1), ("[90, 99)", 0, 0)]
    r = compare(left, right, keys="id", partition=PartitionSpec("id", max_partitions=5))
    assert r.status == "ERROR" and "max_partitions" in r.error
    assert compare(left, right, keys="id", partition=PartitionSpec("id", "range")).status == "ERROR"
    assert compare(left, right, keys="id", partition=PartitionSpec("id", "odd")).status == "ERROR"
    assert compare(left, right, keys="id", partition=PartitionSpec("nowhere")).status == "ERROR"


def test_errors_are_results(spark):
    left = spark.createDataFrame([(1, 1)], "id int, v int")
    for kw, word in (({"compare_mode": "odd"}, "odd"), ({}, "requires"), ({"keys": "nope"}, "nope")):
        r = compare(left, left, **kw)
        assert r.status == "ERROR" and word in r.error and r.exit_code == 2
    assert compare("no source", left, keys="id").status == "ERROR"
    with pytest.raises(ConfigError):
        ReconConfig().with_changes(nonsense=1)
    with pytest.raises(TypeError):
        ReconConfig(nonsense=1)
    assert issubclass(CompareError, Exception)


def test_own_sources(spark):
    class Own(Source):
        def load(self, spark):
            return spark.createDataFrame([(1, 1)], "id int, v int")

    assert compare(Own(), DataFrameSource(Own().load(spark)), keys="id").status == "MATCH"


def test_logical_types(spark):
    rows = [("1", "1.5", "2024-01-01", "2024-01-01 10:00:00", "true", "x", "2024-01-01T10:00:00", None, "7", "1d", " "), ("-2", "1e3", "2024-12-31", "2024-01-02 00:00:00", "No", "y z", "2024-01-02T10:00:00", None, "", "2024", None)]
    df = spark.createDataFrame(rows, "i string, d string, dt string, ts string, b string, t string, iso string, n string, blanks string, odd string, white string")
    assert lt.infer(df) == {"i": "integer", "d": "decimal", "dt": "date", "ts": "timestamp", "b": "bool", "t": "text", "iso": "timestamp", "n": "null", "blanks": "integer", "odd": "text", "white": "integer"}


def test_logical_types_look_past_the_first_rows(spark):
    df = spark.range(40_000, numPartitions=1).selectExpr("case when id < 20000 then cast(id as string) else 'word' end as t", "case when id = 39999 then 'word' else '1' end as u")
    assert lt.infer(df) == {"t": "text", "u": "text"}
    assert lt.infer(df, 10_000)["t"] == "text"
    numbers = spark.range(40_000, numPartitions=1).selectExpr("id", "cast(1 as bigint) as t")
    r = compare(df.selectExpr("row_number() over (order by 1) - 1 as id", "t"), numbers, keys="id")
    assert r.schema_diff.logical_type_mismatches == {"t": {"left": "text", "right": "integer"}}


def test_stored_types_count_without_inference(spark):
    left, right = pair(spark, [("1",)], [(1,)], "id string", "id bigint")
    d = compare_schemas(left.schema, right.schema, ReconConfig())
    assert not d.match and d.type_mismatches == {"id": {"left": "string", "right": "bigint"}}
    left, right = pair(spark, [(1, 1)], [(1, 1)], "id int, a int", "id bigint, c int")
    d = compare_schemas(left.schema, right.schema, ReconConfig())
    assert (d.missing_in_left, d.missing_in_right, d.type_mismatches) == (["c"], ["a"], {})


def test_random_pairs_against_sql(spark):
    import random

    r = random.Random(11)
    for _ in range(3):
        make = lambda n: [(r.choice([None, *range(12)]), r.choice([None, "a", "b"]), r.choice([None, 1, 2])) for _ in range(n)]
        left, right = make(25), make(25)
        got = compare(*pair(spark, left, right, "k int, s string, v int"), keys=["k", "s"], config=ReconConfig(fast_path=False))
        db = duckdb.connect()
        for name, rows in (("l", left), ("r", right)):
            db.execute(f"CREATE TABLE {name} (k INT, s VARCHAR, v INT)")
            db.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", rows)
        count = lambda sql: db.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]
        gone = "SELECT DISTINCT k, s FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {1} b WHERE a.k = b.k AND a.s = b.s)"
        want = (count(gone.format("r", "l")), count(gone.format("l", "r")), count("SELECT 1 FROM l JOIN r ON l.k = r.k AND l.s = r.s WHERE l.v IS DISTINCT FROM r.v"), *(count(f"SELECT k, s FROM {t} GROUP BY ALL HAVING count(*) > 1") for t in "lr"))
        assert (got.missing_in_left, got.missing_in_right, got.changed_rows, got.duplicate_keys_left, got.duplicate_keys_right) == want


def stored_orders(spark, folder, keys):
    cols = "o_orderkey", "o_orderkey % 7 as o_custkey", "'F' as o_orderstatus", "cast(o_orderkey as double) as o_totalprice", "timestamp '1995-01-01' + make_interval(0, 0, 0, cast(o_orderkey % 2400 as int)) as o_orderdate", "'1-URGENT' as o_orderpriority"
    keys.selectExpr(*cols).write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet/*.parquet')")
    return con


def test_date_ranges_take_in_all_orders_but_the_gap(spark, tmp_path):
    con = stored_orders(spark, tmp_path, spark.range(24_000).withColumnRenamed("id", "o_orderkey"))
    got = [tuple(r) for r in catalogue.QUERIES["partition_range_dates"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(catalogue.ORACLE_SQL["partition_range_dates"]).fetchall())
    assert sum(r[1] for r in got) == 24_000 - 30 * 10 and min(r[1] for r in got) == 0 and sum(r[-1] for r in got) > 200


def test_sampled_semi_join_takes_all_keys_of_its_sql(spark, tmp_path):
    con = stored_orders(spark, tmp_path, spark.range(101_000).selectExpr("id * 50 as o_orderkey"))
    got = catalogue.QUERIES["sampled_semi_join"](spark, str(tmp_path)).first().n
    assert got == con.execute(catalogue.ORACLE_SQL["sampled_semi_join"]).fetchone()[0] > 100_000


def test_public_queries_match_their_sql(spark):
    """The queries through compare(), sources and reports, against DuckDB over the small tables."""
    import glob
    import os

    import duckdb
    import pytest

    from evenkeel.plans import public

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    for name in ("compare_keyed", "compare_partitioned", "source_sqlite", "source_xml", "source_mainframe_lines", "report_csv_diff"):
        df = public.QUERIES[name](spark, folder)
        columns = ", ".join(f'"{c}"' for c in df.columns)
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, db.sql(f"SELECT {columns} FROM ({public.ORACLE_SQL[name]})").fetchall())), name
