"""Round trips of every kind of file, by files made here."""

import gzip
import json
import sqlite3
import struct
import zipfile
import zlib
from decimal import Decimal

import pytest

from evenkeel import AvroFile, CsvFile, ExcelFile, FixedWidthFile, JdbcQuery, JsonFile, MainframeFile, OdbcQuery, OrcFile, ParquetFile, PostgresSource, SourceError, SqlQuery, SqlTable, XmlFile, compare, source
from evenkeel.sources.base import spark_path
from evenkeel.sources.databases import jdbc_options, libpq, to_libpq
from evenkeel.sources.decoded import packed, unwrapped, zoned


def rows(src, spark):
    return sorted(map(tuple, src.load(spark).collect()), key=repr)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,x\n1,"a, ""b""",1.5\n2,,2\n')
    assert rows(source(str(tmp_path / "a.csv")), spark) == [(1, 'a, "b"', 1.5), (2, None, 2.0)]
    (tmp_path / "a.tsv").write_text("id\tv\n1\ta\n")
    (tmp_path / "a.psv").write_text("id|v\n1|a\n")
    (tmp_path / "a.txt").write_text("id;v\n1;a\n")
    assert all(rows(source(str(tmp_path / f"a.{e}")), spark) == [(1, "a")] for e in ("tsv", "psv", "txt"))
    (tmp_path / "b.csv").write_text("# junk\nid,v\n1,NA\n")
    assert rows(CsvFile(str(tmp_path / "b.csv"), {"skip": 1, "nullstr": "NA"}), spark) == [(1, None)]
    assert rows(CsvFile(str(tmp_path / "a.csv"), {"all_varchar": True}), spark)[0] == ("1", 'a, "b"', "1.5")
    with pytest.raises(SourceError):
        CsvFile(str(tmp_path / "a.csv"), {"nonsense": 1}).load(spark)


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "n": {"x": [1, 2]}}\n{"id": 2}\n')
    (tmp_path / "b.json").write_text('  [{"id": 1, "v": "a"},\n {"id": 2, "v": null}]')
    (tmp_path / "c.ndjson").write_text('{"id": 1}\n')
    assert [r[0] for r in rows(JsonFile(str(tmp_path / "a.json")), spark)] == [1, 2]
    assert rows(source(str(tmp_path / "b.json")), spark) == [(1, "a"), (2, None)]
    assert rows(source(str(tmp_path / "c.ndjson")), spark) == [(1,)]


def test_parquet_and_orc(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, part string")
    df.write.partitionBy("part").parquet(str(tmp_path / "p"))
    df.write.orc(str(tmp_path / "o.orc"))
    assert rows(ParquetFile(str(tmp_path / "p")), spark) == [(1, "a", "x"), (2, "b", "y")]
    assert rows(ParquetFile(str(tmp_path / "p" / "part=*" / "*.parquet")), spark) == [(1, "a"), (2, "b")]
    assert rows(OrcFile(str(tmp_path / "o.orc"), ["v"]), spark) == [("a",), ("b",)]
    plan = ParquetFile(str(tmp_path / "p")).load(spark).where("part = 'x' and id = 1").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(id,1)" in plan


def test_fixed_width(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.dat").write_text("HEADER\nHEADER 2\n00001Alice     10.5\n00002Bob  \n")
    src = FixedWidthFile(str(tmp_path / "*.dat"), [("id", 1, 5), ("name", 6, 10), ("both", 4, 4)], skip_rows=2)
    assert rows(src, spark) == [("00001", "Alice     ", "01Al")] * 2 + [("00002", "Bob  ", "02Bo")] * 2
    assert rows(FixedWidthFile(str(tmp_path / "a.dat"), [("name", 6, 10)], 2, True), spark) == [("Alice",), ("Bob",)]
    for bad in ([], [("x", 0, 1)], [("x", 1, 0)]):
        with pytest.raises(SourceError):
            FixedWidthFile("x", bad)


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<r xmlns:n="urn:n"><orders><order id="1"><amount> 5 </amount><n:tag>t</n:tag><addr zip="9"/></order><order id="2"><amount/></order></orders></r>')
    path = str(tmp_path / "a.xml")
    named = {"id": "@id", "amount": "amount", "tag": "n:tag", "zip": "addr/@zip"}
    for record in ("order", "./orders/order", "//order"):
        assert rows(XmlFile(path, record, named, {"n": "urn:n"}), spark) == [("1", "5", "t", "9"), ("2", None, None, None)]
    auto = XmlFile(path, "order").load(spark)
    assert auto.columns == ["@id", "amount", "tag", "addr"] and auto.count() == 2
    (tmp_path / "b.xml").write_text("<r><id>1</id><v>x</v></r>")
    assert rows(source(str(tmp_path / "b.xml")), spark) == [("1", "x")]


def zigzag(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def avro(schema, records, codec):
    text = lambda s: zigzag(len(s)) + s
    head = b"Obj\x01" + zigzag(2) + text(b"avro.schema") + text(json.dumps(schema).encode()) + text(b"avro.codec") + text(codec.encode()) + b"\x00" + b"M" * 16
    data = b"".join(records)
    if codec == "deflate":
        data = zlib.compress(data)[2:-4]
    return head + (zigzag(len(records)) + text(data) + b"M" * 16 if records else b"")


def test_avro(spark, tmp_path):
    fields = [("id", "int"), ("name", ["null", "string"]), ("x", "double"), ("tags", {"type": "array", "items": "string"}), ("day", {"type": "int", "logicalType": "date"}), ("amount", {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}), ("mixed", ["int", "string"])]
    schema = {"type": "record", "name": "row", "fields": [{"name": n, "type": t} for n, t in fields]}
    one = zigzag(1) + zigzag(1) + zigzag(1) + b"a" + struct.pack("<d", 1.5) + zigzag(1) + zigzag(1) + b"t" + b"\x00" + zigzag(1) + zigzag(2) + b"\x30\x39" + zigzag(0) + zigzag(7)
    two = zigzag(2) + zigzag(0) + struct.pack("<d", 2.5) + b"\x00" + zigzag(0) + zigzag(1) + b"\xff" + zigzag(1) + zigzag(1) + b"m"
    for codec in ("null", "deflate"):
        (tmp_path / "a.avro").write_bytes(avro(schema, [one, two], codec))
        got = AvroFile(str(tmp_path / "a.avro")).load(spark).orderBy("id").collect()
        assert [(r.id, r.name, r.x, r.tags, str(r.day), r.amount, r.mixed) for r in got] == [(1, "a", 1.5, ["t"], "1970-01-02", Decimal("123.45"), "7"), (2, None, 2.5, [], "1970-01-01", Decimal("-0.01"), "m")]
    (tmp_path / "e.avro").write_bytes(avro(schema, [], "null"))
    empty = AvroFile(str(tmp_path / "e.avro")).load(spark)
    assert empty.columns == [n for n, _ in fields] and empty.count() == 0
    assert unwrapped({"string": "x"}) == "x" and unwrapped({"a.b.C": 1}) == 1 and unwrapped({"zip": 1}) == {"zip": 1}


def test_mainframe(spark, tmp_path):
    assert [packed(bytes.fromhex(h)) for h in ("123c", "123d", "123f", "123a", "123b", "1231", "1a3c", "")] == [123, -123, 123, 123, -123, None, None, None]
    assert packed(bytes.fromhex("012345c0")[:3], 2) is None and packed(bytes.fromhex("12345c"), 2) == Decimal("123.45")
    assert zoned(b"\xf1\xf2\xd3", 1) == Decimal("-12.3") and zoned(b"\xf1\xc2") == 12 and zoned(b"") is None
    record = lambda acct, balance, n, status: acct.ljust(10).encode("cp037") + bytes.fromhex(balance) + struct.pack(">i", n) + status.encode("cp037")
    fields = [{"name": "acct", "start": 1, "length": 10}, {"name": "balance", "start": 11, "length": 5, "type": "comp3", "scale": 2}, {"name": "txn", "start": 16, "length": 4, "type": "binary"}, {"name": "status", "start": 20, "length": 1}]
    (tmp_path / "m.bin").write_bytes(b"HEAD" + record("ACC1", "000012345c", 7, "A") + record("ACC2", "000099999d", -1, "B") + b"partial")
    got = rows(source(str(tmp_path / "m.bin"), mainframe=True, fields=fields, record_length=20, skip_bytes=4), spark)
    assert got == [("ACC1", Decimal("123.45"), 7, "A"), ("ACC2", Decimal("-999.99"), -1, "B")]
    (tmp_path / "l.txt").write_text("12x\n 34\n\n")
    lines = MainframeFile(str(tmp_path / "l.txt"), [{"name": "n", "start": 1, "length": 3, "type": "int"}], encoding="ascii")
    assert rows(lines, spark) == [(34,), (None,)]
    for bad in ([], [{"name": "x", "start": 0, "length": 1}], [{"name": "x", "start": 1, "length": 1, "type": "odd"}]):
        with pytest.raises(SourceError):
            MainframeFile("x", bad)


def test_mainframe_values_that_are_none(spark, tmp_path):
    assert [zoned(bytes.fromhex(h)) for h in ("4040f5", "c1f2d3", "f1f2", "f1fa", "f112", "f0d0")] == [None, None, 12, None, None, 0]
    assert zoned(b"12\x33", encoding="ascii") is None and zoned(b"12\xc3", encoding="ascii") == 123
    assert packed(bytes.fromhex("1234567890123456789012345678901d"), 2) == Decimal("-12345678901234567890123456789.01")
    fields = [{"name": "n", "start": 1, "length": 20, "type": "int"}, {"name": "p", "start": 21, "length": 20, "type": "comp3"}, {"name": "z", "start": 41, "length": 3, "type": "zoned"}]
    long, short = bytes.fromhex("9" * 39 + "c"), bytes.fromhex("0" * 37 + "12d")
    numbers = ["99999999999999999999", "9223372036854775807".rjust(20), "-9223372036854775808", "9223372036854775808".rjust(20)]
    data = b"".join(n.encode("cp037") + p + z for n, p, z in zip(numbers, (long, short, long, short), (b"\x40\x40\xf5", b"\xf1\xf2\xd3", b"\xf0\xf0\xc0", b"\xc1\xf2\xd3"), strict=True))
    (tmp_path / "m.bin").write_bytes(data)
    got = rows(source(str(tmp_path / "m.bin"), mainframe=True, fields=fields, record_length=43), spark)
    assert sorted(got, key=repr) == sorted([(None, None, None), (9223372036854775807, -12, -123), (-9223372036854775808, None, 0), (None, -12, None)], key=repr)


def test_excel(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>day</t></is></c></row><row><c r="A2"><v>1</v></c><c r="C2" s="1"><v>45292</v></c></row><row><c r="A3"><v>2</v></c><c r="B3" t="str"><v>b</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="b"><v>1</v></c></row></sheetData></worksheet>')
    df = ExcelFile(str(tmp_path / "a.xlsx")).load(spark)
    assert df.columns == ["id", "name", "day"] and [(r.id, r.name, str(r.day)) for r in df.orderBy("id").collect()] == [(1, None, "2024-01-01 00:00:00"), (2, "b", "None")]
    assert rows(ExcelFile(str(tmp_path / "a.xlsx"), "Two", has_header=False), spark) == [(True,)]
    with pytest.raises(SourceError):
        ExcelFile(str(tmp_path / "a.xlsx"), "Three").load(spark)
    (tmp_path / "b.xlsx").write_bytes(gzip.compress(b"x"))
    with pytest.raises(SourceError):
        ExcelFile(str(tmp_path / "b.xlsx")).load(spark)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, sku TEXT, x)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, None if i % 7 == 0 else f"s{i}", None if i < 40 else i / 2 if i < 80 else i) for i in range(100)])
    want = [(i, None if i % 7 == 0 else f"s{i}", None if i < 40 else i / 2 if i < 80 else float(i)) for i in range(100)]
    for size in (7, 50, 1000):
        assert sorted(map(tuple, SqlTable(f"sqlite:///{path}", "t", chunk_size=size).load(spark).collect())) == want
    assert sorted(map(tuple, SqlTable(f"sqlite:///{path}", "t", streaming=False).load(spark).collect())) == want
    assert rows(SqlQuery(f"sqlite:///{path}", "SELECT id FROM t WHERE id < 2"), spark) == [(0,), (1,)]
    r = compare(SqlTable(f"sqlite:///{path}", "t"), SqlQuery(f"sqlite:///{path}", "SELECT * FROM t WHERE id <> 3"), keys="id")
    assert (r.missing_in_right, r.row_count_left, r.status) == (1, 100, "MISMATCH")
    assert compare(SqlTable("sqlite:////nowhere.db", "t"), SqlTable("sqlite:////nowhere.db", "t"), keys="id").status == "ERROR"


def test_jdbc_with_an_embedded_database(spark):
    url = "jdbc:derby:memory:evenkeel;create=true"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    q = JdbcQuery(url, "org.apache.derby.jdbc.EmbeddedDriver", query='SELECT * FROM t WHERE "id" > 1')
    assert rows(q, spark) == [(2, "b")]
    wide = 'SELECT "id", "v" FROM t UNION ALL SELECT "id" + 10 AS "id", "v" FROM t'
    split = JdbcQuery(url, "org.apache.derby.jdbc.EmbeddedDriver", query=wide, partition_column="id", num_partitions=2).load(spark)
    assert split.rdd.getNumPartitions() == 2 and sorted(r[0] for r in split.collect()) == [1, 2, 11, 12]
    with pytest.raises(SourceError):
        JdbcQuery(url).load(spark)
    with pytest.raises(SourceError):
        JdbcQuery(url, driver_jar="/nowhere.jar", query="x").load(spark)


def test_urls():
    assert jdbc_options("postgresql+psycopg2://u:p%40w@h:5433/db?sslmode=require") == {"url": "jdbc:postgresql://h:5433/db?sslmode=require", "driver": "org.postgresql.Driver", "user": "u", "password": "p@w"}
    assert jdbc_options("mssql+pyodbc://h/db?driver=x&encrypt=true")["url"] == "jdbc:sqlserver://h:1433;databaseName=db;encrypt=true"
    assert jdbc_options("oracle://h/?service_name=s")["url"] == "jdbc:oracle:thin:@//h:1521/s" and jdbc_options("jdbc:x:y") == {"url": "jdbc:x:y"}
    with pytest.raises(SourceError):
        jdbc_options("nosuch://h/db")
    assert libpq("postgresql://u:a%20b@h:1/db?sslmode=require") == {"host": "h", "port": "1", "user": "u", "password": "a b", "dbname": "db", "sslmode": "require"}
    assert to_libpq("postgresql://u:it's@h/db") == "host=h user=u password='it\\'s' dbname=db"
    assert libpq(to_libpq("postgresql://u:it's%20x@h/db"))["password"] == "it's x" and to_libpq("host=h dbname=d") == "host=h dbname=d"
    with pytest.raises(SourceError):
        libpq("mysql://h/db")
    with pytest.raises(SourceError):
        PostgresSource("postgresql://h/db")
    assert PostgresSource("postgresql://u@h/db?sslmode=require", "t").options()["url"] == "jdbc:postgresql://h:5432/db?sslmode=require"
    assert spark_path("s3://b/k") == "s3a://b/k" and spark_path("/x") == "/x"


def test_registry_and_missing_parts(spark):
    assert isinstance(source("https://h/x.parquet?sig=a.csv"), ParquetFile) and isinstance(source("x.XML"), XmlFile)
    assert source("x.tsv", options={"quote": "'"}).options == {"delim": "\t", "quote": "'"}
    for bad in ("x.odd", "x"):
        with pytest.raises(SourceError):
            source(bad)
    with pytest.raises(SourceError):
        OdbcQuery("DSN=x", "SELECT 1").load(spark)
    assert compare(source("/nowhere/a.parquet"), source("/nowhere/b.csv"), keys="id").status == "ERROR"
