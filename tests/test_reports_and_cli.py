import csv
import io
import json
from xml.etree import ElementTree as ET

import pytest

from evenkeel import PartitionSpec, compare
from evenkeel.cli import main, parse_partition, parse_source
from evenkeel.plans import catalogue


@pytest.fixture(scope="module")
def result(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "<c>")], "id long, amt long, region string")
    right = spark.createDataFrame([(1, 10, "a"), (2, 21, "b"), (4, 40, "a")], "id long, amt long, region string")
    return compare(left, right, keys="id", partition=PartitionSpec("region"))


def test_json(result, tmp_path):
    path = str(tmp_path / "r.json")
    text = result.to_json(path)
    assert '"status":"MISMATCH"' in text and open(path).read() == text
    d = json.loads(result.to_json(indent=True))
    assert (d["changed_rows"], d["missing_in_left"], d["missing_in_right"], d["keys"]) == (1, 1, 1, ["id"]) and d["execution_metrics"]["engine"] == "spark"


def test_csv(result):
    sheet = list(csv.DictReader(io.StringIO(result.to_csv())))
    assert [(r["__bucket"], r["id"], r.get("amt__right")) for r in sheet] == [("missing_in_left", "4", ""), ("missing_in_right", "3", ""), ("changed", "2", "21")]
    assert dict(csv.reader(io.StringIO(result.to_csv(layout="summary"))))["changed_rows"] == "1"
    with pytest.raises(ValueError):
        result.to_csv(layout="odd")


def test_text_and_summary(result):
    full = result.to_text(detail="full")
    assert "MISMATCH" in full and "Partitions" in full and "Changed (1 sample row)" in full
    assert "Changed" not in result.to_text(detail="summary")
    assert result.summary().splitlines()[0] == "status               : MISMATCH" and len(result.summary().splitlines()) == 13
    with pytest.raises(ValueError):
        result.to_text(detail="odd")


def test_html(result):
    page = result.to_html(title="A & B")
    assert "A &amp; B" in page and "http" not in page and "hsl(" in page and "&lt;c&gt;" in page
    assert "missing in left" in page and "missing in left" not in result.to_html(detail="diff")
    with pytest.raises(ValueError):
        result.to_html(detail="odd")


def test_junit(result):
    suite = ET.fromstring(result.to_junit().encode()).find("testsuite")
    assert (suite.get("tests"), suite.get("errors")) == ("4", "0") and int(suite.get("failures")) == 4
    assert [c.get("name") for c in suite.findall("testcase")] == ["compare[id]", "partition[<c>]", "partition[a]", "partition[b]"]


def test_row_of_a_result(spark, result):
    row = result.to_df(spark).first()
    assert (row.status, row.changed_rows, row.data_match) == ("MISMATCH", 1, False)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_text("id,amount,region\n1,10,x\n2,20,y\n3,30,x\n")
    (tmp_path / "b.csv").write_text("id,amount,region\n1,10,x\n2,21,y\n4,40,x\n")
    return f"csv:{tmp_path}/a.csv", f"csv:{tmp_path}/b.csv", tmp_path


def test_cli(spark, files, capsys):
    a, b, folder = files
    assert main(["--left", a, "--right", a, "--keys", "id"]) == 0
    assert "MATCH" in capsys.readouterr().out
    assert main(["compare", "--left", a, "--right", b, "-k", "id", "--quiet", "--report", f"json:{folder}/r.json", "--report", f"html:{folder}/r.html", "--junit", f"{folder}/r.xml"]) == 1
    assert capsys.readouterr().out == "" and json.load(open(folder / "r.json"))["changed_rows"] == 1 and (folder / "r.html").exists() and (folder / "r.xml").exists()
    assert main(["--left", a, "--right", b, "--keys", "id", "--fail-on", "never", "--quiet"]) == 0
    assert main(["--left", a, "--right", b, "--keys", "id", "--fail-on", "error", "--quiet", "--partition", "region", "-v"]) == 0
    assert main(["--left", a, "--right", "csv:/nowhere.csv", "--keys", "id", "--fail-on", "error", "--quiet"]) == 2
    assert main(["--left", a, "--right", b, "--keys", "id", "--quiet", "--mode", "hash"]) == 1
    assert main(["--left-type", "csv", "--left-path", a[4:], "--right-type", "csv", "--right-path", a[4:], "--keys", "id", "--quiet"]) == 0


def test_cli_usage_errors(files, capsys):
    a, b, _ = files
    for bad in (["--left", "odd:x", "--right", b], ["--left", a], ["--left", a, "--right", b, "--tolerance", "x"], ["--left", a, "--right", b, "--report", "pdf:x"], ["--left", a, "--right", b, "--partition", "c:odd"], ["--left-type", "csv", "--right", b], ["--left", "sqltable:x", "--right", b], ["--left", "fixed:f#a:b", "--right", b]):
        assert main(["compare", *bad]) == 2
    assert parse_source("sqltable:postgresql://h/d?a=b#c#t").table == "t" and parse_source("fixed:f#a:1:2,b:3:4").columns == [("a", 1, 2), ("b", 3, 4)]
    assert parse_partition("id:range:1,5;5,x").boundaries == [(1, 5), (5, "x")] and parse_partition("id:hash:4").buckets == 4


def test_catalogue_has_sql_for_every_query():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
