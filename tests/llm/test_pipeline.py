import importlib
import random
import sys

import pytest

corpus_pipeline = importlib.import_module("corpus_pipeline")
from evenkeel.llm import queries  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    voc = ["".join(r.choice("abdeghilmnorstu") for _ in range(r.randrange(3, 9))) for _ in range(600)]
    line = lambda n: " ".join(r.choice(voc) for _ in range(n))
    text = lambda: "\n".join(line(r.randrange(8, 20)) for _ in range(5))
    item = line(25)
    docs = {i: text() for i in range(60)}
    for i in range(0, 60, 6):
        docs[i] = docs[i].replace("\n", " you scum idiot\n", 2)
    docs[101], docs[102] = docs[1], " ".join(docs[3].replace("\n", " ").split()[:-1]) + " other"
    docs[3] = docs[3].replace("\n", " ")
    docs[103] = line(10) + " " + item + "\n" + line(9)
    docs[104], docs[105] = None, ""
    docs[106] = docs[7].split("\n")[0] + "\n" + line(12)
    out = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), docs


def test_stages_one_by_one(spark, folder):
    out, docs = folder
    held = spark.read.parquet(f"{out}/documents.parquet")
    columns, seen = held.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, out)
        if name != "packing":
            assert held.columns == columns
            seen[name] = {r.doc_id: r.text for r in held.collect()}
    assert set(docs) - set(seen["toxicity"]) == {i for i in range(0, 60, 6)}
    assert set(seen["toxicity"]) - set(seen["line_dedup"]) == {101, 102}  # a copy; a single line that matches
    assert seen["line_dedup"][106] == docs[106].split("\n")[1] and seen["line_dedup"][104] is None and seen["line_dedup"][105] == ""
    assert set(seen["jaccard_join"]) == set(seen["line_dedup"])
    assert set(seen["jaccard_join"]) - set(seen["decontamination"]) == {103}
    assert {r.doc_id for r in held.collect()} == set(seen["decontamination"])


def test_run_is_the_stages_in_turn(spark, folder):
    out, _ = folder
    rows = queries.QUERIES["pipeline"](spark, out)
    assert rows.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.select("doc_id").distinct().count() == 53


def test_entry_lives_without_this_subpackage(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in names} and "pipeline" in names
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("evenkeel.llm") else real(n, *a))
    rest = set(entry.queries())
    assert rest == names - {q for q in names if q[:2] == "op" or q == "pipeline"}
    assert set(entry.oracle_sql()) <= rest
    assert "corpus_pipeline" in sys.modules
