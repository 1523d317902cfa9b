import hashlib
import random

import duckdb
from pyspark.sql import types as T

from evenkeel.llm import chat_format as cf

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("parts", T.StringType())])


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fixture():
    r = random.Random(1)
    bits = ["<|turn|>", "<|end|>\n", "&lt;", "&amp;", "[INST]", "</s>", "é", "😀", "\n", " ", "hello", "&", "<", "[", "<|image:0|>"]
    rows = [(c, t, r.choice(["user", "assistant", "system"]), "".join(r.choice(bits) for _ in range(r.randrange(0, 12))), "x") for c in range(20) for t in range(r.randrange(1, 7))]
    return rows + [(50, 0, None, None, "x"), (50, 1, "assistant", None, "x"), (51, 2, "a<b", "same", "x"), (51, 2, "a<b", "same", "x"), (51, None, "assistant", "null turn", "x"), (None, 0, "assistant", "no id", "x"), (52, 0, "assistant", "long & " * 20_000, "x")]


def test_report_reads_back_what_went_in(spark):
    rows = fixture()
    got = {r.conv_id: r for r in cf.report(spark.createDataFrame(rows, ROWS).repartition(3)).collect()}
    every = rows + [(-1, 0, "user", cf.CONTROL_TEXT, ""), (-1, 1, "assistant", cf.CONTROL_TEXT, "")]
    for conv in {r[0] for r in every}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in every if c == conv))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert not got


def test_report_matches_its_sql(spark):
    rows = [r for r in fixture() if r[0] is not None]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    want = sorted(db.execute(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({cf.REPORT_SQL})").fetchall())
    assert sorted(map(tuple, cf.report(spark.createDataFrame(rows, ROWS)).collect())) == want


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_typed_parts(spark):
    turns = [(1, 0, "user", [part("text", "see <this>"), part("image", ref="a.png", width=1000, height=500), part("audio", ref="b.wav", seconds=2.5)]), (1, 1, "assistant", [part("text", "one "), part("document", ref="c.pdf", pages=3), part("text", "two")]), (2, 0, "user", None)]
    r = {x.conv_id: x for x in cf.format_chats(spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{cf.PART}>")).collect()}
    text = "<|turn|>user\nsee &lt;this><|image:0|><|audio:1|><|end|>\n<|turn|>assistant\none <|document:2|>two<|end|>\n"
    assert r[1].formatted == text
    assert [text[s.start : s.start + s.length] for s in r[1].loss] == ["one ", "two"]
    assert [tuple(a) for a in r[1].attachments] == [(0, "image", "a.png", 85 + 170 * 2), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 1200)]
    assert r[1].expanded_tokens == 85 + 340 + 63 + 1200 and r[2].formatted == "<|turn|>user\n<|end|>\n"


def test_empty_table_gives_the_control_conversation(spark):
    assert [r.conv_id for r in cf.report(spark.createDataFrame([], ROWS)).collect()] == [-1]
