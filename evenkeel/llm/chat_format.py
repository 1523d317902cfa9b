"""Chat formatting: conversations with typed content parts become one marked string each, and back.

DataFrame operations only. A turn is START role newline text END newline. In texts and roles, "&", "<"
and "[" are written "&amp;", "&lt;" and "&lsqb;", so no control string, of this template or another,
can stand in a text, and every text reads back exactly. A visitor flattens the parts of a turn in order: a text part is its escaped
text, an image, audio or document part a placeholder with its number in the conversation, for which it
records the reference and how many tokens it stands for. The loss mask is a list of spans, in code
points of the formatted string, over the text parts of assistant turns.

Defined cases: a null text is empty, a null role is empty; rows of a conversation stand in the order of
turn (null first), role, text, so ties and repeated rows have one result and each row is a turn; rows
with a null conv_id are one conversation; an unknown kind of part is text; an empty table gives no
rows; further columns play no part. A conversation is one string by its nature, and is put together in
one task; different conversations are not grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import materialise

START, END = "<|turn|>", "<|end|>\n"
CONTROL_TEXT = "</s>[INST] ok [/INST]"
IMAGE_TILE, IMAGE_TILE_TOKENS, IMAGE_BASE_TOKENS = 512, 170, 85
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 400

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&lsqb;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def expanded_tokens(part: Column) -> Column:
    """How many tokens an attachment stands for: image tiles, seconds of audio, pages of a document."""
    tiles = F.ceil(F.greatest(F.coalesce(part["width"], F.lit(1)), F.lit(1)) / IMAGE_TILE) * F.ceil(F.greatest(F.coalesce(part["height"], F.lit(1)), F.lit(1)) / IMAGE_TILE)
    return (
        F.when(part["kind"] == "image", IMAGE_BASE_TOKENS + IMAGE_TILE_TOKENS * tiles)
        .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_TOKENS_A_SECOND))
        .when(part["kind"] == "document", DOCUMENT_TOKENS_A_PAGE * F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(0)))
        .otherwise(0)
        .cast("long")
    )


def text_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts: each row's text as its only part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    full = F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return rows.select("conv_id", "turn", "role", F.array(full).cast(f"array<{PART}>").alias("parts"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans: start from 0, length), attachments (number, kind, ref, tokens), n_turns, expanded_tokens.

    turns has conv_id, turn, role and parts, an array of PART. Where a turn starts, and the number of its
    first attachment, are running sums over the conversation's earlier turns.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    attached = lambda p: p["kind"].isin("image", "audio", "document")
    parts = F.filter(F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)")), lambda p: p.isNotNull())
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts"))
    rows = rows.withColumn("held", F.filter("parts", attached)).withColumn("number", F.coalesce(F.sum(F.size("held")).over(earlier), F.lit(0)))

    def visit(part: Column, i: Column) -> Column:
        number = F.col("number") + F.size(F.filter(F.slice("parts", F.lit(1), i), attached))
        return F.when(attached(part), F.concat(F.lit("<|"), part["kind"], F.lit(":"), number.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    head = F.concat(F.lit(START), escape(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("outs", F.transform("parts", visit))
    rows = rows.withColumn("out", F.concat("head", F.array_join("outs", ""), F.lit(END)))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("out").cast("long")).over(earlier), F.lit(0))).withColumn("no", F.row_number().over(by))

    def span(out: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("outs", F.lit(1), i), F.lit(0), lambda n, o: n + F.length(o))
        start = F.col("start") + F.length("head") + before
        return F.struct(start.alias("start"), F.length(out).cast("long").alias("length"), attached(F.get(F.col("parts"), i)).alias("other"))

    spans = F.filter(F.transform("outs", span), lambda x: ~x["other"] & (x["length"] > 0))
    spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    loss = F.when(F.col("role") == "assistant", spans).otherwise(F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)"))
    notes = F.transform("held", lambda p, i: F.struct((F.col("number") + i).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    rows = rows.select("conv_id", F.struct("no", "out", loss.alias("loss"), notes.alias("notes")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    flat = lambda field: F.flatten(F.transform("t", lambda t: t[field]))
    out = chats.select("conv_id", F.array_join(F.transform("t", lambda t: t["out"]), "").alias("formatted"), flat("loss").alias("loss"), flat("notes").alias("attachments"), F.size("t").cast("long").alias("n_turns"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from the formatted string and its loss spans alone."""
    marked = F.split("formatted", END.replace("|", r"\|"))
    bodies = F.filter(marked, lambda x: x.startswith(START))
    cut = F.transform(bodies, lambda x: F.substring(x, len(START) + 1, 2147483647))
    turns = F.transform(
        cut,
        lambda x: F.struct(
            unescape(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text"),
        ),
    )
    spans = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(spans, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def control_rows(spark: SparkSession) -> DataFrame:
    """Conversation -1: two turns whose texts are control strings of another template."""
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))


def report(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: of the written and reread output for rows and conversation -1."""
    every = rows.select("conv_id", "turn", "role", "text").unionByName(control_rows(rows.sparkSession))
    written = materialise(format_chats(text_turns(every)).select("conv_id", "formatted", "loss"), "chats")
    back = read_back(written)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


#: DuckDB's sort of turns follows format_chats(): turn with null first, then role, then text.
REPORT_SQL = f"""
WITH every AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}'
    UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM every
), s AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length(role) + length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
            + 5 * (length(text) - length(replace(text, '[', ''))) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', '')))
            + 5 * (length(role) - length(replace(role, '[', ''))) + {len(START) + 1 + len(END)}) AS chars
    FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
    sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM s"""
