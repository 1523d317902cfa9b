"""License scans by diagonal voting.

Every rolling word k-gram (k = 2) of every text is joined on its hash to the k-gram positions of the
license templates, a fixed table. A match votes for the diagonal text position - template position of
its document and template. Votes are summed by diagonal; neighbouring diagonals (words put in or left
out) are merged; a merged span is verified by the share of the template's k-grams it holds, its length
and, for the short base phrases, by all k-grams on one diagonal. The join compares the hash of the k-gram
and then its words, so every vote is for words that the text has.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Base phrases give the labels mit,
apache and gpl; templates of longer passages add labels, and never take base ones away.

Defined cases: a null or empty text has no words and no label; repeated rows and doc_ids each get a row;
an empty table gives no rows; further columns play no part. One very long text, or a phrase repeated
in it, is summed by diagonal before anything is grouped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import small_batches
from evenkeel.llm.wordscan import ALNUM, Words, blocks, rolling, scan, scan_column

K = 2
COVERAGE = 0.75
DRIFT = 3  # how far apart diagonals may lie that are merged

# Phrases and opening or granting passages of public licenses.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = {
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["under the terms of the gnu lesser general public license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced or transmitted in any form without prior written permission"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}


def template_rows() -> list[tuple[int, str, int, int]]:
    """(hash, words, template, position) of every k-gram of every phrase and template."""
    rows = []
    for number, (_, text, _) in enumerate(all_templates()):
        words = scan(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), ALNUM)
        for at, h in enumerate(rolling(words.hashes, K).view(np.int64).tolist()):
            rows.append((h, gram_words(words, at), number, at))
    return rows


def gram_words(words: Words, at: int) -> str:
    return b" ".join(words.bytes_of(k) for k in range(at, at + K)).decode()


def all_templates() -> list[tuple[str, str, bool]]:
    """(label, text, whether it is a base phrase)."""
    return [(k, v, True) for k, v in BASE.items()] + [(k, t, False) for k, ts in TEMPLATES.items() for t in ts]


def grams(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_words, at, h, words: every rolling k-gram of every text, and one row with at = -1 for each text.

    words are the gram's own words where its hash is that of a template's gram, else null.
    """
    known = np.unique(np.array([h for h, *_ in template_rows()], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                words = scan_column(part.column(2), ALNUM)
                h = rolling(words.hashes, K).view(np.int64)
                n = np.diff(words.doc_ptr)
                doc = words.doc_of[: len(h)]
                at = np.arange(len(h)) - words.doc_ptr[doc]
                inside = np.flatnonzero(at + K <= n[doc])
                doc, at, h = doc[inside], at[inside], h[inside]
                every = np.arange(len(n))
                nothing = np.zeros(len(n), np.int64)
                of = np.concatenate([every, doc])
                hit = np.flatnonzero(np.isin(h, known))
                said = np.zeros(len(of), np.int64)  # the first word list is that of the texts' own rows
                said[len(n) :] = -1
                said[len(n) + hit] = np.arange(1, len(hit) + 1)
                each = pa.array(["", *(gram_words(words, k) for k in inside[hit].tolist())], pa.string())
                pick = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pick), part.column(1).take(pick), pa.array(n[of]), pa.array(np.concatenate([nothing - 1, at])), pa.array(np.concatenate([nothing, h])), each.take(pa.array(said, mask=said < 0))],
                    ["key", "doc_id", "n_words", "at", "h", "words"],
                )

    return docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, doc_id long, n_words long, at long, h long, words string")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_base, first_word, last_word, base_labels, labels, score, for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    known = all_templates()
    rows = [(0, "", -1, -1), *template_rows()]
    table = spark.createDataFrame(rows, "h long, words string, template int, pos int")  # a fixed size: the templates above
    facts = spark.createDataFrame([(i, label, base, len(re.findall(r"[a-z0-9]+", text)) - K + 1) for i, (label, text, base) in enumerate(known)] + [(-1, "", False, 0)], "template int, label string, base boolean, grams int")
    votes = grams(docs).join(F.broadcast(table), ["h", "words"])  # by hash, then by the words themselves
    votes = votes.groupBy("key", "doc_id", "n_words", "template", (F.col("at") - F.col("pos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    votes = votes.join(F.broadcast(facts), "template")
    by = Window.partitionBy("key", "template").orderBy("diagonal", "first")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT, F.lit(True)) | F.col("base") | (F.col("template") < 0)
    # A diagonal of a longer template counts only with two votes or more, so that chance pairs do not bridge spans.
    spans = votes.where("base or template < 0 or votes >= least(2, grams)").withColumn("new", apart.cast("int"))
    spans = spans.withColumn("span", F.sum("new").over(upto))
    spans = spans.groupBy("key", "doc_id", "template", "label", "base", "grams", "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    close = F.col("last") - F.col("first") + 1 <= F.col("grams") + 2 * DRIFT
    share = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    whole = F.col("base") & (F.col("votes") == F.col("grams"))
    found = whole | (~F.col("base") & (F.col("template") >= 0) & close & (share >= COVERAGE))
    label = F.when(found, F.col("label"))
    out = spans.groupBy("key", "doc_id").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("first"))).alias("first_word"),
        F.max(F.when(whole, F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"),
        F.coalesce(F.max(F.when(whole, F.lit(1.0)).when(~F.col("base") & (F.col("template") >= 0) & close, share)), F.lit(0.0)).alias("score"),
    )
    return out.drop("key")
