"""The queries of this subpackage and their SQL: one op<N>_<name> for each operator, and the pipeline."""

from __future__ import annotations

from evenkeel.llm import chat_format, decontamination, fingerprints, jaccard_join, license_scan, line_dedup, packing, toxicity, url_filter, warc
from evenkeel.llm.common import table


def op1_decontamination(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


def op6_chat_format(spark, sf_dir):
    return chat_format.report(table(spark, sf_dir, "conversations"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.classify(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark, sf_dir):
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    return url_filter.report(table(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_chat_format": op6_chat_format,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "pipeline": pipeline,
}
#: The other operators are beyond SQL (trained models, diagonal votes, sketches, packings); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination.REPORT_SQL,
    "op2_line_dedup": line_dedup.REPORT_SQL,
    "op7_jaccard_join": jaccard_join.REPORT_SQL,
    "op5_warc": warc.REPORT_SQL,
    "op6_chat_format": chat_format.REPORT_SQL,
    "op10_url_filter": url_filter.REPORT_SQL,
}
