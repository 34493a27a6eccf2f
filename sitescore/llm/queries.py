"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam_prefix, filter_audit, html_pagediff, langid_subword, line_dedup, mix_flow, pii_feistel, quality_cascade, simhash_anchors, token_separator, toxicity_segments, warc_source, whitening
from .common import table


def op1_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_anchors.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity_segments.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op3_html_pagediff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_pagediff.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_langid_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_subword.identify(table(spark, sf_dir, "documents"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymised(table(spark, sf_dir, "documents"))


def op7_mix_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_flow.mix(table(spark, sf_dir, "documents")).drop("pattern")


def op8_decontam_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam_prefix.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_token_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_separator.token_counts(table(spark, sf_dir, "documents"))


def op10_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_source.archived(table(spark, sf_dir, "pages")).drop("target_uri")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_anchors,
        op2_toxicity_segments,
        op3_html_pagediff,
        op4_langid_subword,
        op5_quality_cascade,
        op6_pii_feistel,
        op7_mix_flow,
        op8_decontam_prefix,
        op9_token_separator,
        op10_warc_source,
        op11_filter_audit,
        op12_line_dedup,
        op13_whitening,
    )
}
ORACLE_SQL: dict[str, str] = {"op5_quality_cascade": quality_cascade.SQL, "op8_decontam_prefix": decontam_prefix.SQL, "op10_warc_source": warc_source.SQL, "op11_filter_audit": filter_audit.SQL, "op12_line_dedup": line_dedup.SQL}
