"""Registered queries of the training-data operators: whole tables, production parameters.

``queries()`` and ``oracles()`` are added to the driver's lists by ``__spark_entry__``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinterra.llm import (
    decontaminate,
    filter_audit,
    jaccard_join,
    license_scan,
    line_spread,
    merkle,
    mixing,
    quality_rules,
    resharding,
    super_minhash,
    token_lengths,
    warc,
    window_dedup,
)
from vinterra.sources.tables import table

#: The layout that ``op6`` starts from: documents filed by source into this many shards.
OLD_SHARDS = 12
NEW_SHARDS = 16


def op1_bayes_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(table(spark, sf_dir, "documents"))


def op2_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.captures(warc.read_warc(spark, archives, with_payload=False))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op5_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    layout = resharding.reshard(docs.select("doc_id", "text", "source"), F.xxhash64("source"), OLD_SHARDS, NEW_SHARDS)
    return resharding.layout_digest(layout)


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_lengths.encoded_lengths(table(spark, sf_dir, "documents"))
    return token_lengths.suffix_sums(token_lengths.histogram(lengths))


def op8_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_boilerplate(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op9_rolling_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = window_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, audited against a table in which some ``n_chars`` have grown by one."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    grown = F.col("n_chars").cast("decimal(20,0)") + 1
    return merkle.audit(merkle.manifest(table(spark, sf_dir, "documents"), found={"n_chars": grown}, where_found=tampered))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bayes_jaccard_join": op1_bayes_jaccard_join,
    "op2_adaptive_quality": op2_adaptive_quality,
    "op3_warc_salvage": op3_warc_salvage,
    "op4_pfair_mixing": op4_pfair_mixing,
    "op5_license_dice": op5_license_dice,
    "op6_flow_resharding": op6_flow_resharding,
    "op7_length_histogram": op7_length_histogram,
    "op8_line_site_spread": op8_line_site_spread,
    "op9_rolling_window_dedup": op9_rolling_window_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_super_minhash": op12_super_minhash,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_bayes_jaccard_join": jaccard_join.ORACLE,
    "op2_adaptive_quality": quality_rules.ORACLE,
    "op3_warc_salvage": warc.ORACLE,
    "op5_license_dice": license_scan.oracle(),
    "op8_line_site_spread": line_spread.ORACLE,
    "op9_rolling_window_dedup": window_dedup.ORACLE,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
    "op11_filter_interactions": filter_audit.ORACLE,
    "op12_super_minhash": super_minhash.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
