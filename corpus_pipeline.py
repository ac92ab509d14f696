"""Corpus pipeline: documents through the training-data operators, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet in
the shared checkpoint folder, the next stage reads it again, and what is no longer needed is
deleted.  All stages but the last return the
columns of ``documents``.

Defined results (each from its operator): null and empty texts fail the base quality rules; repeated
rows are copies of each other, so one stays; a null id or source is a value like any other; an empty
table passes through as an empty table; extra columns are carried through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinterra.llm import decontaminate, jaccard_join, mixing, quality_rules, resharding
from vinterra.llm.common import drop_scratch, scratch_mark, written
from vinterra.llm.queries import NEW_SHARDS, OLD_SHARDS
from vinterra.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest id."""
    return jaccard_join.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark window."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order: source blocks interleaved to their target weights."""
    return mixing.interleave(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard files of the result, and where each document went.

    ``docs`` is the written table of the stage before: the slots of each shard follow its order.
    """
    layout = resharding.reshard(docs, F.xxhash64("source"), OLD_SHARDS, NEW_SHARDS, order=mixing.stored_order())
    return resharding.layout_digest(layout)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("source mixing", mix),
    ("sharding", shard),
]

#: The earliest-deadline-first schedule and the minimum-cost flow have no SQL form; the tests compare
#: every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        drop_scratch(spark, mark, keep=docs)  # the stage's helper tables and the input it has used up
    return docs
