"""The corpus pipeline: five stages over ``documents``, each one of the operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents; the last adds the shard of each document.  Rows that a
stage keeps reach the next one whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import decontaminate, mixing, near_duplicates, quality, sharding
from geoloom.llm.shared import drop_written, fresh_folder, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base and the production rules keep.

    Null and empty texts, and those of under 50 words, go; ids aren't read, and a
    row that repeats another is judged like it.
    """
    return quality.kept_documents(docs)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near copies.

    Rows without an id stay; of rows that repeat an id one stays.
    """
    return near_duplicates.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of any benchmark item occurs; items need no id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.decontaminated(docs, items, without_id=True)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the targets of source, language and topic; null values count as "unknown"."""
    return mixing.sampled_documents(docs)


def shard_compaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, and the shard of a compacted store in which each lies."""
    return sharding.sharded(docs, fresh_folder(spark, "corpus"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("decontaminate", benchmark_decontamination),
    ("mix_sources", source_mix),
    ("compact_shards", shard_compaction),
]

#: Near duplicates and the raking of weights are iterative, so no single SQL query gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    result = STAGES[-1][1](spark, docs, sf_dir)  # reads the shards alone
    drop_written(docs)
    return result
