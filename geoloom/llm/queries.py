"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lm_scoring, mixing, near_duplicates, oracles, pii, quality, sharding, url_filter
from .shared import fresh_folder
from .token_files import token_files
from .tokens import token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE, limit=512)


def op2_compact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.sharded(table(spark, sf_dir, "documents"), fresh_folder(spark, "shards"))
    name = F.element_at(F.split("shard", "/"), -1)
    return docs.select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("n_bytes"), name.alias("shard"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE, end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.production_mix(table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_contamination(docs, items, keep_text=False, without_id=True))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    scored = lm_scoring.scored(table(spark, sf_dir, "documents"), target)
    return scored.select("doc_id", "n_tokens", *(F.round(x, 6).alias(x) for x in ("target_loss", "background_loss", "difference")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.found(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_compact_shards, op3_quality_rules, op4_near_duplicates, op5_token_files, op6_mix_sources, op7_url_filter, op8_decontaminate, op9_cross_entropy_difference, op10_personal_data)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.oracle(),
        "op4_near_duplicates": oracles.near_duplicates(),
        "op7_url_filter": oracles.url_filter(),
        "op8_decontaminate": oracles.decontaminate(),
        "op9_cross_entropy_difference": oracles.cross_entropy_difference(),
    }
