"""Queries of the corpus operators over the test tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import conversations, decontaminate, filter_audit, langid, licenses, mixing, neardup, ogg, resample, secrets, sharding, toxicity, warc
from .common import documents, small_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_resample_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.represented(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_resample_quality, op2_mix_sources, op3_decontaminate, op4_ogg_media, op5_toxicity, op6_license_scan, op7_language_id, op8_shard_documents, op9_near_duplicates, op10_secret_scan, op11_filter_audit, op12_conversation_repair, op13_warc_archives)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.SQL, "op3_decontaminate": decontaminate.SQL, "op11_filter_audit": filter_audit.SQL, "op13_warc_archives": warc.SQL}
