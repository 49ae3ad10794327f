"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, media, minhash, pii, preferences, quality, resampling, secrets, spelling, tiling, toxicity, warc
from .common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=2)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(documents(spark, sf_dir))


def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preference_pairs(_table(spark, sf_dir, "conversations"))


def quality_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judged(docs, _table(spark, sf_dir, "labels"), [F.col("source"), F.col("lang")], ["doc_id"])


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": near_dedup,
    "op2_secret_scans": secret_scan,
    "op3_media_columns": media_columns,
    "op4_benchmark_decontamination": decontamination,
    "op5_toxicity": toxic,
    "op6_byte_bpe": byte_bpe,
    "op7_line_dedup": line_dedup,
    "op8_personal_data": personal_data,
    "op9_preference_formatting": preference_format,
    "op10_quality_classifier": quality_classes,
    "op11_spelling_variants": spelling_variants,
    "op12_importance_resampling": importance_resampling,
    "op13_warc": warc_records,
}

ORACLE_SQL: dict[str, str] = {
    "op9_preference_formatting": preferences.ORACLE_SQL,
    "op11_spelling_variants": spelling.ORACLE_SQL,
    "op12_importance_resampling": resampling.ORACLE_SQL,
    "op13_warc": warc.ORACLE_SQL,
}
