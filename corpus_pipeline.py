"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, encoding.

Each stage is a function of (spark, docs, sf_dir); run() writes what a stage
returns as Parquet and reads it again as the next one's docs. All but the last
return the columns of documents.

Defined results: null and empty texts pass every stage that their quality
passes, and encode to no ids; very long texts are read whole; ties are those of
the stages' operators; rows that repeat a doc_id go or stay by their own texts;
empty tables give empty results of the same columns; further columns of
documents are carried to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridleaf.llm import bpe, common, lines, minhash, quality, tiling


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; documents have no URL, so the host is source and the path lang."""
    return quality.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), [F.col("source"), F.col("lang")])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines and passages that recur in documents of a smaller id; one of which no text is left goes."""
    aside = {c: f"own {c}" for c in docs.columns if c in lines.COUNTS}
    found = lines.dedup_lines(docs.withColumnsRenamed(aside))
    same = F.col("chars_after") == F.col("chars_before")
    kept = found.where((same & (F.col("n_dropped") == 0)) | F.col("text").rlike(r"\S"))
    n = F.when(same, F.col("n_chars")).otherwise(F.col("chars_after"))
    return kept.withColumn("n_chars", n).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether they decode to the text."""
    found = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"))
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", "exact")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level bpe", encoding_stage),
]

#: Stages are trained, hashed and iterated; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if name != STAGES[0][0]:
            common.dropped(before)
    return docs
