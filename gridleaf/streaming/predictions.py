"""Predictions that arrive over time: each new file is scored once.

The stream is a file source. That a prediction of the same key and digest has
been seen is state of the stream itself, kept by key in its checkpoint, so no
batch reads the past. A batch's new predictions are handed to a scorer, whose
details are written to a folder of the batch: a repeated batch overwrites its
own output only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "task string, condition string, lang string, model string, sample_id int, raw_response string"

def arriving(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def score_stream(rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs until all that has arrived is scored."""
    keys = ("task", "condition", "lang", "model", "sample_id")
    once = rows.withColumn("sha1", F.sha1(F.coalesce("raw_response", F.lit("")))).dropDuplicates([*keys, "sha1"])

    def batch(df: DataFrame, number: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
