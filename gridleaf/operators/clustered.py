"""Predictions that meet their source in order, so that each source is parsed once where its predictions are scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import bounded

#: Predictions of one source beyond which they are dealt over several tasks, each with a copy of the source.
ROWS = 256


#: Tasks for each core, so that a slow one does not hold up the rest.
WAVES = 4


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over tasks of equal shares, before Python reads what is made of each.
    A table of narrow rows lies in few row groups, each of which one task reads
    whole, so that without this a few tasks would parse all of its documents."""
    return rows.repartition(WAVES * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def clustered(predictions: DataFrame, sources: DataFrame, on: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Rows of both sides, each source (__source true) right before its
    predictions. A source's text is shuffled once for each task that scores it
    and never repeated beside its predictions. The sides share no column but on."""
    hot = predictions.groupBy(*on).agg(F.ceil(F.count("*") / rows).cast("int").alias("__parts")).where("__parts > 1")
    side = bounded(hot)
    parts = F.coalesce("__parts", F.lit(1))
    own = [c for c in predictions.columns if c not in on]
    theirs = [c for c in sources.columns if c not in on]
    a = predictions.join(side, list(on), "left").withColumn("__part", F.pmod(F.xxhash64(*own), parts).cast("int")).drop("__parts")
    b = sources.join(side, list(on), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    both = b.withColumn("__source", F.lit(True)).unionByName(a.withColumn("__source", F.lit(False)), allowMissingColumns=True)
    keys = [*on, "__part"]
    return dealt(both.select(*keys, "__source", *theirs, *own), *keys).sortWithinPartitions(*keys, F.col("__source").desc())


def scored(batches: Iterator[pa.RecordBatch], on: Sequence[str], theirs: Sequence[str], out: pa.Schema, score: Callable[[dict[str, Any], dict[str, Any]], dict[str, Any]]) -> Iterator[pa.RecordBatch]:
    """What score makes of each prediction and its source, over rows that clustered() put in order.
    Predictions without a source give nothing; of sources that repeat a key the first counts."""
    source, at = {}, None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            key = [row[k] for k in (*on, "__part")]
            if row["__source"]:
                if key != at:
                    source, at = {k: row[k] for k in theirs}, key
            elif key == at:
                found.append(score(row, source))
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=out)
