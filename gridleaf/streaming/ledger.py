"""Jobs that arrive as events: open ones are carried from batch to batch, closed ones are written once.

Each micro-batch reads the jobs that the batch before left open, and its own
events; nothing else of the past is read. It writes the jobs that it closes to
closed/ and those that it leaves open to open/, in folders of the batch, so a
repeated batch overwrites only its own. Open folders before the last two are
deleted, so what is kept is bounded by the open jobs. A new checkpoint goes on
from what the last one left open.

events: job, kind (prepared, submitted, progress, done or failed), at (timestamp), seq (number)
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import numbered
from ..operators.staging import staged

TERMINAL = ("done", "failed")
RESULT = ("job", "state", "opened", "last", "events")


def step(events: DataFrame, open_: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(closed jobs, open jobs) after the events: job, state, opened, last, events.
    A terminal event closes its job and the next event of that name opens another;
    one without an open job is of an unknown job. Events are sorted in ranges and
    jobs told apart by a running count of terminal events, so a job that has most
    of the events is no single task's."""
    rows = events.select("job", "kind", F.col("at").alias("opened"), F.col("at").alias("last"), F.lit(1).cast("bigint").alias("events"), F.lit(1).alias("new"), "seq")
    if open_ is not None:
        old = open_.select("job", F.col("state").alias("kind"), "opened", "last", "events", F.lit(0).alias("new"), F.lit(None).cast("bigint").alias("seq"))
        rows = old.unionByName(rows)
    closes = F.col("kind").isin(*TERMINAL)
    placed = numbered(rows, [F.col(c) for c in ("job", "new", "last", "seq", "kind")], number="range")
    # Closed before: in the ranges before (one number a range), and in the row's own range.
    sums = placed.groupBy("range").agg(F.count_if(closes).alias("n"))
    before = sums.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum(closes.cast("bigint")).over(W.partitionBy("range").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = placed.withColumn("within", within).join(F.broadcast(before), "range").withColumn("turn", F.col("before") + F.col("within"))
    jobs = told.groupBy("job", "turn").agg(
        F.min("opened").alias("opened"), F.max("last").alias("last"), F.sum("events").alias("events"), F.count_if(~closes).alias("__others"),
        F.max(F.when(closes, F.col("kind"))).alias("__end"), F.bool_or(F.col("kind") == "submitted").alias("__sent"),
    )
    ended = F.when(F.col("__others") == 0, "unknown").otherwise(F.col("__end"))
    state = F.when(F.col("__end").isNotNull(), ended).when(F.col("__sent"), "submitted").otherwise("prepared")
    out = staged(jobs.select("job", state.alias("state"), "opened", "last", "events"), "ledger")
    live = F.col("state").isin("prepared", "submitted")
    return out.where(~live), out.where(live)


class Ledger:
    """The folders of a stream's jobs."""

    def __init__(self, spark: SparkSession, path: str, checkpoint: str) -> None:
        self.spark, self.path, self.checkpoint = spark, path.rstrip("/"), checkpoint.rstrip("/")

    def _path(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _run(self) -> str:
        """The id that Spark gave the stream of this checkpoint."""
        return json.loads(self.spark.read.text(f"{self.checkpoint}/metadata").first()[0])["id"]

    def _folders(self) -> list[tuple[str, int, int]]:
        """(run, batch, time) of the complete open folders: two of each run at most."""
        at, files = self._path(f"{self.path}/open/run=*/batch=*/_SUCCESS")
        out = []
        for f in files.globStatus(at) or []:
            parts = PurePosixPath(f.getPath().toString()).parts
            out.append((parts[-3].partition("=")[2], int(parts[-2].partition("=")[2]), f.getModificationTime()))
        return out

    def _open(self, run: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/open/run={run}/batch={batch}")

    def batch(self, events: DataFrame, number: int) -> None:
        run, known = self._run(), self._folders()
        last = [(r, b) for r, b, _ in known if r == run and b < number] or [(r, b) for r, b, t in sorted(known, key=lambda x: x[2]) if r != run]
        before = self._open(*(max(last, key=lambda x: x[1]) if last[0][0] == run else last[-1])) if last else None
        closed, open_ = step(events, before)
        closed.write.mode("overwrite").parquet(f"{self.path}/closed/run={run}/batch={number}")
        open_.write.mode("overwrite").parquet(f"{self.path}/open/run={run}/batch={number}")
        for r, b, _ in known:
            if r != run or b < number - 1:
                at, files = self._path(f"{self.path}/open/run={r}/batch={b}")
                files.delete(at, True)

    def closed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/closed/run=*/batch=*").select(*RESULT)

    def pending(self) -> DataFrame:
        """The jobs that are open now."""
        run, number, _ = max(self._folders(), key=lambda x: (x[2], x[1]))
        return self._open(run, number).select(*RESULT)


def follow(events: DataFrame, path: str, checkpoint: str) -> tuple[StreamingQuery, Ledger]:
    """Runs until all events that have arrived are in the ledger at path."""
    ledger = Ledger(events.sparkSession, path, checkpoint)
    query = events.writeStream.foreachBatch(ledger.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, ledger
