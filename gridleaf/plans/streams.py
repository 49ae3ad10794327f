"""Streams over the driver's tables, which run until all that is there has arrived."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_dir
from ..streaming import ledger
from .registry import ORACLE_SQL, QUERIES

KINDS = {"signup": "prepared", "click": "submitted", "view": "progress", "purchase": "done", "error": "failed"}


def job_events(rows: DataFrame) -> DataFrame:
    """A job for each user, which event types prepare, send, move on and end."""
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("event_type")]
    return rows.select(F.col("user_id").alias("job"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all jobs after a stream of events: closed ones, unknown ones, and those still open."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, as a stream's path is a folder or a pattern of files.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    query, found = ledger.follow(job_events(events), path, f"{path}/checkpoint")
    query.awaitTermination()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return found.closed().unionByName(found.pending()).select("job", "state", text("opened"), text("last"), "events")


QUERIES["job_ledger"] = job_ledger
ORACLE_SQL["job_ledger"] = """
WITH k AS (SELECT user_id AS job, ts, event_id, CASE event_type WHEN 'signup' THEN 'prepared' WHEN 'click' THEN 'submitted' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS kind FROM events),
t AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('done', 'failed') THEN 1 END) OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM k)
SELECT job, CASE WHEN count(*) FILTER (kind NOT IN ('done', 'failed')) = 0 THEN 'unknown' WHEN count(*) FILTER (kind IN ('done', 'failed')) > 0 THEN max(kind) FILTER (kind IN ('done', 'failed'))
  WHEN count(*) FILTER (kind = 'submitted') > 0 THEN 'submitted' ELSE 'prepared' END AS state, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS opened, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS events FROM t GROUP BY job, turn"""
