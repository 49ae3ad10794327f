"""The ledger of jobs over several batches, restarts and repeats, against one batch over all events."""

import datetime
import os
import random

from pyspark.sql import functions as F

from gridleaf.streaming import ledger
from gridleaf.streaming import predictions as P

SCHEMA = "job string, kind string, at timestamp, seq long"


def made(n, jobs=9, hot=0.4):
    rng = random.Random(n)
    start = datetime.datetime(2024, 1, 1)
    kinds = ["prepared", "submitted", "progress", "done", "failed"]
    return [("hot" if rng.random() < hot else f"j{rng.randrange(jobs)}", rng.choice(kinds), start + datetime.timedelta(seconds=i // 3), i) for i in range(n)]


def plain(events):
    open_, out = {}, []
    for job, kind, at, _ in sorted(events, key=lambda e: (e[2], e[3])):
        now = open_.setdefault(job, ["prepared", at, at, 0])
        now[2], now[3] = at, now[3] + 1
        if kind in ledger.TERMINAL:
            out.append((job, "unknown" if now[3] == 1 else kind, *now[1:]))
            del open_[job]
        elif kind == "submitted":
            now[0] = kind
    return sorted(out), sorted((j, *v) for j, v in open_.items())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_one_step(spark):
    events = made(800)
    closed, open_ = ledger.step(spark.createDataFrame(events, SCHEMA).repartition(5))
    assert (rows(closed), rows(open_)) == plain(events)
    closed, open_ = ledger.step(spark.createDataFrame([], SCHEMA))
    assert rows(closed) == rows(open_) == []


def test_batches_restarts_and_new_checkpoints(spark, tmp_path):
    events, arriving = made(900), tmp_path / "in"
    out, at = str(tmp_path / "out"), 0
    for part, checkpoint in ((200, "a"), (1, "a"), (299, "a"), (200, "b"), (200, "b")):
        for chunk in (events[at : at + part // 2], events[at + part // 2 : at + part]):
            if chunk:
                spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(str(arriving / checkpoint))
        at += part
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(arriving / checkpoint))
        query, found = ledger.follow(stream, out, str(tmp_path / f"ck-{checkpoint}"))
        query.awaitTermination()
        assert rows(found.pending()) == plain(events[:at])[1]
    assert rows(found.closed()) == plain(events)[0]
    kept = [b for r in os.listdir(f"{out}/open") for b in os.listdir(f"{out}/open/{r}")]
    assert len(kept) <= 2  # what is open, whatever has passed


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    events = made(300)
    book = ledger.Ledger(spark, str(tmp_path / "out"), "")
    monkeypatch.setattr(book, "_run", lambda: "r")
    for number, part in enumerate((events[:150], events[150:])):
        df = spark.createDataFrame(part, SCHEMA)
        for _ in range(2):
            book.batch(df, number)
    assert (rows(book.closed()), rows(book.pending())) == plain(events)


def test_predictions_are_known_without_reading_the_past(spark, tmp_path):
    """A prediction that comes again in a later batch is not scored again, one that changed is."""
    at = str(tmp_path / "in")
    for said in ("a", "a", "b"):
        spark.createDataFrame([("infill", "empty", "en", "m", 1, said)], P.SCHEMA).coalesce(1).write.mode("append").json(at)
        P.score_stream(P.arriving(spark, at), lambda df: df.withColumn("score", F.lit(1.0)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.raw_response for r in spark.read.parquet(str(tmp_path / "out")).orderBy("raw_response").collect()] == ["a", "b"]
    assert os.path.isdir(tmp_path / "ck" / "state")
