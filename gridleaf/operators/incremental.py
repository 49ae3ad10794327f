"""Fingerprints, reuse and work planning as joins with an action column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coverage import first_by


def fingerprint(content: Column) -> Column:
    return F.sha1(content)


def reuse(current: DataFrame, details: DataFrame, keys: Sequence[str], marks: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of details that are still valid, rows of current to compute)."""
    same = [*keys, *marks]
    return details.join(current.select(*same), same, "left_semi"), current.join(details.select(*same), same, "left_anti")


def changed(old_mtime: Column, old_size: Column, old_sha: Column, mtime: Column, size: Column, sha: Column) -> Column:
    """Equal time and size: unchanged; else by hash; without an old hash by time."""
    return F.when(old_mtime.isNull(), True).when((old_mtime == mtime) & (old_size == size), False).when(old_sha.isNotNull(), old_sha != sha).otherwise(old_mtime != mtime)


def actions(inputs: DataFrame, outputs: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """process, refresh or skip for each input; orphan for outputs without input."""
    rows = inputs.join(outputs, list(keys), "full").join(state, list(keys), "left")
    what = (
        F.when(F.col("in_mtime").isNull(), "orphan")
        .when(F.col("out_mtime").isNull(), "process")
        .when(F.col("state_mtime") == F.col("in_mtime"), "skip")
        .when(F.col("out_mtime") >= F.col("in_mtime"), "refresh")
        .otherwise("process")
    )
    return rows.select(*keys, what.alias("action"))


def pending(jobs: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs without a prediction that has a response."""
    return jobs.join(predictions.where("status = 'ready'").select(*keys), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_by(both, keys, [F.col("__new").desc()]).drop("__new")


def should_render(output_mtime: Column, source_mtime: Column, script_mtime: Column, mode: str = "check") -> Column:
    """Whether an image is to be rendered: always under force; a missing one
    always; under missing-only no other; else one older than its source or the script."""
    if mode == "force":
        return F.lit(True)
    old = F.lit(False) if mode == "missing-only" else output_mtime < F.greatest(source_mtime, script_mtime)
    return output_mtime.isNull() | old


def render_source(html: Column, placeholder_html: Column) -> Column:
    """What an empty form is rendered from: struct(html, strip); an empty template falls back to the marked form, whose marks are stripped."""
    fall = (html == "") & (F.coalesce(placeholder_html, F.lit("")) != "")
    return F.struct(F.when(fall, placeholder_html).otherwise(html).alias("html"), fall.alias("strip"))


def migrated(states: DataFrame, keys: Sequence[str] = ("lang", "sample_id")) -> DataFrame:
    """State records where they belong: those of the old place count only where
    the new one has none (place: 'cache' or 'legacy')."""
    first = F.when(F.col("place") == "cache", 0).otherwise(1)
    out = first_by(states.withColumn("__first", first), keys, [F.col("__first")])
    return out.withColumn("moved", F.col("__first") == 1).withColumn("place", F.lit("cache")).drop("__first")
