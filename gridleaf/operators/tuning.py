"""Base-versus-tuned comparison, its cache and inventory checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .coverage import first_by
from .ordered import bounded, numbered

#: What a cached detail must agree in, and the versions of its form.
COMPARED = ("cache_version", "cache_key", "schema_metric", "active_prediction_sha1", "paired_prediction_sha1", "source_fingerprint")
VERSION, INFILL_VERSION = "table4_detail_v1", "table4_detail_v2_infill"


def base_vs_tuned(base: DataFrame, tuned: DataFrame, keys: Sequence[str] = ("sample_id", "task", "model"), average: str = "Average") -> DataFrame:
    """Scores of each task over the samples that both sides have (the mean
    similarity of schema where rows have one, else counts), the mean over a
    model's tasks, their difference, and a row of averages."""
    value = lambda d: F.when(F.col("task") == "schema", F.col("score")) if "score" in d.columns else F.lit(None).cast("double")
    side = lambda d, p: d.select(*keys, F.col("correct").alias(f"{p}c"), F.col("total").alias(f"{p}t"), value(d).alias(f"{p}s"))
    both = side(base, "b").join(side(tuned, "t"), list(keys))
    score = lambda p: F.coalesce(F.avg(f"{p}s"), F.sum(f"{p}c") / F.nullif(F.sum(f"{p}t"), F.lit(0)))
    by_task = both.groupBy("model", "task").agg(score("b").alias("base"), score("t").alias("tuned"), F.count("*").alias("samples"))
    rows = by_task.groupBy("model").agg(F.avg("base").alias("base"), F.avg("tuned").alias("tuned"), F.sum("samples").alias("samples"))
    total = rows.agg(F.lit(average).alias("model"), F.avg("base").alias("base"), F.avg("tuned").alias("tuned"), F.sum("samples").alias("samples"))
    return rows.unionByName(total).withColumn("delta", F.col("tuned") - F.col("base"))


def discovered(dirs: DataFrame) -> DataFrame:
    """Distinct names of the models that have prediction folders (name)."""
    return dirs.select(X.tuned_name(F.col("name")).alias("model")).distinct()


def model_pairs(tuned: DataFrame, bases: DataFrame, with_qa: bool = False) -> DataFrame:
    """Tuned models (ft_model) with their base model, whose name or folder name
    is left of theirs, in order: by the base's rank, then method, then name
    (bases: base_model, rank; of bases of one folder name the first in order
    counts). Models without a known base are left out, as are QA variants unless
    asked for."""
    name = F.col("ft_model")
    rows = tuned.select(name, X.tuned_base(name).alias("__name"), X.tuning_method(name).alias("comparison_method"))
    names = bases.select("base_model", "rank", F.explode(F.array_distinct(F.array(F.col("base_model"), X.model_dir(F.col("base_model"))))).alias("__name"))
    side = names.groupBy("__name").agg(F.min(F.struct("rank", "base_model")).alias("b")).select("__name", "b.*")
    out = rows.join(bounded(side), "__name")
    if not with_qa:
        out = out.where("comparison_method <> 'QA'")
    place = F.struct("rank", "base_model", F.when(F.col("comparison_method") == "FT", 0).otherwise(1).alias("m"), "ft_model")
    return out.select("ft_model", "base_model", "comparison_method", place.alias("place"))


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of each key's tuned models (ft_model, comparison_method) the one of the highest version, later ones first."""
    version = X.tuned_version(F.col("ft_model"), F.col("comparison_method"))
    return first_by(rows, [*keys, "comparison_method"], [version.desc(), F.col(order).desc()])


def resolved_dirs(records: DataFrame, files: DataFrame, model: Column) -> DataFrame:
    """records (task, condition, lang, sample_id, ...) with the folder of the
    model's prediction: the one of just the model's folder name if the sample's
    file is in it, else the first folder in order whose name has the same form,
    else that folder name itself (files: task, condition, lang, name, sample_id)."""
    keys = ["task", "condition", "lang"]
    wanted = records.withColumns({"__dir": X.model_dir(model), "__name": X.tuned_name(model)})
    own = files.select(*keys, "sample_id", F.col("name").alias("__dir"), F.lit(True).alias("__there")).distinct()
    first = files.groupBy(*keys, X.tuned_name(F.col("name")).alias("__name")).agg(F.min("name").alias("__first"))
    out = wanted.join(own, [*keys, "sample_id", "__dir"], "left").join(first, [*keys, "__name"], "left")
    return out.withColumn("dir", F.when(F.col("__there"), F.col("__dir")).otherwise(F.coalesce("__first", "__dir"))).drop("__dir", "__name", "__there", "__first")


def fingerprint(path: Column, content: Column) -> Column:
    """path, size and digest of a file as one text; a missing file says so."""
    return F.when(content.isNull(), F.concat(path, F.lit(":missing"))).otherwise(F.concat_ws(":", path, F.length(content).cast("string"), F.sha1(content)))


def cache_record(rows: DataFrame, metric: str, matcher: str) -> DataFrame:
    """rows with the columns that tell whether a cached detail is current (rows:
    base_model, ft_model, method, task, lang, sample_id, active, paired (bytes of
    both predictions), sources: array of struct(path, content) in order)."""
    infill = F.col("task") == "infill"
    key = F.concat_ws("::", "base_model", "ft_model", "method", "task", F.lit("empty"), "lang", F.col("sample_id").cast("string"), F.lit(metric), F.when(infill, F.lit(matcher)))
    sha = lambda c: F.when(F.col(c).isNull(), "missing").otherwise(F.sha1(c))
    return rows.withColumns({
        "cache_version": F.when(infill, INFILL_VERSION).otherwise(VERSION),
        "cache_key": key,
        "schema_metric": F.lit(metric),
        "active_prediction_sha1": sha("active"),
        "paired_prediction_sha1": sha("paired"),
        "source_fingerprint": F.array_join(F.transform("sources", lambda x: fingerprint(x["path"], x["content"])), "|"),
    })


def reused(current: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cached details that are current, rows to compute, counts of both by method)."""
    keep = cached.join(current.select(*COMPARED).distinct(), list(COMPARED), "left_semi")
    todo = current.join(cached.select(*COMPARED).distinct(), list(COMPARED), "left_anti")
    n = lambda d, c: d.groupBy("method").agg(F.count("*").alias(c))
    counts = n(keep, "reused").join(n(todo, "computed"), "method", "full")
    return keep, todo, counts.select("method", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("reused", "computed")))


def positions(df: DataFrame, order: str) -> DataFrame:
    """df with each row's place in the order of a column, then of all columns."""
    return numbered(df, [F.col(order), *(F.col(c) for c in df.columns if c != order)])


def zipped(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Rows of a with the row of b at the same place, b's columns as other_*."""
    right = positions(b, order).select("place", *(F.col(c).alias(f"other_{c}") for c in b.columns))
    return positions(a, order).join(right, "place", "left").drop("place")


def inventory(rows: DataFrame, identity: Sequence[str], required: Sequence[str]) -> DataFrame:
    """For each identity whether it repeats and whether a required value is missing."""
    lacks = F.exists(F.array(*required), lambda x: F.coalesce(x, F.lit("")) == "")
    return rows.groupBy(*identity).agg((F.count("*") > 1).alias("repeated"), F.bool_or(lacks).alias("incomplete"))
