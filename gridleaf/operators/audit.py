"""Audits of metrics and of published results."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as X
from ..functions.text import arrow
from . import aggregates as A
from .clustered import clustered, scored

# The columns of an audit, in order.
COUNTS = (
    "legacy_correct",
    "legacy_total",
    "hardened_correct",
    "hardened_total",
    "legacy_reverse_substring_correct",
    "legacy_reverse_single_char_correct",
    "legacy_reverse_short_fragment_correct",
    "legacy_reverse_in_multi_value_cell",
    "hardened_multi_value_correct",
    "hardened_multi_value_total",
    "hardened_reorder_candidates",
    "hardened_control_mismatches",
)
REVERSE = "array<struct<row: int, col: int, idx: int, gold: string, prediction: string, multi: boolean>>"


def prediction_audit(p: str | None, g: str | None, b: str | None) -> dict[str, Any]:
    """Both matchers' counts of one prediction, what the first accepts as part of
    the gold text, and what of the second only differs in order; an unreadable
    prediction is an empty text."""
    old, new = scoring.legacy(p or "", g, b), scoring.source_faithful(p or "", g, b, "all_logical_regions")
    many = {(t["row"], t["col"]) for t in new if t["markers"] > 1}
    part = [t for t in old if t["kind"] == "prediction_in_gold"]
    multi = [t for t in new if t["markers"] > 1]
    reverse = [{"row": t["row"], "col": t["col"], "idx": t["idx"], "gold": t["want"], "prediction": t["got"], "multi": (t["row"], t["col"]) in many} for t in part]
    values = (
        sum(t["correct"] for t in old), len(old), sum(t["correct"] for t in new), len(new), len(part), sum(len(t["got"]) == 1 for t in part),
        sum(0 < len(t["got"]) <= 3 for t in part), sum(r["multi"] for r in reverse), sum(t["correct"] for t in multi), len(multi),
        sum(scoring.reordered(t) for t in multi), sum(t["kind"] == "control_mismatch" for t in new),
    )
    return {**dict(zip(COUNTS, values, strict=True)), "reverse": reverse}


SOURCE_COUNTS = (
    "visible_placeholder_occurrences",
    "legacy_targets",
    "legacy_unique_cells",
    "legacy_slot_collision_occurrences",
    "legacy_slot_collision_cells",
    "legacy_empty_gold_slots",
    "hardened_evaluable_cells",
    "hardened_marker_occurrences",
    "hardened_multi_value_cells",
    "hardened_text_cells",
    "hardened_control_cells",
    "hardened_control_targets",
)


@arrow(f"struct<{', '.join(f'{c}: int' for c in SOURCE_COUNTS)}>")
def source_counts(gold: pd.Series, blank: pd.Series) -> pd.DataFrame:
    """What a sample's marked form and its filled form give both matchers to score."""
    rows = []
    for g, b in zip(gold, blank, strict=True):
        slots = Counter(scoring.legacy_slots(b))
        old, new = scoring.legacy("", g, b), scoring.source_faithful("", g, b, "all_logical_regions")
        more = {s[:2] for s, n in slots.items() if n > 1}
        rows.append((
            slots.total(), len(old), len({(t["row"], t["col"]) for t in old}), slots.total() - len(slots), len(more), max(0, len(slots) - len(old)),
            len(new), sum(t["markers"] for t in new), sum(t["markers"] > 1 for t in new), sum(t["text"] for t in new), sum(t["controls"] > 0 for t in new), sum(t["controls"] for t in new),
        ))
    return pd.DataFrame(rows, columns=SOURCE_COUNTS)


def source_inventory(sources: DataFrame, keys: Sequence[str] = ("lang", "sample_id")) -> DataFrame:
    """keys and the counts of each sample (sources: keys, html_filled, placeholder_html)."""
    return sources.select(*keys, source_counts("html_filled", "placeholder_html").alias("c")).select(*keys, "c.*")


def audited(predictions: DataFrame, sources: DataFrame, keys: Sequence[str] = ("model", "condition", "lang", "sample_id")) -> DataFrame:
    """keys, the counts of each infill prediction, both scores, their difference
    in points and the reverse matches (predictions: keys, html; sources: lang,
    sample_id, html_filled, placeholder_html)."""
    on, theirs = ("lang", "sample_id"), ("html_filled", "placeholder_html")
    rows = clustered(predictions.where("task = 'infill'").select(*keys, "html"), sources.select(*on, *theirs), on)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} int" for c in COUNTS), f"reverse {REVERSE}"])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def score(row: dict[str, Any], source: dict[str, Any]) -> dict[str, Any]:
            return {**{k: row[k] for k in keys}, **prediction_audit(row["html"], source["html_filled"], source["placeholder_html"])}

        yield from scored(batches, on, theirs, out, score)

    a = rows.mapInArrow(run, schema)
    old, new = (X.ratio(F.col(f"{s}_correct"), F.col(f"{s}_total")) for s in ("legacy", "hardened"))
    return a.select(*keys, *COUNTS, old.alias("legacy_score"), new.alias("hardened_score"), F.round(100 * (new - old), 6).alias("score_delta_pp"), "reverse")


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def column_sums(rows: DataFrame, keys: Sequence[str], sums: Sequence[str] = COUNTS) -> DataFrame:
    """Sums of the counts by keys and language, and over both, with the pooled scores."""
    out = A.with_both(rows, keys, sums)
    return out.withColumns({f"{s}_score": X.ratio(F.col(f"{s}_correct"), F.col(f"{s}_total")) for s in ("legacy", "hardened") if f"{s}_correct" in sums})


def reconstructed(summaries: DataFrame, langs: Sequence[str] = ("en", "zh")) -> DataFrame:
    """task, measure (filled, empty, delta), value: languages pooled by counts for
    each model and condition, then a mean over models."""
    has = lambda c, x: F.sum(F.when(F.col("condition") == c, F.col(x)))
    pooled = summaries.where(F.col("lang").isin(*langs)).groupBy("task", "model").agg(*((has(c, "correct") / has(c, "total")).alias(c) for c in ("filled", "empty")))
    pooled = pooled.withColumn("delta", F.col("empty") - F.col("filled"))
    means = pooled.groupBy("task").agg(*(F.avg(c).alias(c) for c in ("filled", "empty", "delta")))
    return means.unpivot("task", ["filled", "empty", "delta"], "measure", "value")


def published(rows: DataFrame, columns: dict[str, str], label: str = "Task Average") -> DataFrame:
    """task, measure, percent of the row of that label in a published table of
    texts; columns gives each task's prefix, its measures being _filled, _templ and _diff."""
    parts = {"filled": "filled", "empty": "templ", "delta": "diff"}
    cells = [F.struct(F.lit(task).alias("task"), F.lit(m).alias("measure"), X.parse_percent(F.col(f"{p}_{c}")).alias("percent")) for task, p in columns.items() for m, c in parts.items()]
    return rows.where(F.col("model") == label).limit(1).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def compared(found: DataFrame, expected: DataFrame) -> DataFrame:
    """task, measure, found_percent, percent and whether they agree at one
    decimal; the value is rounded as printed, half to even of the binary value."""
    both = found.join(expected, ["task", "measure"]).withColumn("found_percent", F.col("value") * 100)
    shown = X.percent(F.col("value"))
    return both.select("task", "measure", "found_percent", "percent", (X.parse_percent(shown) == F.col("percent")).alias("matches"))


def summary_for(wanted: DataFrame, summaries: DataFrame) -> DataFrame:
    """wanted (task, condition, lang, model, metric) with its summary's score,
    samples, correct and total; the metric tells only summaries of schema apart."""
    metric = lambda d: d.withColumn("__m", F.when(F.col("task") == "schema", F.col("metric")).otherwise(""))
    keys = ["task", "condition", "lang", "model", "__m"]
    side = metric(summaries).select(*keys, "score", "samples", "correct", "total")
    return metric(wanted).join(side, keys, "left").drop("__m")


def subset_scores(details: DataFrame, chosen: DataFrame, tasks: Sequence[str] = ("schema", "alignment", "infill")) -> DataFrame:
    """The result table over chosen samples (lang, sample_id) only: mean score
    for schema, pooled counts for the others, and the row of averages."""
    some = details.join(chosen.select("lang", "sample_id").distinct(), ["lang", "sample_id"], "left_semi")
    sums = some.groupBy("model", "task", "condition").agg(F.avg("score").alias("mean"), F.sum("correct").alias("c"), F.sum("total").alias("t"))
    score = F.when(F.col("task") == "schema", F.col("mean")).otherwise(A.share(F.col("c"), F.col("t")))
    return A.matrix(sums.select("model", "task", "condition", score.alias("score")), tasks=tasks)


def global_drop(table: DataFrame, tasks: Sequence[str] = ("schema", "alignment", "infill"), average: str = "Task Average") -> DataFrame:
    """One row: the mean of the average row's differences over the tasks that have one."""
    values = F.filter(F.array(*(F.col(f"{t}_diff") for t in tasks)), lambda x: x.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return table.where(F.col("model") == average).select(F.when(F.size(values) > 0, mean).alias("global_drop"))


def without_references(scores: DataFrame, references: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(scores that averages count, scores of reference models, which are shown below them)."""
    is_reference = F.col("model").isin(*references) if references else F.lit(False)
    return scores.where(~is_reference), scores.where(is_reference)


def build_stats(samples: DataFrame) -> DataFrame:
    """By task and language: samples built, skipped and warned of, and passed self checks (samples: task, lang, status, warning, self_check)."""
    return samples.groupBy("task", "lang").agg(F.count_if(F.col("status") == "ok").alias("built"), F.count_if(F.col("status") != "ok").alias("skipped"), F.count_if(F.col("warning").isNotNull()).alias("warnings"), F.count_if(F.col("self_check")).alias("checks_passed"), F.count_if(~F.col("self_check")).alias("checks_failed"))


def image_groups(images: DataFrame, keys: Sequence[str] = ("lang", "condition")) -> DataFrame:
    """Images, failures and the ranges of width and height of each group."""
    return images.groupBy(*keys).agg(F.count("*").alias("images"), F.count_if(~F.col("ok")).alias("failed"), *(f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))))


def metric_errors(pairs: DataFrame, a: Column, b: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs, mean and greatest absolute difference of two implementations of a metric."""
    error = F.abs(a - b)
    return pairs.groupBy(*keys).agg(F.count(error).alias("pairs"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))


def dataset_shares(levels: DataFrame) -> DataFrame:
    """levels (lang, level, tables, si, gi, so, go, li) with each row's share of
    the language's tables and cells, and each kind's share of the row's cells, in percent."""
    kinds = ["si", "gi", "so", "go", "li"]
    cells = sum((F.col(k) for k in kinds), F.lit(0))
    rows = levels.withColumn("cells", cells)
    all_ = rows.groupBy("lang").agg(F.sum("tables").alias("__t"), F.sum("cells").alias("__c"))
    both = rows.join(all_, "lang")
    share = lambda x, y: F.round(F.when(y > 0, 100 * x / y).otherwise(0.0), 6)
    return both.select("lang", "level", "tables", "cells", share(F.col("tables"), F.col("__t")).alias("tables_pct"), share(F.col("cells"), F.col("__c")).alias("cells_pct"), *(share(F.col(k), F.col("cells")).alias(f"{k}_pct") for k in kinds))
