"""The prepared-evaluation workflow: eligibility, manifests, job sets, versions, coverage.

sources: lang, sample_id, html_empty, html_filled, json_empty, json_filled, meta,
placeholder_html, context (texts; null where the file is missing).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregates as A
from . import score as S
from . import selection as P
from .ordered import times

#: The sources that each task needs, and names of metrics and of the current matcher.
NEEDS = {
    "schema": ("html_empty", "html_filled", "json_empty", "json_filled"),
    "alignment": ("html_empty", "html_filled", "meta", "placeholder_html"),
    "infill": ("html_empty", "html_filled", "context", "placeholder_html"),
}
MATCHER = "source_faithful_v3"
METRICS = {"cpp": "jedi_cpp", "py_tree": "jedi_py:tree_edit", "py_fast": "jedi_py:fast_structural"}


def slot_count(gold: Column, blank: Column, matcher: str = MATCHER) -> Column:
    """Targets of an infill sample: the total of scoring an empty prediction."""
    return S.infill_counts(matcher)(F.lit(""), gold, blank)["total"]


def counted(sources: DataFrame, matcher: str = MATCHER) -> DataFrame:
    """sources with the targets of alignment and infill, each document read once;
    joins with predictions reuse them instead of counting for each model."""
    targets = S.meta_targets(F.col("meta"))
    have = F.col("html_filled").isNotNull() & F.col("placeholder_html").isNotNull()
    return sources.withColumn("alignment_targets", targets).withColumn("infill_targets", F.when(have, slot_count(F.col("html_filled"), F.col("placeholder_html"), matcher)))


def eligibility(sources: DataFrame, tasks: Sequence[str] = P.TASKS, matcher: str = MATCHER) -> DataFrame:
    """lang, sample_id, task, eligible, target_count, source_status, source_issue:
    one row for each task of each sample. Missing sources and unreadable metadata
    are source errors; samples without targets are not eligible."""
    rows = counted(sources, matcher)
    each = []
    for task in tasks:
        names = P.missing((F.lit(n), F.col(n)) for n in NEEDS[task])
        n = {"schema": F.lit(1), "alignment": F.col("alignment_targets"), "infill": F.col("infill_targets")}[task]
        issue = F.when(F.size(names) > 0, P.missing_message(names)).when(n.isNull(), f"invalid {task} source")
        each.append(F.struct(F.lit(task).alias("task"), n.cast("long").alias("n"), issue.alias("issue")))
    flat = rows.select("lang", "sample_id", F.explode(F.array(*each)).alias("x"))
    n = F.when(F.col("x.issue").isNull(), F.col("x.n")).otherwise(0)
    status = F.when(F.col("x.issue").isNotNull(), "source_error").when(n > 0, "eligible").otherwise("ineligible_no_targets")
    return flat.select("lang", "sample_id", "x.task", (n > 0).alias("eligible"), n.alias("target_count"), status.alias("source_status"), F.coalesce("x.issue", F.lit("")).alias("source_issue"))


def evaluation_manifest(eligible: DataFrame, models: DataFrame, predictions: DataFrame, inputs: DataFrame, conditions: Sequence[str] = ("filled", "empty")) -> DataFrame:
    """A row for each model, condition and eligible sample: its input path and
    its prediction's state (predictions: model, task, lang, condition, sample_id,
    document; inputs: path). Everything but a ready prediction should be retried."""
    keys = ["model", "task", "lang", "condition", "sample_id"]
    pairs = models.select("model").withColumn("condition", F.explode(F.array(*(F.lit(c) for c in conditions))))
    rows = eligible.where("eligible").select("lang", "sample_id", "task", "target_count")
    rows = times(rows, pairs)
    rows = rows.withColumn("input_path", P.input_path(F.col("model"), F.col("condition"), F.col("lang"), F.col("sample_id")))
    seen = predictions.select(*keys, "document")
    known = inputs.select(F.col("path").alias("input_path")).distinct().withColumn("__there", F.lit(True))
    rows = rows.join(seen, keys, "left").join(known, "input_path", "left")
    status = F.when(F.col("__there").isNull(), "missing_input").otherwise(S.prediction_status(F.col("document")))
    return rows.select(*keys, "target_count", "input_path", status.alias("prediction_status"), (status != "ready").alias("retry_recommended"))


def job_set_differences(prepared: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs that are repeated in prepared, only there, or only in current; no rows where the sets agree."""
    a = prepared.groupBy(*keys).agg(F.count("*").alias("n"))
    both = a.join(current.select(*keys).distinct().withColumn("__there", F.lit(True)), list(keys), "full")
    what = F.when(F.col("n").isNull(), "not prepared").when(F.col("__there").isNull(), "not a job").when(F.col("n") > 1, "repeated")
    return both.select(*keys, what.alias("difference")).where("difference is not null")


def zero_alignment(sources: DataFrame) -> DataFrame:
    """What an unusable prediction scores: lang, sample_id, type, correct (0), total, the same denominators."""
    types = sources.select("lang", "sample_id", F.explode(S.meta_types(F.col("meta"))).alias("type"))
    return types.groupBy("lang", "sample_id", "type").agg(F.lit(0).alias("correct"), F.count("*").alias("total"))


def zero_similarity(pred_status: Column, metric: str = "py_tree", gold_status: Column | None = None) -> Column:
    return F.struct(F.lit(0.0).alias("similarity"), F.lit(None).cast("int").alias("distance"), F.lit(0).alias("size_pred"), F.lit(0).alias("size_gold"), pred_status.alias("pred_status"), (F.lit("ok") if gold_status is None else gold_status).alias("gold_status"), F.lit(METRICS[metric]).alias("metric"))


def invalid_predictions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, invalid_count and the first 50 sample ids whose prediction has a state other than ok or repaired."""
    from .coverage import preview

    status = F.trim(F.coalesce("pred_status", F.lit("")))
    bad = rows.where(~status.isin("", "ok", "repaired")).withColumn("sample_id", F.col("sample_id").try_cast("long")).where("sample_id is not null")
    return bad.groupBy(*keys).agg(F.count("*").alias("invalid_count")).join(preview(bad, keys, "sample_id"), list(keys))


def version_mismatches(summaries: DataFrame, expected: str = MATCHER) -> DataFrame:
    """Infill summaries that another matcher made, or none that is named."""
    actual = F.coalesce("metric_version", F.lit(""))
    rows = summaries.where((F.col("task") == "infill") & (actual != expected))
    return rows.select("model", "condition", "lang", F.when(actual == "", "unversioned").otherwise(actual).alias("actual"))


def require_versions(summaries: DataFrame, expected: str = MATCHER, shown: int = 10) -> None:
    """Fails with the first few mismatches, if there are any."""
    rows = version_mismatches(summaries, expected)
    n = rows.count()
    if n:
        some = "; ".join(f"{r['model']}/{r['condition']}/{r['lang']}: {r['actual']}" for r in rows.orderBy("model", "condition", "lang").limit(shown).collect())
        raise ValueError(f"summaries of another version than {expected}: {some}" + (f"; and {n - shown} more" if n > shown else ""))


def missing_summaries(summaries: DataFrame, dims: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Combinations of the dimensions that have no summary."""
    cube = dims[0]
    for d in dims[1:]:
        cube = times(cube, d)
    return cube.join(summaries.select(*keys).distinct(), list(keys), "left_anti")


def checkpoint_coverage(records: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """Expected, present and missing test records by task and language, the range
    of ids and the first 50 missing ones."""
    keys = ["task", "lang", "sample_id"]
    has = F.coalesce(F.col("status") == "ready", F.lit(False))
    rows = records.select(*keys).join(predictions.select(*keys, "status"), keys, "left").withColumn("has", has)
    counts = rows.groupBy("task", "lang").agg(F.count("*").alias("expected_count"), F.count_if("has").alias("prediction_count"), F.count_if(~F.col("has")).alias("missing_count"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"))
    from .coverage import preview

    lost = preview(rows.where(~F.col("has")), ["task", "lang"], "sample_id")
    out = counts.join(lost, ["task", "lang"], "left")
    ids = F.coalesce(F.array_join(F.transform("preview", lambda x: x.cast("string")), " "), F.lit(""))
    return out.select(F.lit(model).alias("model"), "task", F.lit("empty").alias("condition"), "lang", "expected_count", "prediction_count", "missing_count", "first_id", "last_id", ids.alias("missing_ids"))


def split_scores(records: DataFrame, details: DataFrame, policy: str = "zero") -> DataFrame:
    """Scores of a checkpoint over the test records by task and language: mean
    similarity for schema, sum of correct over sum of total for the others
    (records: task, lang, sample_id, target_count; details: task, lang,
    sample_id, score, correct, total). A missing prediction scores zero over the
    record's targets, or is left out under policy 'skip'."""
    if policy not in ("zero", "skip"):
        raise ValueError(f"unknown policy: {policy}")
    keys = ["task", "lang", "sample_id"]
    rows = records.join(details.withColumn("__there", F.lit(True)), keys, "left").withColumn("__there", F.coalesce("__there", F.lit(False)))
    counts = rows.groupBy("task", "lang").agg(F.count("*").alias("expected"), F.count_if(~F.col("__there")).alias("missing"))
    if policy == "skip":
        rows = rows.where("__there")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.when(F.col("__there"), zero("total")).otherwise(zero("target_count"))
    sums = rows.groupBy("task", "lang").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.sum(zero("correct")).alias("correct"), F.sum(total).alias("total"))
    out = counts.join(sums, ["task", "lang"], "left")
    return out.select("task", "lang", "expected", "missing", F.when(F.col("task") == "schema", F.col("mean")).otherwise(A.share(F.col("correct"), F.col("total"))).alias("score"))


def alignment_self_check(sources: DataFrame) -> DataFrame:
    """Samples with whether their gold form, turned into inputs, finds all its own targets."""
    from . import html as H

    rows = sources.withColumn("__own", H.inputs_for_markers(F.col("placeholder_html")))
    scored = rows.withColumn("__r", S.alignment_result("__own", "placeholder_html", "meta"))
    return scored.select("lang", "sample_id", F.col("__r.correct").alias("correct"), F.col("__r.total").alias("total"), ((F.col("__r.correct") == F.col("__r.total")) & (F.col("__r.total") > 0)).alias("ok"))
