"""Evaluation of prepared jobs: one lazy plan from jobs, predictions and sources to scored rows.

jobs: lang, sample_id, model, task, condition, status, and either evidence (a
digest that the prediction names) or all of EVIDENCE, which the prediction's
request must then repeat
predictions: lang, sample_id, model, task, condition, document (the file's text, null if unreadable)
sources: lang, sample_id, json_empty, json_filled, meta, placeholder_html, html_filled

Every job gives a row. States follow the order of validate.job_state; a score is
null unless the state is scored or model_format_failure, and each task's scorer
sees the rows of its own task only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import jobs as J
from . import score as S
from . import selection as P
from . import validate as V
from .workflow import counted

KEYS = ("lang", "sample_id", "model", "task", "condition")
# What a prediction's request must repeat of its job, and the sources whose digests a job names.
EVIDENCE = ("lang", "sample_id", "model", "task", "condition", "schema_metric", "source_hashes", "messages", "target_count", "status")
HASHED = ("html_empty", "json_empty", "json_filled", "html_filled", "context", "placeholder_html", "meta")


def prepared(sources: DataFrame, model: str, metric: str = "py_tree", tasks: Sequence[str] = P.TASKS, conditions: Sequence[str] = ("empty", "filled")) -> DataFrame:
    """The jobs of a model, all of EVIDENCE: one for each task and condition of
    each sample. A source that is missing, blank or unreadable is a source_error;
    a sample without targets is not eligible and is asked nothing."""
    rows = counted(sources)
    there = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    is_object = lambda c: F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(c)), F.lit("OBJECT")), F.lit(False))
    each = []
    for task in tasks:
        for condition in conditions:
            html, gold = F.col(f"html_{condition}"), F.col(f"json_{condition}")
            needs = {"schema": (html, gold), "alignment": (html, F.col("meta"), F.col("placeholder_html")), "infill": (html, F.col("context"), F.col("html_filled"), F.col("placeholder_html"))}[task]
            n = {"schema": F.when(is_object(gold), 1), "alignment": F.col("alignment_targets"), "infill": F.col("infill_targets")}[task]
            ok = n.isNotNull()
            for c in needs:
                ok = ok & there(c)
            asked = J.messages(J.prompt(task, condition, html, F.col("context")))
            each.append(F.struct(
                F.lit(task).alias("task"), F.lit(condition).alias("condition"), F.lit(metric if task == "schema" else None).cast("string").alias("schema_metric"),
                F.when(ok & (n > 0), asked).otherwise(F.array().cast("array<struct<role:string,content:string>>")).alias("messages"),
                F.when(ok, n.cast("int")).alias("target_count"), F.when(~ok, "source_error").when(n > 0, "ready").otherwise("ineligible_no_targets").alias("status"),
            ))
    hashes = F.struct(*(F.sha2(c, 256).alias(c) for c in HASHED))
    flat = rows.select("lang", "sample_id", F.lit(model).alias("model"), hashes.alias("source_hashes"), F.explode(F.array(*each)).alias("x"))
    return flat.select("lang", "sample_id", "model", "source_hashes", "x.*").select(*EVIDENCE)


def request(names: Sequence[str] = EVIDENCE) -> Column:
    """A job as the JSON text that its prediction repeats."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def repeats(said: Column, job: Column) -> Column:
    """Whether a request (variant) has all of a job's evidence (variant), value for value."""
    part = lambda x, k: F.to_json(F.try_variant_get(x, f"$.{k}", "variant"))
    out = F.lit(True)
    for k in EVIDENCE:
        out = out & F.coalesce(part(said, k) == part(job, k), F.lit(False))
    return out


def _field(name: str) -> Column:
    return F.get_json_object("document", f"$.{name}")


def states(jobs: DataFrame, predictions: DataFrame, sources: DataFrame, metric: str = "py_tree", evidence: DataFrame | None = None) -> DataFrame:
    """jobs with their sources, the response without thinking, and the state before
    scoring; a metric whose backend is not there is a state of schema jobs, never
    another metric. evidence holds prepared jobs (all of EVIDENCE): what a
    prediction without a request must have been made from, and any other as well."""
    seen = predictions.select(*KEYS, "document", F.lit(True).alias("has_file"))
    rows = jobs.join(seen, list(KEYS), "left").join(sources, ["lang", "sample_id"], "left")
    # Each document is parsed once, as a column that the conditions below share.
    rows = rows.withColumn("__parsed", F.try_parse_json("document"))
    parsed = F.col("__parsed")
    rows = rows.withColumn("__is_object", F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False)))
    is_object = F.col("__is_object")
    if "messages" in jobs.columns:
        rows = rows.withColumns({"__job": F.parse_json(request()), "__said": F.when(is_object, F.try_variant_get(parsed, "$.request", "variant"))})
        said = F.col("__said")
        same = repeats(said, F.col("__job"))
        if evidence is not None:
            rows = rows.join(evidence.select(*KEYS, F.parse_json(request()).alias("__prepared")), list(KEYS), "left")
            own = repeats(F.col("__prepared"), F.col("__job"))
            same = F.when(F.col("__prepared").isNull(), same).otherwise(own & (said.isNull() | same))
    else:
        same = F.coalesce(_field("evidence") == F.col("evidence"), F.lit(False)) & is_object
    identity = V.identity_ok(F.col("document"), F.col("model"), F.col("sample_id"), F.col("lang"), F.col("task"), F.col("condition"), parsed)
    is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.raw_response", "variant")) == "STRING"
    rows = rows.withColumns({"response": F.coalesce(X.without_thinking(F.when(is_object & is_text, _field("raw_response"))), F.lit("")), "__declared": _field("status")})
    need = {"schema": F.when(F.col("condition") == "filled", F.col("json_filled")).otherwise(F.col("json_empty")).isNotNull(), "alignment": F.col("meta").isNotNull() & F.col("placeholder_html").isNotNull(), "infill": F.col("html_filled").isNotNull() & F.col("placeholder_html").isNotNull()}
    have = F.lit(False)
    for task, c in need.items():
        have = have | ((F.col("task") == task) & c)
    wanted = F.coalesce("schema_metric", F.lit(metric)) if "schema_metric" in jobs.columns else F.lit(metric)
    error = F.nullif(_field("error"), F.lit(""))
    state = V.job_state(F.col("status"), F.coalesce("has_file", F.lit(False)), F.col("document").isNotNull(), same, identity, F.col("__declared"), error, have, ~wanted.isin(*S.SCHEMA_METRICS) & (F.col("task") == "schema"), F.trim("response") == "")
    return rows.withColumn("state", state).drop("__parsed", "__is_object", "__job", "__said", "__prepared", "__declared")


def evaluated(jobs: DataFrame, predictions: DataFrame, sources: DataFrame, matcher: str = "source_faithful_v3", metric: str = "py_tree", evidence: DataFrame | None = None) -> DataFrame:
    """KEYS, state, score, correct, total, in one pass over the joined rows: a
    scorer gets nulls for rows of other tasks, which it answers without parsing.
    Jobs that know their targets have them as total, whatever their state."""
    rows = states(jobs, predictions, sources, metric, evidence)
    live = F.col("state").isin("scored", "model_format_failure")
    gold = F.when(F.col("condition") == "filled", F.col("json_filled")).otherwise(F.col("json_empty"))
    of = lambda task, c: F.when(live & (F.col("task") == task), c)
    rows = rows.withColumns({
        "__s": S.schema_result(metric if metric in S.SCHEMA_METRICS else "py_tree")(of("schema", F.col("response")), of("schema", gold)),
        "__a": S.alignment_result(of("alignment", F.col("response")), of("alignment", F.col("placeholder_html")), of("alignment", F.col("meta"))),
        "__i": S.infill_counts(matcher)(of("infill", F.col("response")), of("infill", F.col("html_filled")), of("infill", F.col("placeholder_html"))),
    })
    is_schema, counts = live & (F.col("task") == "schema"), F.when(F.col("task") == "alignment", F.struct("__a.correct", "__a.total")).when(F.col("task") == "infill", F.col("__i"))
    counts = F.when(live, counts)
    bad = is_schema & ~F.col("__s.pred_status").isin("ok", "repaired")
    state = F.when(bad, "model_format_failure").otherwise(F.col("state"))
    score = F.when(is_schema, F.col("__s.similarity")).otherwise(counts["correct"] / F.nullif(counts["total"], F.lit(0)))
    total = F.coalesce(counts["total"], F.col("target_count")) if "target_count" in jobs.columns else counts["total"]
    return rows.select(*KEYS, state.alias("state"), score.alias("score"), counts["correct"].alias("correct"), total.alias("total"))
