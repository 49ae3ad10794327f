"""Validators: a flag and a reason each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from . import html as H


def verdict(*rules: tuple[Column, str]) -> Column:
    """struct(ok, reason) of the first rule that is broken."""
    reason = F.lit("")
    for broken, why in reversed(rules):
        reason = F.when(broken, why).otherwise(reason)
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))


def generated_html(source: Column, generated: Column) -> Column:
    """A generated form: not empty, no fence, tables kept, structure equal, text changed. Each side is parsed once."""
    return H.form_verdict(source, generated)


def existing_placeholders(source: Column, output: Column, template: Column, filled: Column) -> Column:
    """Whether an output that is already there still holds: struct(ok, reason) of
    its static cells against the template, then of its names against the source."""
    static, names = H.static_changes(template, filled, output), placeholder_names(source, output)
    return verdict(
        (output.isNull() | (F.trim(output) == ""), "empty"),
        (F.size(static) > 0, "static cells changed"),
        (F.size(names) > 0, "names not in the source"),
    )


def placeholder_names(source: Column, output: Column, most: int = 12) -> Column:
    """Names in the output that a Han source text does not hold, the first few."""
    names = F.array_distinct(X.placeholders(output))
    parts = F.flatten(F.transform(names, X.base_parts))
    bare = X.without_space(source)
    return F.when(X.has_han(source), F.slice(F.filter(parts, lambda p: ~F.contains(bare, X.without_space(p))), 1, most)).otherwise(F.array().cast("array<string>"))


def png(content: Column, audited: Column, least: int = 16) -> Column:
    size = X.png_size(content)
    return verdict(
        (F.substring(F.hex(content), 1, 16) != "89504E470D0A1A0A", "no PNG"),
        ((size["width"] < least) | (size["height"] < least), "too small"),
        (~F.coalesce(audited, F.lit(False)), "no layout audit"),
    )


def render_ok(*faults: Column) -> Column:
    out = F.lit(True)
    for f in faults:
        out = out & (F.coalesce(f, F.lit(0)) == 0)
    return out


def score_ok(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0)


def identity_ok(document: Column, model: Column, sample_id: Column, lang: Column, task: Column, condition: Column, raw: Column | None = None) -> Column:
    """Whether what a prediction says of its job is right; an id must be a number of the document, not a truth value or text.
    raw is the document as a variant, where the caller has it."""
    raw = F.try_parse_json(document) if raw is None else raw
    part = lambda path: F.try_variant_get(raw, f"$.{path}", "variant")
    kind = F.schema_of_variant(part("sample_id"))
    said = lambda path, c: part(path).isNull() | F.get_json_object(document, f"$.{path}").eqNullSafe(c)
    number = part("sample_id").isNull() | F.coalesce(kind.isin("BIGINT"), F.lit(False))
    return number & said("sample_id", sample_id.cast("string")) & said("model", model) & said("lang", lang) & said("task", task) & said("condition", condition)


def evidence_ok(a: Column, b: Column, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def job_state(job: Column, has_file: Column, readable: Column, evidence: Column, identity: Column, declared: Column, error: Column, sources: Column, failed: Column, blank: Column) -> Column:
    """The state of a job's evaluation, in the order of precedence."""
    return (
        F.when(job != "ready", job)
        .when(~has_file, "not_run")
        .when(~readable, "prediction_error")
        .when(~evidence, "source_mismatch")
        .when(~identity, "prediction_error")
        .when(declared.isin("not_run", "transport_error", "backend_error"), declared)
        .when((F.coalesce(declared, F.lit("completed")) != "completed") | error.isNotNull(), "prediction_error")
        .when(~sources, "source_error")
        .when(failed, "backend_error")
        .when(blank, "model_format_failure")
        .otherwise("scored")
    )
