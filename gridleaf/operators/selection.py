"""Choices of records: by task, language, model group, file presence and order."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .coverage import first_by

# Tasks and languages in their order, and what stands for all languages.
TASKS = ("schema", "alignment", "infill")
LANGS = ("en", "zh")
BOTH = "both"


def expand_tasks(chosen: Sequence[str] | None, known: Sequence[str] = TASKS) -> tuple[str, ...]:
    """The chosen tasks; none or 'all' means every known one, an unknown one is an error."""
    if not chosen or "all" in chosen:
        return tuple(known)
    wrong = [c for c in chosen if c not in known]
    if wrong:
        raise ValueError(f"unknown tasks: {', '.join(wrong)}")
    return tuple(chosen)


def expand_langs(lang: str, known: Sequence[str] = LANGS) -> tuple[str, ...]:
    if lang == BOTH:
        return tuple(known)
    if lang not in known:
        raise ValueError(f"unknown language: {lang}")
    return (lang,)


def test_records(records: DataFrame, task: str, lang: str) -> DataFrame:
    """Records of a task and language that are of the test split or of none."""
    own = F.lit(True) if lang == BOTH else F.col("lang") == lang
    return records.where((F.col("task") == task) & (F.coalesce("split", F.lit("test")) == "test") & own)


def limited(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in a total order; 0 means all. Each task keeps n of its own, so no task sees all rows."""
    return rows.orderBy(*order).limit(n) if n else rows


def image_reference(model: Column) -> Column:
    return F.endswith(model, F.lit("-image"))


def open_source(backend: Column) -> Column:
    return F.lower(backend).isin("local", "open", "vllm", "transformers")


def models_of(models: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Models of any of the groups; no groups means all models."""
    return models.where(F.col("model_group").isin(*groups)) if groups else models


def projected(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields as text in order; a field that rows lack, or a null, is empty."""
    have = set(rows.columns)
    return rows.select(*((F.coalesce(F.col(f).cast("string"), F.lit("")) if f in have else F.lit("")).alias(f) for f in fields))


def missing(named: Iterable[tuple[Column, Column]]) -> Column:
    """Names of the contents that are null, in order."""
    return F.filter(F.array(*(F.when(content.isNull(), name) for name, content in named)), lambda x: x.isNotNull())


def missing_message(names: Column) -> Column:
    return F.array_join(names, "; ")


def input_path(model: Column, condition: Column, lang: Column, sample_id: Column) -> Column:
    """What a model reads: the rendered image for an image model, else the form of the condition."""
    folder = F.when(image_reference(model), F.concat(F.lit("rendered/"), condition)).when(condition == "filled", "filled_html").otherwise("html_template")
    return F.concat(folder, F.lit("/data_"), lang, F.lit("/"), sample_id.cast("string"), F.when(image_reference(model), ".png").otherwise(".html"))


def ordered_unique(rows: DataFrame, value: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each value."""
    return first_by(rows, [value], order)


def union_ids(frames: Iterable[DataFrame], ident: str = "sample_id") -> DataFrame:
    out = None
    for f in frames:
        out = f.select(ident) if out is None else out.union(f.select(ident))
    return out.distinct()


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("lang", "sample_id")) -> DataFrame:
    """Samples that both stages have."""
    return a.join(b, list(keys))


def balanced_view(rows: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("lang", "sample_id"), n: int | None = None) -> DataFrame:
    """Rows of the chosen samples; where n is given, another number of chosen samples found fails the job."""
    if n is not None:
        found = rows.select(*keys).distinct().join(chosen, list(keys), "left_semi").count()
        if found != n:
            raise ValueError(f"{found} of {n} chosen samples found")
    return rows.join(chosen.select(*keys).distinct(), list(keys), "left_semi")


def rounds(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], workers: int) -> DataFrame:
    """rows with the worker that takes each in turn, inside every group of keys."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("worker", ((F.row_number().over(w) - 1) % workers).cast("int"))
