"""Roll-ups of scores. All are aggregates with partial sums; dimensions are small and known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(c: Column, t: Column) -> Column:
    return F.when(t > 0, c / t)


def macro(details: DataFrame, keys: Sequence[str], score: str = "score", places: int | None = 6) -> DataFrame:
    """Mean over samples; places rounds each first, None leaves them raw."""
    value = F.col(score) if places is None else F.round(score, places)
    return details.groupBy(*keys).agg(F.avg(value).alias("score"), F.count(score).alias("samples"))


def micro(details: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of correct over sum of total; rows without targets leave first."""
    some = details.where(F.coalesce(F.col("total").try_cast("int"), F.lit(0)) > 0)
    out = some.groupBy(*keys).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.count("*").alias("samples"))
    return out.withColumn("score", share(F.col("correct"), F.col("total")))


def by_type(details: DataFrame, keys: Sequence[str], types: Sequence[str] = ("LI", "GI", "SI", "GO", "SO")) -> DataFrame:
    """Correct and total by field type, as columns."""
    cols = [f(F.when(F.col("type") == t, F.col(c))).alias(f"{t.lower()}_{c}") for t in types for f, c in ((F.sum, "correct"), (F.sum, "total"))]
    return details.groupBy(*keys).agg(*cols)


def status_summary(rows: DataFrame, keys: Sequence[str] = ("task", "lang", "condition")) -> DataFrame:
    """Macro for schema, micro otherwise; counts of states; whether all rows are scored."""
    done = F.col("status").isin("scored", "model_format_failure")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(done).alias("done"),
        F.avg(F.when(done, F.col("score"))).alias("macro"),
        F.sum(F.when(done, F.col("correct"))).alias("correct"),
        F.sum(F.when(done, F.col("total"))).alias("total"),
    )
    score = F.when(F.col("task") == "schema", F.col("macro")).otherwise(share(F.col("correct"), F.col("total")))
    return out.select(*keys, "rows", "done", score.alias("score"), (F.col("rows") == F.col("done")).alias("complete"))


def combined(summaries: DataFrame, keys: Sequence[str], langs: Sequence[str] = ("en", "zh")) -> DataFrame:
    """Languages pooled: by counts where every part has them, else by sample-weighted means."""
    parts = summaries.where(F.col("lang").isin(*langs) & F.col("score").isNotNull() & (F.col("samples") > 0))
    has = F.bool_and(F.col("correct").isNotNull() & F.col("total").isNotNull())
    out = parts.groupBy(*keys).agg(has.alias("has"), F.sum("correct").alias("c"), F.sum("total").alias("t"), (F.sum(F.col("score") * F.col("samples")) / F.sum("samples")).alias("weighted"), F.sum("samples").alias("samples"))
    return out.select(*keys, F.when(F.col("has") & (F.col("t") > 0), F.col("c") / F.col("t")).otherwise(F.col("weighted")).alias("score"), "samples")


def matrix(scores: DataFrame, row: str = "model", tasks: Sequence[str] = ("schema", "alignment", "infill"), conditions: Sequence[str] = ("filled", "empty"), average: str = "Task Average") -> DataFrame:
    """A row for each model with each task's scores and their difference (empty
    less filled), and a row of averages over the models."""
    cell = lambda t, c: F.max(F.when((F.col("task") == t) & (F.col("condition") == c), F.col("score")))
    wide = scores.groupBy(row).agg(*(cell(t, c).alias(f"{t}_{c}") for t in tasks for c in conditions))
    wide = wide.select(row, *(x for t in tasks for x in (f"{t}_filled", f"{t}_empty", (F.col(f"{t}_empty") - F.col(f"{t}_filled")).alias(f"{t}_diff"))))
    values = [c for c in wide.columns if c != row]
    total = wide.agg(*(F.avg(c).alias(c) for c in values)).select(F.lit(average).alias(row), *values)
    return wide.unionByName(total)


def with_both(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums by keys and language, and over languages as lang 'both'."""
    rolled = rows.groupingSets([[*(F.col(k) for k in keys), F.col("lang")], [F.col(k) for k in keys]], *(F.col(k) for k in keys), F.col("lang"))
    out = rolled.agg(F.grouping("lang").alias("__all"), *(F.sum(c).alias(c) for c in sums))
    return out.select(*keys, F.when(F.col("__all") == 1, "both").otherwise(F.col("lang")).alias("lang"), *sums)


def levels(items: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Complexity of each document: 3 with LI, SO or GO, else 2 with GI, else 1; cells by type."""
    size = F.coalesce(F.col("n_offsets"), F.lit(1))
    types = ("SI", "GI", "SO", "GO", "LI")
    out = items.groupBy(*doc).agg(F.bool_or(F.col("type").isin("LI", "SO", "GO")).alias("l3"), F.bool_or(F.col("type") == "GI").alias("l2"), *(F.sum(F.when(F.col("type") == t, size).otherwise(0)).alias(t.lower()) for t in types))
    level = F.when(F.col("l3"), 3).when(F.col("l2"), 2).otherwise(1)
    return out.select(*doc, level.alias("level"), *(t.lower() for t in types))


def level_statistics(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """Documents and cells by language and level, and by level over all ('all')."""
    kinds = ["si", "gi", "so", "go", "li"]
    rolled = docs.groupingSets([[F.col(lang), F.col("level")], [F.col("level")]], F.col(lang), F.col("level"))
    out = rolled.agg(F.grouping(lang).alias("__all"), F.count("*").alias("tables"), *(F.sum(k).alias(k) for k in kinds))
    return out.select(F.when(F.col("__all") == 1, "all").otherwise(F.col(lang)).alias("lang"), "level", "tables", *kinds)


def top_changes(rows: DataFrame, delta: str, tie: str, k: int = 12) -> DataFrame:
    return rows.orderBy(F.abs(F.col(delta)).desc(), F.col(tie)).limit(k)


def slot_inventory(placeholders: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Occurrences, distinct slots, collisions and slots of several values of each document."""
    slots = placeholders.groupBy(*doc, "row", "col", "idx").agg(F.count("*").alias("n"))
    return slots.groupBy(*doc).agg(F.sum("n").alias("occurrences"), F.count("*").alias("slots"), F.sum(F.col("n") - 1).alias("collisions"), F.count_if(F.col("n") > 1).alias("multi"))


def invariant_totals(summaries: DataFrame, keys: Sequence[str] = ("task", "lang")) -> DataFrame:
    """Whether all models and conditions agree on the targets."""
    return summaries.groupBy(*keys).agg(F.max("total").alias("total"), (F.count_distinct("total") == 1).alias("agrees"), F.count("*").alias("summaries"))
