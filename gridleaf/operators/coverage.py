"""Set, coverage and join-shaped operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def manifest(samples: DataFrame, dims: Sequence[DataFrame], predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every combination of the dimensions (few rows each) for every sample, with its prediction's status."""
    from .ordered import times

    out = samples
    for d in dims:
        out = times(out, d)
    return out.join(predictions, list(keys), "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def coverage(rows: DataFrame, keys: Sequence[str], ready: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("expected"), F.count_if(ready).alias("ready"))


def pair_coverage(rows: DataFrame, keys: Sequence[str], sample: str = "sample_id") -> DataFrame:
    """Samples ready under both conditions, under one only, and whether all are."""
    ready = F.col("status") == "ready"
    has = lambda c: F.bool_or((F.col("condition") == c) & ready)
    each = rows.groupBy(*keys, sample).agg(has("filled").alias("f"), has("empty").alias("e"))
    return each.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("f") & F.col("e")).alias("paired"),
        F.count_if(F.col("f") & ~F.col("e")).alias("filled_only"),
        F.count_if(F.col("e") & ~F.col("f")).alias("empty_only"),
        F.bool_and(F.col("f") & F.col("e")).alias("complete"),
    )


def detail_audit(expected: DataFrame, observed: DataFrame, keys: Sequence[str], sample: str = "sample_id") -> DataFrame:
    """Missing, extra and repeated samples by combination."""
    seen = observed.groupBy(*keys, sample).agg(F.count("*").alias("n"))
    both = expected.select(*keys, sample, F.lit(True).alias("want")).join(seen, [*keys, sample], "full")
    want, n = F.coalesce("want", F.lit(False)), F.coalesce("n", F.lit(0))
    out = both.groupBy(*keys).agg(F.count_if(want & (n == 0)).alias("missing"), F.count_if(~want).alias("extra"), F.count_if(n > 1).alias("duplicates"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicates") == 0))


def common_support(details: DataFrame, combo: Column, sample: Sequence[str], combos: int) -> DataFrame:
    """Samples that every combination has: relational division."""
    return details.groupBy(*sample).agg(F.count_distinct(combo).alias("n")).where(F.col("n") == combos).select(*sample)


def overlay(artifacts: DataFrame, keys: Sequence[str] = ("lang", "sample_id")) -> DataFrame:
    """Roots merged by sample: equal core hashes are one sample, others a conflict;
    so are auxiliaries that differ. Root order decides which root is named."""
    core = artifacts.groupBy(*keys, "root", "root_order").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stage", "sha256"))), "|"), 256).alias("core"))
    out = core.groupBy(*keys).agg(F.count("*").alias("roots"), F.count_distinct("core").alias("versions"), F.min_by("root", "root_order").alias("root"))
    return out.withColumn("conflict", F.col("versions") > 1)


# The stages that make a sample, and those that only go with one.
CORE = ("html_empty", "json_empty", "json_filled", "html_filled", "context", "placeholder_html", "meta")
AUXILIARY = ("html_second", "json_second", "png_empty", "png_filled")


def merged_roots(artifacts: DataFrame) -> DataFrame:
    """lang, sample_id, roots, root (the first), has_core, auxiliary (stage to
    digest) and issue of each sample over all roots (artifacts: lang, sample_id,
    stage, root, root_order, sha256, null if unreadable, read_issue). Roots must
    agree in their core stages, missing and unreadable ones included. Auxiliary
    stages add up: they may not differ where two roots have one, nor be
    unreadable where roots meet, nor differ at all in a sample whose core is not whole."""
    is_core, digest = F.col("stage").isin(*CORE), F.coalesce("sha256", F.lit(""))
    of = lambda where, value: F.array_sort(F.collect_list(F.when(where, value)))
    entry = F.struct("stage", "sha256")
    each = artifacts.groupBy("lang", "sample_id", "root", "root_order").agg(
        of(is_core, F.concat_ws("=", "stage", digest, F.coalesce("read_issue", F.lit("")))).alias("core"), F.count_if(is_core & F.col("sha256").isNotNull()).alias("readable"),
        of(~is_core & F.col("sha256").isNotNull(), entry).alias("aux"), F.count_if(~is_core & F.col("sha256").isNull()).alias("unread"),
    )
    rows = each.groupBy("lang", "sample_id").agg(
        F.count("*").alias("roots"), F.min_by("root", "root_order").alias("root"), F.count_distinct("core").alias("cores"), F.max(F.size("core")).alias("n_core"), F.min("readable").alias("readable"),
        F.array_distinct(F.flatten(F.collect_list("aux"))).alias("aux"), F.count_distinct("aux").alias("auxes"), F.sum("unread").alias("unread"),
    )
    differs = F.size("aux") > F.size(F.array_distinct(F.col("aux.stage")))
    several = F.col("roots") > 1
    issue = F.when(F.col("cores") > 1, "conflicting sample").when(several & (differs | (F.col("unread") > 0) | ((F.col("auxes") > 1) & (F.col("readable") < len(CORE)))), "conflicting auxiliary")
    known = F.when(issue.isNull(), F.map_from_entries("aux"))
    return rows.select("lang", "sample_id", "roots", "root", (F.col("n_core") > 0).alias("has_core"), known.alias("auxiliary"), issue.alias("issue"))


def wrong_names(files: DataFrame, keys: Sequence[str] = ("root", "stage", "lang")) -> DataFrame:
    """Files (keys, name without suffix) whose number is not written as numbers
    are, or that several files of a stage have: aliases of a sample that would hide one another."""
    number = F.col("name").try_cast("decimal(38,0)")
    rows = files.where(F.col("name").rlike(r"^\p{Nd}+$")).withColumn("number", number)
    alias = ~F.col("name").eqNullSafe(F.col("number").cast("string")) | (F.col("number") < 1)
    same = rows.groupBy(*keys, "number").agg(F.count("*").alias("files"), F.bool_or(alias).alias("alias"), F.array_sort(F.collect_list("name")).alias("names"))
    return same.where("alias OR files > 1").select(*keys, "names", F.when(F.col("alias"), "noncanonical").otherwise("repeated").alias("issue"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; a total order makes them the same in every run."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def repeated(df: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """keys, copies and first_id of the identities that several rows have."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(ident).alias("first_id")).where("copies > 1")


def unlisted(files: DataFrame, manifest_: DataFrame, keys: Sequence[str]) -> DataFrame:
    return files.join(manifest_, list(keys), "left_anti")


def histogram(rows: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """n of each state by keys, and of, the rows of the keys."""
    h = rows.groupBy(*keys, status).agg(F.count("*").alias("n"))
    return h.withColumn("of", F.sum("n").over(W.partitionBy(*keys)))


def ranked(found: DataFrame, known: DataFrame, name: str, last: int = 99) -> DataFrame:
    """Distinct names with the rank of a known order (name, rank), unknown ones behind."""
    from .ordered import bounded

    return found.select(name).distinct().join(bounded(known), name, "left").select(name, F.coalesce("rank", F.lit(last)).alias("rank"))


def first_alias(rows: DataFrame, aliases: DataFrame, keys: Sequence[str], name: str, none: str) -> DataFrame:
    """keys and the alias of the least rank whose fragment the name holds, or
    starts with (aliases: fragment, alias, rank, starts: few rows)."""
    from .ordered import bounded

    holds = F.when(F.col("starts"), F.startswith(name, F.col("fragment"))).otherwise(F.contains(F.col(name), F.col("fragment")))
    found = rows.join(bounded(aliases), holds, "left")
    return found.groupBy(*keys).agg(F.coalesce(F.min_by("alias", "rank"), F.lit(none)).alias("alias"))


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return first_by(df, keys, [F.col(order).desc()])


def stage_audit(expected: DataFrame, files: DataFrame, keys: Sequence[str] = ("stage", "lang")) -> DataFrame:
    """Missing, extra and repeated ids of each stage and language."""
    return detail_audit(expected, files, keys)


def intersection(base: DataFrame, tuned: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(tuned, list(keys), "left_semi")


def preview(df: DataFrame, keys: Sequence[str], value: str, n: int = 50) -> DataFrame:
    """The first few distinct values of each key, in order, without gathering the others."""
    w = W.partitionBy(*keys).orderBy(value)
    some = df.select(*keys, value).distinct().withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return some.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("preview"))
