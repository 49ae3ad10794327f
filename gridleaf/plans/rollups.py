"""Roll-ups over scores that are derived from orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import coverage as G
from .registry import query

_LANG = "CASE WHEN o_custkey % 3 = 0 THEN 'zh' WHEN o_custkey % 3 = 1 THEN 'en' ELSE 'fr' END"
_TASK = "CASE o_orderpriority WHEN '1-URGENT' THEN 'schema' WHEN '2-HIGH' THEN 'alignment' ELSE 'infill' END"
_DETAILS = f"""
SELECT o_orderkey AS sample_id, 'm' || (o_custkey % 4) AS model, {_TASK} AS task, {_LANG} AS lang,
  CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'empty' END AS condition, o_custkey % 8 AS total, least(o_custkey % 8, o_orderkey % 6) AS correct,
  CASE WHEN o_custkey % 8 = 0 THEN 0 ELSE least(o_custkey % 8, o_orderkey % 6) / (o_custkey % 8) END AS score FROM orders"""


def _details(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    total = c % 8
    correct = F.least(total, k % 6)
    return t("orders").select(
        k.alias("sample_id"),
        F.concat(F.lit("m"), (c % 4).cast("string")).alias("model"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "schema").when(F.col("o_orderpriority") == "2-HIGH", "alignment").otherwise("infill").alias("task"),
        F.when(c % 3 == 0, "zh").when(c % 3 == 1, "en").otherwise("fr").alias("lang"),
        F.when(F.col("o_orderstatus") == "F", "filled").otherwise("empty").alias("condition"),
        total.alias("total"),
        correct.alias("correct"),
        F.when(total == 0, 0.0).otherwise(correct / total).alias("score"),
    )


@query(f"""
WITH d AS ({_DETAILS})
SELECT task, lang, condition, count(*) AS rows, count(*) AS done, true AS complete,
  round(CASE WHEN task = 'schema' THEN avg(score) ELSE sum(correct) / nullif(sum(total), 0) END, 9) AS score FROM d GROUP BY task, lang, condition""")
def macro_micro_scores(t):
    out = A.status_summary(_details(t).withColumn("status", F.lit("scored")))
    return out.withColumn("score", F.round("score", 9))


def _summaries(t):
    d = _details(t)
    return d.groupBy("model", "task", "lang", "condition").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.count("*").alias("samples"), F.avg("score").alias("score")).withColumns({"correct": F.when(F.col("task") != "schema", F.col("correct")), "total": F.when(F.col("task") != "schema", F.col("total"))})


_SUMMARIES = f"""
s AS (SELECT model, task, lang, condition, CASE WHEN task <> 'schema' THEN sum(correct) END AS correct, CASE WHEN task <> 'schema' THEN sum(total) END AS total, count(*) AS samples, avg(score) AS score
  FROM ({_DETAILS}) GROUP BY model, task, lang, condition),
b AS (SELECT model, task, condition, CAST(sum(samples) AS BIGINT) AS samples,
  CASE WHEN bool_and(correct IS NOT NULL AND total IS NOT NULL) AND sum(total) > 0 THEN sum(correct) / sum(total) ELSE sum(score * samples) / sum(samples) END AS score
  FROM s WHERE lang IN ('en', 'zh') GROUP BY model, task, condition)"""


@query(f"WITH {_SUMMARIES} SELECT model, task, condition, samples, round(score, 9) AS score FROM b")
def combined_lang_score(t):
    return A.combined(_summaries(t), ["model", "task", "condition"]).select("model", "task", "condition", "samples", F.round("score", 9).alias("score"))


def _cells() -> str:
    cell = lambda task, c: f"max(CASE WHEN task = '{task}' AND condition = '{c}' THEN score END)"
    return ", ".join(f"{cell(x, 'filled')} AS {x}_filled, {cell(x, 'empty')} AS {x}_empty, {cell(x, 'empty')} - {cell(x, 'filled')} AS {x}_diff" for x in ("schema", "alignment", "infill"))


_COLUMNS = [f"{x}_{c}" for x in ("schema", "alignment", "infill") for c in ("filled", "empty", "diff")]


@query(f"""
WITH {_SUMMARIES}, w AS (SELECT model, {_cells()} FROM b GROUP BY model)
SELECT model, {", ".join(f"round({c}, 9) AS {c}" for c in _COLUMNS)} FROM w
UNION ALL SELECT 'Task Average', {", ".join(f"round(avg({c}), 9)" for c in _COLUMNS)} FROM w""")
def result_matrix_pivot(t):
    out = A.matrix(A.combined(_summaries(t), ["model", "task", "condition"]))
    return out.select("model", *(F.round(c, 9).alias(c) for c in _COLUMNS))


@query(f"""
SELECT model, condition, CASE WHEN grouping(lang) = 1 THEN 'both' ELSE lang END AS lang, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total
FROM ({_DETAILS}) GROUP BY GROUPING SETS ((model, condition, lang), (model, condition))""")
def both_grouping_sets(t):
    return A.with_both(_details(t), ["model", "condition"], ["correct", "total"])


@query(f"""
SELECT model, CAST(sum(CASE WHEN task = 'alignment' THEN correct END) AS BIGINT) AS al_correct, CAST(sum(CASE WHEN task = 'alignment' THEN total END) AS BIGINT) AS al_total,
  CAST(sum(CASE WHEN task = 'infill' THEN correct END) AS BIGINT) AS in_correct, CAST(sum(CASE WHEN task = 'infill' THEN total END) AS BIGINT) AS in_total FROM ({_DETAILS}) GROUP BY model""")
def field_type_pivot(t):
    d = _details(t).withColumn("type", F.when(F.col("task") == "alignment", "AL").when(F.col("task") == "infill", "IN"))
    return A.by_type(d, ["model"], ("AL", "IN"))


def _items(t):
    return t("lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "LI").when(F.col("l_returnflag") == "A", "GI").otherwise("SI").alias("type"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("int") % 4 + 1).alias("n_offsets"), (F.col("l_orderkey") % 3).cast("string").alias("lang"))


_ITEMS = "SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'LI' WHEN 'A' THEN 'GI' ELSE 'SI' END AS type, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) % 4 + 1 ELSE 1 END AS n, CAST(l_orderkey % 3 AS VARCHAR) AS lang FROM lineitem"
_LEVELS = f"SELECT l_orderkey, lang, CAST(CASE WHEN bool_or(type = 'LI') THEN 3 WHEN bool_or(type = 'GI') THEN 2 ELSE 1 END AS INTEGER) AS level, " + ", ".join(f"sum(CASE WHEN type = '{x}' THEN n ELSE 0 END) AS {x.lower()}" for x in ("SI", "GI", "SO", "GO", "LI")) + f" FROM ({_ITEMS}) GROUP BY l_orderkey, lang"


@query(f"""
SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, level, count(*) AS tables, {", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in ("si", "gi", "so", "go", "li"))}
FROM ({_LEVELS}) GROUP BY GROUPING SETS ((lang, level), (level))""")
def structure_levels(t):
    return A.level_statistics(A.levels(_items(t), ["l_orderkey", "lang"]))


@query(f"""
SELECT sample_id, correct - total AS delta FROM ({_DETAILS}) ORDER BY abs(correct - total) DESC, sample_id LIMIT 12""")
def top_changes(t):
    return A.top_changes(_details(t).select("sample_id", (F.col("correct") - F.col("total")).alias("delta")), "delta", "sample_id")


@query(f"""
SELECT task, lang, max(total) AS total, count(DISTINCT total) = 1 AS agrees, count(*) AS summaries
FROM (SELECT model, task, lang, condition, CAST(sum(total) AS BIGINT) AS total FROM ({_DETAILS}) GROUP BY ALL) GROUP BY task, lang""")
def target_inventory(t):
    s = _details(t).groupBy("model", "task", "lang", "condition").agg(F.sum("total").alias("total"))
    return A.invariant_totals(s)


@query(f"""
WITH c AS (SELECT condition, task, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total, count(*) AS samples FROM ({_DETAILS}) WHERE total > 0 GROUP BY condition, task)
SELECT condition, task, correct, total, samples, round(correct / total, 9) AS score FROM c""")
def micro_scores(t):
    return A.micro(_details(t), ["condition", "task"]).withColumn("score", F.round("score", 9))


@query(f"""
WITH d AS ({_DETAILS}), v AS (SELECT *, 'v' || (sample_id % 5) AS version, row_number() OVER (PARTITION BY model, task ORDER BY sample_id % 5 DESC, sample_id DESC) AS n FROM d)
SELECT model, task, version, sample_id, round(score, 9) AS score FROM v WHERE n = 1""")
def latest_variant(t):
    d = _details(t).withColumn("version", F.concat(F.lit("v"), (F.col("sample_id") % 5).cast("string")))
    out = G.first_by(d, ["model", "task"], [(F.col("sample_id") % 5).desc(), F.col("sample_id").desc()])
    return out.select("model", "task", "version", "sample_id", F.round("score", 9).alias("score"))
