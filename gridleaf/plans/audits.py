"""Audits, result tables, choices and plans over further tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import audit as U
from ..operators import coverage as G
from ..operators import html as H
from ..operators import incremental as K
from ..operators import jobs as J
from ..operators import ordered as O
from ..operators import selection as P
from ..operators.clustered import dealt
from .registry import query


def _audit_frames(t):
    """A form of two cells an order, the first with two marks: predictions are
    right, have the words of the first in another order, give only a part, or nothing."""
    k = F.col("o_orderkey")
    row = lambda a, b: F.concat(F.lit("<table><tr><td>L</td><td>"), a, F.lit("</td><td>"), b, F.lit("</td></tr></table>"))
    lang = F.when(k % 2 == 0, "en").otherwise("zh").alias("lang")
    src = t("orders").select(lang, k.alias("sample_id"), row(F.lit("[A] [B]"), F.lit("[C]")).alias("placeholder_html"), row(F.lit("alpha beta"), F.lit("gamma")).alias("html_filled"))
    right = row(F.lit("alpha beta"), F.lit("gamma"))
    html = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, row(F.lit("beta alpha"), F.lit("gamma"))).when(k % 5 == 2, row(F.lit("alpha"), F.lit("g"))).otherwise(right)
    pred = t("orders").select(F.lit("infill").alias("task"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), F.lit("empty").alias("condition"), lang, k.alias("sample_id"), html.alias("html"))
    return pred, src


@query("""
SELECT o_orderkey AS sample_id, CAST(2 + k AS INTEGER) AS visible_placeholder_occurrences, CAST(2 AS INTEGER) - CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS legacy_targets, CAST(k AS INTEGER) AS legacy_slot_collision_occurrences, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS legacy_empty_gold_slots,
  CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END + 1 AS INTEGER) AS hardened_evaluable_cells, CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS hardened_text_cells, CAST(CASE WHEN k > 0 THEN 1 ELSE 0 END AS INTEGER) AS hardened_multi_value_cells, CAST(1 AS INTEGER) AS hardened_control_cells FROM (SELECT *, o_orderkey % 3 AS k FROM orders)""")
def source_inventory(t):
    """Marks, slots and targets of a form: one to three marks in its first cell,
    one in its second, which some samples leave empty, and a marked box to tick."""
    k = (F.col("o_orderkey") % 3).cast("int")
    names = F.array_join(F.transform(F.sequence(F.lit(0), k), lambda i: F.concat(F.lit("["), F.substring(F.lit("ABC"), i + 1, F.lit(1)), F.lit("]"))), " ")
    row = lambda a, b, c: F.concat(F.lit("<table><tr><td>L</td><td>"), a, F.lit("</td><td>"), b, F.lit('</td><td><input type="checkbox"'), c, F.lit("></td></tr></table>"))
    blank = row(names, F.lit("[D]"), F.lit(' name="[E]"'))
    filled = row(F.lit("alpha beta"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise("gamma"), F.lit(" checked"))
    src = dealt(t("orders"), "o_orderkey").select(F.lit("en").alias("lang"), F.col("o_orderkey").alias("sample_id"), filled.alias("html_filled"), blank.alias("placeholder_html"))
    return U.source_inventory(src).select("sample_id", "visible_placeholder_occurrences", "legacy_targets", "legacy_slot_collision_occurrences", "legacy_empty_gold_slots", "hardened_evaluable_cells", "hardened_text_cells", "hardened_multi_value_cells", "hardened_control_cells")


_AUDIT = """
SELECT sample_id, m, lang, CAST(CASE r WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS legacy_correct, CAST(2 AS INTEGER) AS legacy_total, CAST(CASE r WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS INTEGER) AS hardened_correct, CAST(2 AS INTEGER) AS hardened_total,
  CAST(CASE r WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS reverse_n, CAST(CASE r WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS single, CAST(CASE r WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS in_multi, CAST(CASE r WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS reorder
FROM (SELECT o_orderkey AS sample_id, 'm' || (o_custkey % 3) AS m, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, o_orderkey % 5 AS r FROM orders)"""


@query(f"""
SELECT sample_id, legacy_correct, legacy_total, hardened_correct, hardened_total, reverse_n AS legacy_reverse_substring_correct, single AS legacy_reverse_single_char_correct, in_multi AS legacy_reverse_in_multi_value_cell, reorder AS hardened_reorder_candidates,
  round(100 * (round(hardened_correct / 2.0, 9) - round(legacy_correct / 2.0, 9)), 6) AS score_delta_pp FROM ({_AUDIT})""")
def metric_audit(t):
    """Both matchers on each prediction, and what only one of them accepts."""
    out = U.audited(*_audit_frames(t))
    return out.select("sample_id", "legacy_correct", "legacy_total", "hardened_correct", "hardened_total", "legacy_reverse_substring_correct", "legacy_reverse_single_char_correct", "legacy_reverse_in_multi_value_cell", "hardened_reorder_candidates", "score_delta_pp")


@query(f"""
SELECT m AS model, CASE WHEN grouping(lang) = 1 THEN 'both' ELSE lang END AS lang, CAST(sum(legacy_correct) AS BIGINT) AS legacy_correct, CAST(sum(legacy_total) AS BIGINT) AS legacy_total, CAST(sum(hardened_correct) AS BIGINT) AS hardened_correct, CAST(sum(hardened_total) AS BIGINT) AS hardened_total,
  round(sum(legacy_correct) / sum(legacy_total), 9) AS legacy_score, round(sum(hardened_correct) / sum(hardened_total), 9) AS hardened_score FROM ({_AUDIT}) GROUP BY GROUPING SETS ((m, lang), (m))""")
def metric_audit_sums(t):
    sums = ["legacy_correct", "legacy_total", "hardened_correct", "hardened_total"]
    return U.column_sums(U.audited(*_audit_frames(t)), ["model"], sums)


@query(f"""
SELECT sample_id, CAST(i AS INTEGER) AS col, CAST(j AS INTEGER) AS idx, gold, prediction, multi FROM ({_AUDIT}), (VALUES (1, 0, 'alphabeta', 'alpha', true), (2, 0, 'gamma', 'g', false)) v(i, j, gold, prediction, multi) WHERE reverse_n > 0""")
def reverse_matches(t):
    """Predictions that are only a part of the gold text, one row a target."""
    out = U.audited(*_audit_frames(t))
    return out.select("sample_id", F.explode("reverse").alias("x")).select("sample_id", "x.col", "x.idx", "x.gold", "x.prediction", "x.multi")


_SUMMARY = "SELECT CASE l_linenumber % 2 WHEN 0 THEN 'alignment' ELSE 'infill' END AS task, CASE l_returnflag WHEN 'N' THEN 'filled' ELSE 'empty' END AS condition, CASE l_linestatus WHEN 'O' THEN 'en' ELSE 'zh' END AS lang, 'm' || (l_suppkey % 4) AS model, CAST(l_quantity AS BIGINT) AS correct, CAST(100 AS BIGINT) AS total FROM lineitem"


def _summaries(t):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    return t("lineitem").select(F.when(n % 2 == 0, "alignment").otherwise("infill").alias("task"), F.when(F.col("l_returnflag") == "N", "filled").otherwise("empty").alias("condition"), F.when(F.col("l_linestatus") == "O", "en").otherwise("zh").alias("lang"), F.concat(F.lit("m"), (s % 4).cast("string")).alias("model"), F.col("l_quantity").cast("long").alias("correct"), F.lit(100).cast("long").alias("total"))


_POOLED = f"p AS (SELECT task, model, sum(correct) FILTER (condition = 'filled') / sum(total) FILTER (condition = 'filled') AS f, sum(correct) FILTER (condition = 'empty') / sum(total) FILTER (condition = 'empty') AS e FROM ({_SUMMARY}) GROUP BY ALL)"


@query(f"""
WITH {_POOLED} SELECT task, measure, round(value, 9) AS value FROM (SELECT task, 'filled' AS measure, avg(f) AS value FROM p GROUP BY task UNION ALL SELECT task, 'empty', avg(e) FROM p GROUP BY task UNION ALL SELECT task, 'delta', avg(e - f) FROM p GROUP BY task)""")
def table_reconstruction(t):
    """Languages pooled for each model and condition, then the mean over models."""
    return U.reconstructed(_summaries(t)).withColumn("value", F.round("value", 9))


@query(f"""
WITH {_POOLED}, v AS (SELECT task, avg(f) AS f, avg(e) AS e FROM p GROUP BY task)
SELECT task, measure, matches FROM (SELECT task, 'filled' AS measure, true AS matches FROM v UNION ALL SELECT task, 'empty', task = 'alignment' FROM v UNION ALL SELECT task, 'delta', true FROM v)""")
def published_comparison(t):
    """Against a published row that is right but for one cell."""
    found = U.reconstructed(_summaries(t))
    shown = lambda task, m, off=0.0: F.max(F.when((F.col("task") == task) & (F.col("measure") == m), F.format_string("%.1f%%", F.bround(F.col("value") * 100, 1) + off)))
    names = {"filled": "filled", "empty": "templ", "delta": "diff"}
    row = found.agg(*(shown(task, m, 0.3 if (task, m) == ("infill", "empty") else 0.0).alias(f"{p}_{c}") for task, p in (("alignment", "cha"), ("infill", "fill")) for m, c in names.items()))
    table = row.withColumn("model", F.lit("Task Average")).unionByName(row.withColumn("model", F.lit("m0")))
    return U.compared(found, U.published(table, {"alignment": "cha", "infill": "fill"})).select("task", "measure", "matches")


_WANTED = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'schema' ELSE 'infill' END AS task, o_orderstatus AS condition, 'm' || (o_custkey % 5) AS model, CASE o_orderkey % 2 WHEN 0 THEN 'py_tree' ELSE 'py_fast' END AS metric FROM orders"


@query(f"""
WITH s AS (SELECT DISTINCT task, condition, model, metric FROM ({_WANTED}) WHERE task = 'schema' AND model <> 'm1'), i AS (SELECT DISTINCT condition, model FROM ({_WANTED}) WHERE task = 'infill' AND model <> 'm2')
SELECT o_orderkey, CASE WHEN w.task = 'schema' THEN CASE WHEN s.model IS NULL THEN NULL WHEN w.metric = 'py_tree' THEN 0.5 ELSE 0.25 END WHEN i.model IS NOT NULL THEN 0.75 END::DOUBLE AS score FROM ({_WANTED}) w
LEFT JOIN s ON w.task = s.task AND w.condition = s.condition AND w.model = s.model AND w.metric = s.metric LEFT JOIN i ON w.task = 'infill' AND w.condition = i.condition AND w.model = i.model""")
def summary_lookup(t):
    """Summaries by task, condition, language, model and, for schema, metric."""
    k = F.col("o_orderkey")
    wanted = t("orders").select(k.alias("o_orderkey"), F.when(k % 3 == 0, "schema").otherwise("infill").alias("task"), F.col("o_orderstatus").alias("condition"), F.lit("en").alias("lang"), F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")).alias("model"), F.when(k % 2 == 0, "py_tree").otherwise("py_fast").alias("metric"))
    keys = ["task", "condition", "lang", "model"]
    schema = wanted.where("task = 'schema' and model <> 'm1'").select(*keys, "metric").distinct().withColumn("score", F.when(F.col("metric") == "py_tree", 0.5).otherwise(0.25))
    infill = wanted.where("task = 'infill' and model <> 'm2'").select(*keys).distinct().withColumns({"metric": F.lit("any"), "score": F.lit(0.75)})
    side = schema.unionByName(infill).withColumns({"samples": F.lit(1), "correct": F.lit(1), "total": F.lit(1)})
    return U.summary_for(wanted, side).select("o_orderkey", "score")


_DETAILS = "SELECT 'm' || (o_custkey % 3) AS model, CASE o_orderkey % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'alignment' ELSE 'infill' END AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'filled' ELSE 'empty' END AS condition, (o_orderkey % 7) / 7.0 AS score, o_orderkey % 7 AS correct FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'"


def _details(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t("orders").select(F.concat(F.lit("m"), (c % 3).cast("string")).alias("model"), F.when(k % 3 == 0, "schema").when(k % 3 == 1, "alignment").otherwise("infill").alias("task"), F.when(k % 2 == 0, "filled").otherwise("empty").alias("condition"), F.lit("en").alias("lang"), c.alias("sample_id"), (k % 7 / 7).alias("score"), (k % 7).alias("correct"), F.lit(7).alias("total"))


_TABLE = f"""w AS (SELECT model, task, condition, CASE WHEN task = 'schema' THEN avg(score) ELSE sum(correct) / (7.0 * count(*)) END AS s FROM ({_DETAILS}) GROUP BY model, task, condition),
x AS (SELECT model, {', '.join(f"max(s) FILTER (task = '{t}' AND condition = '{c}') AS {t}_{c}" for t in ('schema', 'alignment', 'infill') for c in ('filled', 'empty'))} FROM w GROUP BY model),
y AS (SELECT model, {', '.join(f"{t}_filled, {t}_empty, {t}_empty - {t}_filled AS {t}_diff" for t in ('schema', 'alignment', 'infill'))} FROM x)"""
_CELLS = [f"{t}_{c}" for t in ("schema", "alignment", "infill") for c in ("filled", "empty", "diff")]


@query(f"""
WITH {_TABLE} SELECT model, {', '.join(f'round({c}, 9) AS {c}' for c in _CELLS)} FROM y UNION ALL SELECT 'Task Average', {', '.join(f'round(avg({c}), 9)' for c in _CELLS)} FROM y""")
def subset_result_table(t):
    """The result table over chosen samples only."""
    chosen = t("customer").where("c_mktsegment <> 'BUILDING'").select(F.lit("en").alias("lang"), F.col("c_custkey").alias("sample_id"))
    out = U.subset_scores(_details(t), chosen)
    return out.select("model", *(F.round(c, 9).alias(c) for c in _CELLS))


@query(f"""
WITH {_TABLE} SELECT round((avg(schema_diff) + avg(alignment_diff) + avg(infill_diff)) / 3, 9) AS global_drop FROM y WHERE model <> 'm0'""")
def global_average_drop(t):
    """The mean drop over tasks; reference models do not count."""
    chosen = t("customer").where("c_mktsegment <> 'BUILDING'").select(F.lit("en").alias("lang"), F.col("c_custkey").alias("sample_id"))
    counted, _ = U.without_references(_details(t), ["m0"])
    return U.global_drop(U.subset_scores(counted, chosen)).withColumn("global_drop", F.round("global_drop", 9))


@query("""
SELECT CASE o_orderkey % 2 WHEN 0 THEN 'schema' ELSE 'infill' END AS task, o_orderstatus AS lang, count(*) FILTER (o_custkey % 5 <> 0) AS built, count(*) FILTER (o_custkey % 5 = 0) AS skipped, count(*) FILTER (o_custkey % 7 = 0) AS warnings, count(*) FILTER (o_custkey % 3 = 0) AS checks_passed, count(*) FILTER (o_custkey % 3 = 1) AS checks_failed FROM orders GROUP BY 1, 2""")
def build_statistics(t):
    c = F.col("o_custkey")
    rows = t("orders").select(F.when(F.col("o_orderkey") % 2 == 0, "schema").otherwise("infill").alias("task"), F.col("o_orderstatus").alias("lang"), F.when(c % 5 == 0, "missing: html").otherwise("ok").alias("status"), F.when(c % 7 == 0, "w").alias("warning"), F.when(c % 3 < 2, c % 3 == 0).alias("self_check"))
    return U.build_stats(rows)


@query("""
SELECT p_brand AS lang, p_type AS condition, count(*) AS images, count(*) FILTER (p_size > 40) AS failed, CAST(min(p_size) AS INTEGER) AS min_width, CAST(max(p_size) AS INTEGER) AS max_width, CAST(min(2 * p_size) AS INTEGER) AS min_height, CAST(max(2 * p_size) AS INTEGER) AS max_height FROM part GROUP BY ALL""")
def image_group_stats(t):
    s = F.col("p_size")
    return U.image_groups(t("part").select(F.col("p_brand").alias("lang"), F.col("p_type").alias("condition"), (s <= 40).alias("ok"), s.cast("int").alias("width"), (2 * s).cast("int").alias("height")))


@query("""
SELECT l_returnflag, count(*) AS pairs, round(avg(abs(l_discount - l_tax)), 9) AS mean_error, round(max(abs(l_discount - l_tax)), 9) AS max_error FROM lineitem GROUP BY 1""")
def metric_validation(t):
    out = U.metric_errors(t("lineitem"), F.col("l_discount"), F.col("l_tax"), ["l_returnflag"])
    return out.select("l_returnflag", "pairs", F.round("mean_error", 9).alias("mean_error"), F.round("max_error", 9).alias("max_error"))


@query("""
WITH l AS (SELECT p_type AS lang, CAST(1 + p_size % 3 AS INTEGER) AS level, count(*) AS tables, CAST(sum(p_size) AS BIGINT) AS si, CAST(sum(p_size % 2) AS BIGINT) AS gi FROM part GROUP BY ALL)
SELECT lang, level, tables, si + gi AS cells, round(100 * tables / sum(tables) OVER w, 6) AS tables_pct, round(100 * (si + gi) / sum(si + gi) OVER w, 6) AS cells_pct, round(100 * si / (si + gi), 6) AS si_pct, round(100 * gi / (si + gi), 6) AS gi_pct FROM l WINDOW w AS (PARTITION BY lang)""")
def dataset_percentages(t):
    s, zero = F.col("p_size"), F.lit(0).cast("long")
    rows = t("part").groupBy(F.col("p_type").alias("lang"), (1 + s % 3).cast("int").alias("level")).agg(F.count("*").alias("tables"), F.sum(s).cast("long").alias("si"), F.sum(s % 2).cast("long").alias("gi"))
    return U.dataset_shares(rows.withColumns({"so": zero, "go": zero, "li": zero})).select("lang", "level", "tables", "cells", "tables_pct", "cells_pct", "si_pct", "gi_pct")


@query("""
SELECT c_custkey, '' AS nothing, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, '') AS segment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""")
def projected_fields(t):
    rows = t("customer").select(F.col("c_custkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), "c_nationkey")
    out = P.projected(rows, ["c_custkey", "nothing", "segment", "c_nationkey"])
    return out.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 3 = 0 OR o_orderkey % 3 = 1) AND o_orderpriority LIKE '1%'""")
def test_record_filter(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(k, F.col("o_orderstatus").alias("task"), F.substring("o_orderpriority", 1, 1).alias("lang"), F.when(k % 3 == 0, "test").when(k % 3 == 2, "train").alias("split"))
    return P.test_records(rows, "F", "1").select("o_orderkey")


@query("""
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 25""")
def first_records(t):
    return P.limited(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 25)


@query("""
SELECT s_suppkey, s_suppkey % 3 = 0 AS image, s_suppkey % 4 < 2 AS open FROM supplier WHERE s_nationkey % 5 IN (1, 3)""")
def model_groups(t):
    k = F.col("s_suppkey")
    rows = t("supplier").select(k, F.concat("s_name", F.when(k % 3 == 0, "-image").otherwise("")).alias("model"), F.when(k % 4 < 2, "Local").otherwise("openai").alias("backend"), F.concat(F.lit("g"), (F.col("s_nationkey") % 5).cast("string")).alias("model_group"))
    return P.models_of(rows, ["g1", "g3"]).select("s_suppkey", P.image_reference(F.col("model")).alias("image"), P.open_source(F.col("backend")).alias("open"))


@query("""
SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 2 = 0 THEN 'a/' || p_partkey END, CASE WHEN p_partkey % 3 = 0 THEN 'b' END) AS message FROM part""")
def missing_files(t):
    k = F.col("p_partkey")
    names = P.missing([(F.concat(F.lit("a/"), k.cast("string")), F.when(k % 2 != 0, "x")), (F.lit("b"), F.when(k % 3 != 0, "x"))])
    return t("part").select("p_partkey", P.missing_message(names).alias("message"))


@query("""
SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'rendered/' || c || '/data_en/' || n_nationkey || '.png' WHEN c = 'filled' THEN 'filled_html/data_en/' || n_nationkey || '.html' ELSE 'html_template/data_en/' || n_nationkey || '.html' END AS path FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'filled' ELSE 'empty' END AS c FROM nation)""")
def model_input_paths(t):
    model = F.when(F.col("n_regionkey") == 0, "m-image").otherwise("m")
    return t("nation").select("n_nationkey", P.input_path(model, F.when(F.col("n_nationkey") % 2 == 0, "filled").otherwise("empty"), F.lit("en"), F.col("n_nationkey")).alias("path"))


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def ordered_unique(t):
    return P.ordered_unique(t("orders"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""
SELECT o_custkey AS sample_id FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def id_union(t):
    return P.union_ids([t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("sample_id")), t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sample_id"))])


@query("""
SELECT c_custkey AS sample_id, c_mktsegment AS html, n AS json FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY'""")
def stage_pairs(t):
    a = t("customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("html"))
    b = t("orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.count("*").alias("json"))
    return P.paired(a, b, ["sample_id"])


@query("""
SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'AUTOMOBILE'""")
def balanced_view(t):
    rows = t("orders").select("o_orderkey", F.lit("en").alias("lang"), F.col("o_custkey").alias("sample_id"))
    chosen = t("customer").where("c_mktsegment = 'AUTOMOBILE'").select(F.lit("en").alias("lang"), F.col("c_custkey").alias("sample_id"))
    n = rows.join(chosen, ["lang", "sample_id"], "left_semi").select("sample_id").distinct().count()
    return P.balanced_view(rows, chosen, n=n).select("o_orderkey")


@query("""
SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 AS INTEGER) AS worker FROM orders""")
def worker_rounds(t):
    return P.rounds(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], [F.col("o_orderkey")], 3).select("o_orderkey", "worker")


@query("""
SELECT o_orderkey, o_orderkey % 5 = 0 OR 100 + o_custkey % 20 < greatest(105 + o_orderkey % 10, 108) AS stale, o_orderkey % 5 = 0 AS missing_only FROM orders""")
def stale_renders(t):
    k = F.col("o_orderkey")
    out, src, script = F.when(k % 5 != 0, 100 + F.col("o_custkey") % 20), 105 + k % 10, F.lit(108)
    return t("orders").select("o_orderkey", K.should_render(out, src, script).alias("stale"), K.should_render(out, src, script, "missing-only").alias("missing_only"))


@query("""
SELECT c_custkey AS sample_id, c_mktsegment = 'BUILDING' AS moved, CASE WHEN c_mktsegment = 'BUILDING' THEN 'old' ELSE 'new' END AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')""")
def state_migration(t):
    k = F.col("c_custkey")
    row = lambda w, place, v: t("customer").where(w).select(k.alias("sample_id"), F.lit(place).alias("place"), F.lit(v).alias("value"))
    states = row("c_mktsegment in ('BUILDING', 'MACHINERY')", "legacy", "old").union(row("c_mktsegment in ('MACHINERY', 'FURNITURE')", "cache", "new"))
    return K.migrated(states, ["sample_id"]).select("sample_id", "moved", "value")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 4 THEN l_linenumber = 1 ELSE l_returnflag = 'R' END AS is_group FROM lineitem""")
def verdict_overlay(t):
    """A reviewer's verdict by position counts before the heuristic."""
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = t("lineitem").select(*key, (F.col("l_returnflag") == "R").alias("heuristic"))
    verdicts = t("lineitem").where("l_linenumber < 4").select(*key, (F.col("l_linenumber") == 1).alias("verdict")).distinct()
    return H.with_verdicts(rows, verdicts, key, "heuristic").select(*key, F.col("heuristic").alias("is_group"))


@query("""
SELECT doc_id, k, first_at FROM (SELECT doc_id, lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS k, min(i) AS first_at FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY ALL) WHERE k <> ''""")
def placeholder_dedup(t):
    """Of equal keys of a document the first stays."""
    words = t("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    keyed = words.select("doc_id", F.lower(F.regexp_replace("w", "[^A-Za-z]", "")).alias("k"), (F.col("i") + 1).cast("long").alias("first_at")).where("k <> ''")
    return G.first_by(keyed, ["doc_id", "k"], [F.col("first_at")])


@query(f"""
SELECT doc_id, sha256({"'" + J.IMAGE_PROMPTS['infill'].replace('{action}', J.IMAGE_ACTION['filled']).replace("'", "''").replace('{language}', "' || CASE WHEN lang = 'zh' THEN 'Keep Chinese labels in Chinese.' ELSE 'Keep English labels in English.' END || '").replace('{context}', "' || text || '") + "'"}) AS infill,
  sha256({"'" + J.IMAGE_PROMPTS['schema'].replace('{source}', J.IMAGE_SOURCE['empty']).replace('{values}', J.IMAGE_VALUES['empty']).replace("'", "''").replace('{language}', "' || CASE WHEN lang = 'zh' THEN 'Keep Chinese labels in Chinese.' ELSE 'Keep English labels in English.' END || '") + "'"}) AS schema FROM documents""")
def image_prompts(t):
    return t("documents").select("doc_id", F.sha2(J.image_prompt("infill", "filled", F.col("lang"), F.col("text")), 256).alias("infill"), F.sha2(J.image_prompt("schema", "empty", F.col("lang")), 256).alias("schema"))


@query("""
SELECT n_nationkey AS sample_id, CASE WHEN n_nationkey % 4 = 0 AND n_nationkey % 3 = 0 THEN 'missing: html_empty, json_empty' WHEN n_nationkey % 4 = 0 THEN 'missing: html_empty' WHEN n_nationkey % 3 = 0 THEN 'missing: json_empty' ELSE 'ok' END AS status,
  CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0 THEN '{"name":"' || n_name || '"}' END AS completion, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0 THEN 3 END::INTEGER AS turns FROM nation""")
def training_samples(t):
    k = F.col("n_nationkey")
    none = F.lit(None).cast("string")
    src = t("nation").select(F.lit("en").alias("lang"), k.alias("sample_id"), F.when(k % 4 != 0, F.concat(F.lit("<p>"), "n_name", F.lit("</p>"))).alias("html_empty"), F.when(k % 3 != 0, F.concat(F.to_json(F.struct(F.col("n_name").alias("name"))), F.lit("\n"))).alias("json_empty"), none.alias("placeholder_html"), none.alias("html_filled"), none.alias("context"))
    out = J.training_samples(src, "schema")
    return out.select("sample_id", "status", "completion", F.when(F.col("messages").isNotNull(), F.size("messages")).alias("turns"))


@query("""
SELECT doc_id, sha256('HTML:' || chr(10) || trim(source) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '相关内容:' || chr(10) || trim(lang) ELSE '' END) AS input FROM documents""")
def instruction_inputs(t):
    task = F.when(F.col("doc_id") % 2 == 0, "infill").otherwise("schema")
    return t("documents").select("doc_id", F.sha2(J.instruction_input(task, F.col("source"), F.col("lang")), 256).alias("input"))


# The order of hashes that splits follow: 60 bits of a seeded digest.
SPLIT_SQL = """(SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(sha256('3407:' || doc_id), 1, 15))::BIGINT, ('0x' || substr(sha256('3407:' || doc_id), 16, 15))::BIGINT)
  <= greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS test FROM (SELECT DISTINCT doc_id FROM documents))"""


@query(f"""
SELECT lang, 2 * count(*) AS rows, 2 * count(*) FILTER (test) AS test, CAST(0 AS BIGINT) AS both_splits FROM documents JOIN {SPLIT_SQL} USING (doc_id) GROUP BY lang""")
def split_is_a_partition(t):
    """Every row has one split, and copies of an id share theirs."""
    rows = t("documents").select("doc_id", "lang").union(t("documents").select("doc_id", "lang"))
    out = J.split(rows, "doc_id").groupBy("doc_id", "lang").agg(F.count_distinct("split").alias("n"), F.count("*").alias("rows"), F.count_if(F.col("split") == "test").alias("test"))
    return out.groupBy("lang").agg(F.sum("rows").alias("rows"), F.sum("test").alias("test"), F.count_if(F.col("n") > 1).alias("both_splits"))


@query(f"""
SELECT doc_id, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM {SPLIT_SQL}""")
def split_by_threshold(t):
    """The test ids are those below a threshold that is found by counting, not by sorting."""
    return J.split(t("documents").select("doc_id"), "doc_id")


@query("""
SELECT CAST(least(greatest(1, round_even(count(*) * 0.2, 0)), count(*)) AS BIGINT) AS test, CAST(count(*) - least(greatest(1, round_even(count(*) * 0.2, 0)), count(*)) AS BIGINT) AS train FROM documents""")
def split_sizes(t):
    out = J.split(t("documents").select("doc_id"), "doc_id")
    return out.agg(F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split") == "train").alias("train"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus WHEN o_orderpriority <> '5-LOW' THEN 'default' END AS gold, CAST(o_orderkey AS VARCHAR) AS gold_path FROM orders""")
def gold_resolution(t):
    """The recorded file where it exists, else the stage's."""
    from ..sources.files import gold_of

    k = F.col("o_orderkey")
    records = t("orders").select(k.alias("sample_id"), F.lit("en").alias("lang"), k.cast("string").alias("gold_path"))
    recorded = t("orders").where("o_orderstatus <> 'F'").select(k.cast("string").alias("gold_path"), F.col("o_orderstatus").alias("content"))
    default = t("orders").where("o_orderpriority <> '5-LOW'").select(F.lit("en").alias("lang"), k.alias("sample_id"), F.lit("default").alias("content"))
    return gold_of(records, recorded, default).select(F.col("sample_id").alias("o_orderkey"), "gold", "gold_path")


@query("""
WITH l AS (SELECT DISTINCT lower(regexp_replace(p_type, ' ', '', 'g')) AS label FROM part)
SELECT p_partkey, label FROM (SELECT p_partkey, lower(regexp_replace(p_name || p_type, ' ', '', 'g')) AS cell FROM part) JOIN l ON contains(cell, label)""")
def label_index_join(t):
    """Labels in cell texts, met by the label's rarest run of three characters."""
    bare = lambda c: F.lower(F.regexp_replace(c, " ", ""))
    cells = t("part").select("p_partkey", bare(F.concat("p_name", "p_type")).alias("cell"))
    return O.containing(cells, t("part").select(bare("p_type").alias("label")).distinct(), ["p_partkey"], "cell", "label")


@query("""
SELECT l_returnflag AS task, l_linestatus AS model, CAST(sum(l_linenumber) AS BIGINT) AS correct, CAST(sum(l_suppkey % 5) AS BIGINT) AS total FROM lineitem GROUP BY ALL""")
def column_sums(t):
    w = t("lineitem").select(F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("correct"), (F.col("l_suppkey") % 5).alias("total"))
    out = A.with_both(w.withColumn("lang", F.lit("en")), ["task", "model"], ["correct", "total"])
    return out.where("lang = 'both'").select("task", "model", "correct", "total")


@query(r"""
WITH l AS (SELECT p_name AS label FROM part UNION SELECT unnest(regexp_extract_all(text, '[a-z]{4,}')) FROM benchmark)
SELECT doc_id, label FROM documents JOIN l ON contains(text, label)""")
def labels_in_documents(t):
    """Part names and words of the benchmark in whole documents, which one automaton reads once."""
    words = t("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("label"))
    labels = t("part").select(F.col("p_name").alias("label")).union(words)
    return O.containing(t("documents").select("doc_id", "text"), labels, ["doc_id"], "text", "label")
