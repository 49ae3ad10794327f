"""The evaluation workflow over samples rendered from customers and orders.

A sample is a customer; its forms, context and metadata are made from its own
columns, so that counts and states differ from row to row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import coverage as G
from ..operators import evaluate as E
from ..operators import html as H
from ..operators import selection as P
from ..operators import tuning as T
from ..operators import workflow as W
from ..operators.clustered import dealt
from .registry import query

def _k():
    return F.col("c_custkey")


def _rows(cells):
    """A table of one row a field: the label and the given cell."""
    return H.as_table(F.transform(cells, lambda x: F.array(F.concat(F.lit("<td>"), x["label"], F.lit("</td>")), F.concat(F.lit("<td>"), x["value"], F.lit("</td>")))))


def _sources(t):
    """Samples of 0 to 3 fields (c_custkey % 4): the marked, filled and empty form,
    metadata with one target a field, context; by key one source or another is missing."""
    i = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda x: x)
    some = F.filter(i, lambda x: x < _k() % 4)
    cells = lambda f: _rows(F.concat(F.array(F.struct(F.lit("Form").alias("label"), F.col("c_name").alias("value"))), F.transform(some, lambda x: F.struct(F.concat(F.lit("Field"), x.cast("string")).alias("label"), f(x).alias("value")))))
    marked = cells(lambda x: F.concat(F.lit("[Field"), x.cast("string"), F.lit("]")))
    filled = cells(lambda x: F.concat(F.lit("v"), x.cast("string"), F.lit(" "), F.col("c_mktsegment")))
    item = lambda x: F.struct(F.concat(F.lit("Field"), x.cast("string")).alias("key"), F.struct((x + 1).alias("row"), F.lit(0).alias("col")).alias("label_info"), F.struct(F.lit(0).alias("rows"), F.lit(1).alias("cols")).alias("placeholder_offset"), F.when(x == 1, "LI").otherwise("SI").alias("type"))
    meta = F.to_json(F.transform(some, item))
    gold = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return dealt(t("customer"), "c_custkey").select(
        F.when(_k() % 2 == 0, "en").otherwise("zh").alias("lang"), _k().alias("sample_id"), cells(lambda x: F.lit("")).alias("html_empty"), filled.alias("html_filled"),
        F.when(_k() % 10 != 0, gold).alias("json_empty"), gold.alias("json_filled"), F.when(_k() % 9 == 0, F.lit("{")).otherwise(meta).alias("meta"),
        F.when(_k() % 7 != 0, marked).alias("placeholder_html"), F.when(_k() % 5 != 0, F.col("c_name")).alias("context"),
    )


_ELIGIBLE = """
SELECT lang, sample_id, task, n > 0 AS eligible, CAST(n AS BIGINT) AS target_count, CASE WHEN issue <> '' THEN 'source_error' WHEN n > 0 THEN 'eligible' ELSE 'ineligible_no_targets' END AS source_status, issue AS source_issue FROM (
SELECT *, CASE WHEN issue <> '' THEN 0 WHEN task = 'schema' THEN 1 ELSE k % 4 END AS n FROM (
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, c_custkey AS sample_id, c_custkey AS k, task,
  CASE task WHEN 'schema' THEN CASE WHEN c_custkey % 10 = 0 THEN 'json_empty' ELSE '' END
  WHEN 'alignment' THEN CASE WHEN c_custkey % 7 = 0 THEN 'placeholder_html' WHEN c_custkey % 9 = 0 THEN 'invalid alignment source' ELSE '' END
  ELSE concat_ws('; ', CASE WHEN c_custkey % 5 = 0 THEN 'context' END, CASE WHEN c_custkey % 7 = 0 THEN 'placeholder_html' END) END AS issue
FROM customer, (VALUES ('schema'), ('alignment'), ('infill')) v(task)))"""


@query(_ELIGIBLE)
def source_eligibility(t):
    """Each task's targets, counted from the sources, and what is missing."""
    return W.eligibility(_sources(t))


def _documents(t):
    """Predictions of model a-image and b for infill: by key and condition missing, broken, empty or good."""
    models = t("region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "a-image").otherwise("b").alias("model"))
    rows = t("customer").where("c_mktsegment <> 'BUILDING'").crossJoin(F.broadcast(models)).withColumn("condition", F.explode(F.array(F.lit("filled"), F.lit("empty"))))  # two rows
    body = F.when(_k() % 4 == 1, F.lit("{")).when(_k() % 4 == 2, F.lit('{"raw_response": " "}')).otherwise(F.to_json(F.struct(F.col("c_name").alias("raw_response"))))
    return models, rows.select("model", F.lit("infill").alias("task"), F.when(_k() % 2 == 0, "en").otherwise("zh").alias("lang"), "condition", _k().alias("sample_id"), body.alias("document"))


_MANIFEST = f"""
WITH e AS (SELECT * FROM ({_ELIGIBLE}) WHERE task = 'infill' AND eligible)
SELECT model, condition, sample_id, target_count, prediction_status, prediction_status <> 'ready' AS retry_recommended, input_path FROM (
SELECT model, condition, sample_id, target_count,
  CASE WHEN model = 'a-image' THEN 'rendered/' || condition WHEN condition = 'filled' THEN 'filled_html' ELSE 'html_template' END || '/data_' || lang || '/' || sample_id || CASE WHEN model = 'a-image' THEN '.png' ELSE '.html' END AS input_path,
  CASE WHEN model = 'a-image' AND c_mktsegment = 'MACHINERY' THEN 'missing_input' WHEN c_mktsegment = 'BUILDING' THEN 'missing' WHEN sample_id % 4 = 1 THEN 'invalid_json' WHEN sample_id % 4 = 2 THEN 'empty_response' ELSE 'ready' END AS prediction_status
FROM e JOIN customer ON c_custkey = sample_id, (VALUES ('a-image'), ('b')) m(model), (VALUES ('filled'), ('empty')) c(condition))"""


def _manifest(t):
    models, documents = _documents(t)
    lang = F.when(_k() % 2 == 0, "en").otherwise("zh")
    path = lambda m, c: P.input_path(F.lit(m), F.lit(c), lang, _k()).alias("path")
    inputs = [t("customer").where("c_mktsegment <> 'MACHINERY'" if m == "a-image" else "true").select(path(m, c)) for m in ("a-image", "b") for c in ("filled", "empty")]
    there = inputs[0]
    for i in inputs[1:]:
        there = there.union(i)
    return W.evaluation_manifest(W.eligibility(_sources(t), ["infill"]), models, documents, there)


@query(_MANIFEST)
def prediction_manifest(t):
    return _manifest(t).select("model", "condition", "sample_id", "target_count", "prediction_status", "retry_recommended", "input_path")


@query(f"""
SELECT model, condition, count(*) AS expected, count(*) FILTER (prediction_status = 'ready') AS ready FROM ({_MANIFEST}) GROUP BY ALL""")
def manifest_coverage(t):
    return G.coverage(_manifest(t), ["model", "condition"], F.col("prediction_status") == "ready")


@query("""
WITH s AS (SELECT 'en' AS lang, n_nationkey AS sample_id FROM nation), m AS (SELECT r_name AS model FROM region), p AS (SELECT n_nationkey AS sample_id, r_name AS model FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT s.sample_id, m.model, CASE WHEN p.model IS NULL THEN 'missing' ELSE 'ready' END AS status FROM s CROSS JOIN m LEFT JOIN p ON p.sample_id = s.sample_id AND p.model = m.model""")
def job_manifest(t):
    """Every model for every sample, with the state of what there is."""
    done = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("sample_id"), F.col("r_name").alias("model"), F.lit("ready").alias("status"))
    return G.manifest(t("nation").select(F.col("n_nationkey").alias("sample_id")), [t("region").select(F.col("r_name").alias("model"))], done, ["sample_id", "model"]).select("sample_id", "model", "status")


@query("""
WITH a AS (SELECT o_custkey AS sample_id, o_orderstatus AS task, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL), b AS (SELECT DISTINCT o_custkey AS sample_id, o_orderstatus AS task FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT sample_id, task, CASE WHEN n IS NULL THEN 'not prepared' WHEN b.task IS NULL THEN 'not a job' ELSE 'repeated' END AS difference FROM a FULL JOIN b USING (sample_id, task) WHERE n IS NULL OR b.task IS NULL OR n > 1""".replace("a FULL JOIN b USING (sample_id, task)", "(SELECT a.n, coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.task, b.task) AS task, b.task AS bt FROM a FULL JOIN b ON a.sample_id = b.sample_id AND a.task = b.task)").replace("b.task IS NULL", "bt IS NULL"))
def prepared_job_set(t):
    rows = lambda w: t("orders").where(w).select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("task"))
    return W.job_set_differences(rows("o_orderpriority <> '1-URGENT'"), rows("o_orderpriority <> '5-LOW'"), ["sample_id", "task"])


_STATES = "CASE WHEN k % 4 = 0 THEN 'ineligible_no_targets' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'not_run' WHEN k % 11 = 0 THEN 'source_mismatch' WHEN k % 17 = 0 THEN 'prediction_error' WHEN k % 19 = 0 THEN 'transport_error' WHEN k % 7 = 0 THEN 'source_error' WHEN k % 23 = 0 THEN 'model_format_failure' ELSE 'scored' END"


def _evaluated(t):
    """Infill jobs whose predictions fill in all fields but, for every third sample, the first."""
    src = _sources(t)
    jobs = src.select("lang", "sample_id", F.lit("m").alias("model"), F.lit("infill").alias("task"), F.lit("empty").alias("condition"), F.when(F.col("sample_id") % 4 == 0, "ineligible_no_targets").otherwise("ready").alias("status"), F.lit("e1").alias("evidence"))
    s = F.col("sample_id")
    answer = F.when(s % 23 == 0, "").when(s % 3 == 0, F.replace("html_filled", F.lit("v0 "), F.lit("w0 "))).otherwise(F.col("html_filled"))
    document = F.to_json(F.struct(F.lit("m").alias("model"), s, "lang", F.lit("infill").alias("task"), F.when(s % 17 == 0, "filled").otherwise("empty").alias("condition"), F.when(s % 11 == 0, "old").otherwise("e1").alias("evidence"), F.when(s % 19 == 0, "transport_error").alias("status"), answer.alias("raw_response")))
    predictions = src.where("get_json_object(json_filled, '$.segment') <> 'HOUSEHOLD'").select("lang", "sample_id", F.lit("m").alias("model"), F.lit("infill").alias("task"), F.lit("empty").alias("condition"), document.alias("document"))
    return E.evaluated(jobs, predictions, src)


@query(f"""
SELECT lang, sample_id, state, CASE state WHEN 'scored' THEN round(CAST(n - bad AS DOUBLE) / n, 9) WHEN 'model_format_failure' THEN 0.0 END AS score, CASE state WHEN 'scored' THEN n - bad WHEN 'model_format_failure' THEN 0 END::INTEGER AS correct,
  CASE WHEN state IN ('scored', 'model_format_failure') THEN n END::INTEGER AS total FROM (
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, c_custkey AS sample_id, c_custkey AS k, c_custkey % 4 AS n, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS bad, {_STATES} AS state FROM customer)""")
def evaluated_jobs(t):
    return _evaluated(t).select("lang", "sample_id", "state", F.round("score", 9).alias("score"), "correct", "total")


_TASKS = """
SELECT lang, sample_id, task, condition, state, CASE state WHEN 'scored' THEN round(CASE task WHEN 'schema' THEN CASE WHEN bad THEN 0.9 ELSE 1.0 END::DOUBLE ELSE (n - CASE WHEN bad THEN 1 ELSE 0 END)::DOUBLE / n END, 9) WHEN 'model_format_failure' THEN 0.0 END AS score,
  CASE WHEN task = 'schema' THEN NULL WHEN state = 'scored' THEN n - CASE WHEN bad THEN 1 ELSE 0 END WHEN state = 'model_format_failure' THEN 0 END::INTEGER AS correct, CASE WHEN prepared <> 'source_error' THEN n END::INTEGER AS total FROM (
SELECT *, CASE WHEN prepared <> 'ready' THEN prepared WHEN c_mktsegment = 'HOUSEHOLD' THEN 'not_run' WHEN k % 37 = 0 OR k % 11 = 0 THEN 'source_mismatch' WHEN k % 13 = 0 OR k % 17 = 0 THEN 'prediction_error' WHEN k % 19 = 0 THEN 'transport_error'
  WHEN k % 23 = 0 THEN 'prediction_error' WHEN k % 29 = 0 OR k % 31 = 0 THEN 'model_format_failure' ELSE 'scored' END AS state FROM (
SELECT *, CASE WHEN lost THEN 'source_error' WHEN n = 0 THEN 'ineligible_no_targets' ELSE 'ready' END AS prepared FROM (
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, c_custkey AS sample_id, c_custkey AS k, task, condition, c_mktsegment, c_custkey % 3 = 0 AS bad, CASE task WHEN 'schema' THEN 1 ELSE c_custkey % 4 END AS n,
  CASE task WHEN 'schema' THEN condition = 'empty' AND c_custkey % 10 = 0 WHEN 'alignment' THEN c_custkey % 9 = 0 OR c_custkey % 7 = 0 ELSE c_custkey % 5 = 0 OR c_custkey % 7 = 0 END AS lost
FROM customer, (VALUES ('schema'), ('alignment'), ('infill')) t(task), (VALUES ('empty'), ('filled')) c(condition))))"""


def _answers(src):
    """A prediction for each job of all tasks, what is wrong with it being told by its key."""
    jobs = E.prepared(src, "org/m-1")
    s = F.col("sample_id")
    request = F.parse_json(E.request())
    other = F.parse_json(F.to_json(F.struct(*(F.lit(99).alias(c) if c == "target_count" else F.col(c) for c in E.EVIDENCE)), {"ignoreNullFields": "false"}))
    wrong = s % 3 == 0
    schema = F.when(wrong, F.replace("json_filled", F.concat(F.lit('"segment":"'), F.get_json_object("json_filled", "$.segment")), F.lit('"segment":"OTHER'))).otherwise(F.col("json_filled"))
    inputs = H.inputs_for_markers(F.when(F.col("task") == "alignment", F.col("placeholder_html")))
    alignment = F.when(wrong, F.regexp_replace(inputs, '<input[^>]*name="Field0"[^>]*>', "")).otherwise(inputs)
    infill = F.when(wrong, F.replace("html_filled", F.lit("v0 "), F.lit("w0 "))).otherwise(F.col("html_filled"))
    answer = F.when(F.col("task") == "schema", schema).when(F.col("task") == "alignment", alignment).otherwise(infill)
    text = F.when(s % 31 == 0, "<think>so</think> ").otherwise(F.concat(F.lit("<think>so</think>"), answer))
    said = F.to_json(F.struct(
        F.when(s % 11 == 0, other).otherwise(request).alias("request"), F.when(s % 13 == 0, "m2").otherwise(F.col("model")).alias("model"), F.when(s % 17 == 0, F.parse_json(F.lit("true"))).otherwise(F.parse_json(s.cast("string"))).alias("sample_id"),
        F.when(s % 19 == 0, "transport_error").when(s % 23 == 0, "odd").otherwise("completed").alias("status"), F.lit("").alias("error"), F.when(s % 29 == 0, F.parse_json(F.lit("5"))).otherwise(F.variant_get(F.parse_json(F.to_json(F.struct(text.alias("t")))), "$.t", "variant")).alias("raw_response"),
    ))
    rows = jobs.where("status = 'ready'").join(src, ["lang", "sample_id"]).where("get_json_object(json_filled, '$.segment') <> 'HOUSEHOLD'")
    return jobs, rows.select(*E.KEYS, F.when(s % 37 == 0, "[1]").otherwise(said).alias("document"))


@query(_TASKS)
def evaluated_tasks(t):
    """Jobs of all tasks and conditions through one ladder, their predictions repeating the whole request."""
    src = _sources(t)
    jobs, predictions = _answers(src)
    return E.evaluated(jobs, predictions, src).select("lang", "sample_id", "task", "condition", "state", F.round("score", 9).alias("score"), "correct", "total")


@query("""
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, c_custkey AS sample_id, CAST(0 AS INTEGER) AS correct, type, n AS total FROM (
SELECT c_custkey, 'LI' AS type, CAST(1 AS BIGINT) AS n FROM customer WHERE c_custkey % 4 >= 2 AND c_custkey % 9 <> 0
UNION ALL SELECT c_custkey, 'SI', CAST(CASE WHEN c_custkey % 4 = 3 THEN 2 ELSE 1 END AS BIGINT) FROM customer WHERE c_custkey % 4 >= 1 AND c_custkey % 9 <> 0)""")
def zero_alignment_types(t):
    """What a sample without a usable prediction counts, by type."""
    return W.zero_alignment(_sources(t))


@query("""
SELECT e.event_id, 0.0::DOUBLE AS similarity, CASE event_id % 3 WHEN 0 THEN 'jedi_cpp' WHEN 1 THEN 'jedi_py:tree_edit' ELSE 'jedi_py:fast_structural' END AS metric, event_type AS pred_status FROM events e""")
def zero_similarity_rows(t):
    k = F.col("event_id") % 3
    zero = F.when(k == 0, W.zero_similarity(F.col("event_type"), "cpp")).when(k == 1, W.zero_similarity(F.col("event_type"), "py_tree")).otherwise(W.zero_similarity(F.col("event_type"), "py_fast"))
    return t("events").select("event_id", zero.alias("z")).select("event_id", "z.similarity", "z.metric", "z.pred_status")


@query("""
WITH b AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%'),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM b)
SELECT o_custkey, c AS invalid_count, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM r WHERE n <= 50 GROUP BY o_custkey, c""")
def invalid_prediction_ids(t):
    p = F.col("o_orderpriority")
    rows = t("orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("sample_id"), F.when(F.startswith(p, F.lit("1")), "ok").when(F.startswith(p, F.lit("2")), " repaired ").otherwise(p).alias("pred_status"))
    out = W.invalid_predictions(rows, ["o_custkey"])
    return out.select("o_custkey", "invalid_count", F.array_join(F.transform("preview", lambda x: x.cast("string")), ",").alias("ids"))


@query("""
SELECT 'm' || o_custkey AS model, o_orderstatus AS condition, CAST(o_orderkey AS VARCHAR) AS lang, CASE WHEN o_orderkey % 5 = 0 THEN 'legacy_v1' ELSE 'unversioned' END AS actual FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)""")
def version_mismatch(t):
    k = F.col("o_orderkey")
    version = F.when(k % 5 == 0, "legacy_v1").when(k % 7 != 0, W.MATCHER)
    rows = t("orders").select(F.when(k % 3 == 0, "schema").otherwise("infill").alias("task"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("model"), F.col("o_orderstatus").alias("condition"), k.cast("string").alias("lang"), version.alias("metric_version"))
    return W.version_mismatches(rows)


@query("""
SELECT r_name AS task, n_name AS lang FROM region CROSS JOIN nation ANTI JOIN (SELECT r_name AS rn, n_name AS nn FROM nation JOIN region ON r_regionkey = n_regionkey) s ON rn = r_name AND nn = n_name""")
def missing_summaries(t):
    done = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("task"), F.col("n_name").alias("lang"))
    return W.missing_summaries(done, [t("region").select(F.col("r_name").alias("task")), t("nation").select(F.col("n_name").alias("lang"))], ["task", "lang"])


@query("""
WITH r AS (SELECT o_orderpriority AS task, o_orderstatus AS lang, o_orderkey AS id, o_totalprice >= 50000 AND o_custkey % 5 <> 0 AS has FROM orders),
m AS (SELECT task, lang, id, row_number() OVER (PARTITION BY task, lang ORDER BY id) AS n FROM r WHERE NOT has)
SELECT 'tuned' AS model, r.task, 'empty' AS condition, r.lang, count(*) AS expected_count, count(*) FILTER (has) AS prediction_count, count(*) FILTER (NOT has) AS missing_count, min(id) AS first_id, max(id) AS last_id,
  coalesce((SELECT string_agg(CAST(m.id AS VARCHAR), ' ' ORDER BY m.id) FROM m WHERE n <= 50 AND m.task = r.task AND m.lang = r.lang), '') AS missing_ids FROM r GROUP BY r.task, r.lang""")
def checkpoint_coverage(t):
    rows = t("orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("lang"), F.col("o_orderkey").alias("sample_id"), "o_custkey", "o_totalprice")
    predictions = rows.where("o_totalprice >= 50000").select("task", "lang", "sample_id", F.when(F.col("o_custkey") % 5 == 0, "empty_response").otherwise("ready").alias("status"))
    return W.checkpoint_coverage(rows, predictions, "tuned")


_SPLIT = "SELECT CASE o_orderstatus WHEN 'F' THEN 'schema' WHEN 'O' THEN 'infill' ELSE 'alignment' END AS task, o_orderpriority AS lang, o_orderkey AS id, o_totalprice >= 100000 AS has, (o_orderkey % 5) / 5.0 AS score, o_orderkey % 5 AS correct FROM orders"


@query(f"""
WITH r AS ({_SPLIT}), s AS (SELECT 'zero' AS policy, * FROM r UNION ALL SELECT 'skip', * FROM r WHERE has), n AS (SELECT task, lang, count(*) AS expected, count(*) FILTER (NOT has) AS missing FROM r GROUP BY ALL)
SELECT policy, task, lang, expected, missing, round(CASE WHEN task = 'schema' THEN avg(CASE WHEN has THEN score ELSE 0 END) ELSE sum(CASE WHEN has THEN correct ELSE 0 END) / sum(5.0) END, 9) AS score FROM s JOIN n USING (task, lang) GROUP BY policy, task, lang, expected, missing""")
def checkpoint_scores(t):
    """Test records under both policies for missing predictions."""
    k = F.col("o_orderkey")
    task = F.when(F.col("o_orderstatus") == "F", "schema").when(F.col("o_orderstatus") == "O", "infill").otherwise("alignment")
    rows = t("orders").select(task.alias("task"), F.col("o_orderpriority").alias("lang"), k.alias("sample_id"), F.lit(5).alias("target_count"), "o_totalprice")
    details = rows.where("o_totalprice >= 100000").select("task", "lang", "sample_id", (F.col("sample_id") % 5 / 5).alias("score"), (F.col("sample_id") % 5).alias("correct"), F.lit(5).alias("total"))
    out = [W.split_scores(rows.drop("o_totalprice"), details, p).withColumn("policy", F.lit(p)) for p in ("zero", "skip")]
    return out[0].unionByName(out[1]).withColumn("score", F.round("score", 9))


@query("""
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, c_custkey AS sample_id, CAST(c_custkey % 4 AS INTEGER) AS correct, CAST(c_custkey % 4 AS INTEGER) AS total, c_custkey % 4 > 0 AS ok FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 9 <> 0""")
def alignment_self_check(t):
    """Gold forms that find all their own targets; one without targets does not pass."""
    return W.alignment_self_check(_sources(t).where("placeholder_html is not null and meta <> '{'"))


# A tuned model's name by key: what stands around the base's name, the method, and whether the base is found.
_TUNED = """(VALUES (0, '', '_InfillFT', 'FT', true), (1, '', '-infillft-v2', 'FT', true), (2, 'finetuned_', '-seed=17', 'FT', true), (3, '', '_checkpoint', 'FT', true), (4, 'schema en ', '-checkpoint-500', 'FT', true),
  (5, '', '-infill more-words', 'FT', true), (6, '', '-QA', 'QA', true), (7, ' Alignment_ZH_', ' QA _v3', 'QA', true), (8, '', '-Repair', 'FT', true), (9, 'finetuned_', '_InfillFT_v2_checkpoint_5_seed=3-repair', 'FT', true),
  (10, '', '-Checkpoint-5', 'FT', false), (11, '', '-lora-v2', 'FT', false), (12, '', '-qa', 'FT', false), (13, '', '', 'FT', true), (14, '', ' _ InfillFT', 'FT', true)) f(k, head, tail, method, known)"""


def _tuned_names(t):
    import re

    forms = re.findall(r"\((\d+), '([^']*)', '([^']*)'", _TUNED)
    part = lambda i: F.element_at(F.array(*(F.lit(f[i]) for f in forms)), (_k() % len(forms) + 1).cast("int"))
    base = F.concat(F.when(_k() % 2 == 0, "Org/Base-").otherwise("Org_Base_"), (_k() % 7).cast("string"))
    return t("customer").select(_k().alias("c_custkey"), F.concat(part(1), base, part(2)).alias("ft_model"))


@query(f"""
SELECT c_custkey, head || CASE WHEN c_custkey % 2 = 0 THEN 'Org/Base-' ELSE 'Org_Base_' END || (c_custkey % 7) || tail AS ft_model, 'Org/Base-' || (c_custkey % 7) AS base_model, method AS comparison_method
FROM customer JOIN {_TUNED} ON k = c_custkey % 15 WHERE known AND c_custkey % 7 < 5""")
def base_tuned_pairs(t):
    """Tuned models of every form of name with their base, which is known by its name or its folder's."""
    bases = t("region").select(F.concat(F.lit("Org/Base-"), F.col("r_regionkey").cast("string")).alias("base_model"), F.col("r_regionkey").alias("rank"))
    tuned = _tuned_names(t)
    return T.model_pairs(tuned.select("ft_model").distinct(), bases, with_qa=True).join(tuned, "ft_model").select("c_custkey", "ft_model", "base_model", "comparison_method")


@query("""
SELECT 'Org/Base_' || n_regionkey || CASE n_nationkey % 3 WHEN 0 THEN '_InfillFT' WHEN 1 THEN '' ELSE '_QA_v2' END AS model FROM nation GROUP BY ALL""")
def discovered_tuned_models(t):
    """Prediction folders of several forms that stand for one model each."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    name = F.concat(F.when(k % 2 == 0, "infill zh ").otherwise(" "), F.lit("Org/Base _ "), r, F.when(k % 3 == 0, " InfillFT").when(k % 3 == 1, "").otherwise(" _QA_ v2 "))
    return T.discovered(t("nation").select(name.alias("name")))


@query("""
SELECT c_custkey AS sample_id, CASE c_custkey % 3 WHEN 0 THEN 'Org_M_' || c_custkey || '_QA' WHEN 1 THEN 'Org_M ' || c_custkey || ' QA' ELSE 'Org_M_' || c_custkey || '_QA' END AS dir FROM customer""")
def prediction_dir_resolution(t):
    """The folder of just that name if it has the file, else the first whose name has the same form, else the name."""
    k, n = _k() % 3, _k().cast("string")
    form = lambda a, b: F.concat(F.lit("Org_M"), F.lit(a), n, F.lit(b))
    keys = [F.lit("infill").alias("task"), F.lit("empty").alias("condition"), (_k() % 2).cast("string").alias("lang")]
    # The sample's own file; one of other samples in two folders of the same form; none.
    there = F.when(k == 0, F.array(F.struct(form("_", "_QA").alias("name"), _k().alias("sample_id")), F.struct(form(" ", " QA").alias("name"), _k().alias("sample_id"))))
    there = there.when(k == 1, F.array(F.struct(form("_", "_QA").alias("name"), F.lit(-1).cast("bigint").alias("sample_id")), F.struct(form(" ", " QA").alias("name"), _k().alias("sample_id"))))
    files = t("customer").select(*keys, F.inline(F.coalesce(there, F.array(F.struct(F.lit("Other").alias("name"), _k().alias("sample_id"))))))
    records = t("customer").select(*keys, _k().alias("sample_id"), form("_", "_QA").alias("model"))
    return T.resolved_dirs(records, files, F.col("model")).select("sample_id", "dir")


@query("""
SELECT c_nationkey AS base, comparison_method, CASE comparison_method WHEN 'FT' THEN 'm' || max(c_custkey) || '_InfillFT_' || max(c_custkey) ELSE 'm' || max(c_custkey) || ' QA v' || max(c_custkey) END AS ft_model
FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'FT' ELSE 'QA' END AS comparison_method FROM customer) GROUP BY c_nationkey, comparison_method""")
def latest_tuned_variants(t):
    """Of each base and method the tuned model of the highest version."""
    n = _k().cast("string")
    qa = _k() % 2 == 1
    name = F.concat(F.lit("m"), n, F.when(qa, " QA v").otherwise("_InfillFT_"), n)
    rows = t("customer").select(F.col("c_nationkey").alias("base"), F.when(qa, "QA").otherwise("FT").alias("comparison_method"), name.alias("ft_model"), (-_k()).alias("at"))
    return T.latest(rows, ["base"], "at").select("base", "comparison_method", "ft_model")


_CACHE = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'infill' ELSE 'schema' END AS task, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE sha1(source) END AS paired, 'p' || doc_id || ':' || octet_length(encode(text)) || ':' || sha1(text) AS fp FROM documents"


def _cache_rows(t):
    k = F.col("doc_id")
    return t("documents").select(
        k.alias("sample_id"), F.lit("base").alias("base_model"), F.lit("ft").alias("ft_model"), F.when(k % 2 == 0, "FT").otherwise("Base").alias("method"), F.when(k % 4 == 0, "infill").otherwise("schema").alias("task"), "lang",
        F.col("lang").cast("binary").alias("active"), F.when(k % 3 != 0, F.col("source").cast("binary")).alias("paired"), F.array(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))).alias("sources"),
    )


@query(f"""
SELECT c.doc_id AS sample_id, CASE WHEN task = 'infill' THEN 'table4_detail_v2_infill' ELSE 'table4_detail_v1' END AS cache_version, 'base::ft::' || CASE WHEN c.doc_id % 2 = 0 THEN 'FT' ELSE 'Base' END || '::' || task || '::empty::' || lang || '::' || c.doc_id || '::py_tree' || CASE WHEN task = 'infill' THEN '::m1' ELSE '' END AS cache_key,
  sha1(lang) AS active_prediction_sha1, paired AS paired_prediction_sha1, fp AS source_fingerprint FROM ({_CACHE}) c JOIN documents d ON d.doc_id = c.doc_id""")
def detail_cache_keys(t):
    return T.cache_record(_cache_rows(t), "py_tree", "m1").select("sample_id", "cache_version", "cache_key", "active_prediction_sha1", "paired_prediction_sha1", "source_fingerprint")


@query("""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'FT' ELSE 'Base' END AS method, count(*) FILTER (lang <> 'de' AND doc_id % 7 <> 0) AS reused, count(*) FILTER (lang = 'de' OR doc_id % 7 = 0) AS computed FROM documents GROUP BY 1""")
def detail_cache_reuse(t):
    """Details that are current, and those of which a prediction changed or nothing is known."""
    now = T.cache_record(_cache_rows(t), "py_tree", "m1")
    old = now.where("lang <> 'de'").withColumn("active_prediction_sha1", F.when(F.col("sample_id") % 7 == 0, "x").otherwise(F.col("active_prediction_sha1")))
    return T.reused(now, old)[2]
