"""States, records, files and further document operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import coverage as G
from ..operators import html as H
from ..operators import incremental as K
from ..operators import jobs as J
from ..operators import tuning as T
from ..operators import validate as V
from ..operators.clustered import dealt
from ..operators.shards import sharded
from .registry import query


@query("""
SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 11 = 0 THEN 'source_error' WHEN o_orderkey % 7 = 0 THEN 'not_run' WHEN o_orderkey % 5 = 0 THEN 'source_mismatch'
  WHEN o_orderkey % 3 = 0 THEN 'transport_error' WHEN o_orderkey % 2 = 0 THEN 'model_format_failure' ELSE 'scored' END AS state FROM orders""")
def job_state_ladder(t):
    k = F.col("o_orderkey")
    yes, no = F.lit(True), F.lit(False)
    state = V.job_state(F.when(k % 11 == 0, "source_error").otherwise("ready"), k % 7 != 0, yes, k % 5 != 0, yes, F.when(k % 3 == 0, "transport_error"), F.lit(None).cast("string"), yes, no, k % 2 == 0)
    return t("orders").select(k.alias("sample_id"), state.alias("state"))


@query("""
SELECT condition, state, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'empty' END AS condition,
  CASE WHEN o_orderkey % 6 = 0 THEN 'source_error' WHEN o_custkey % 4 = 0 THEN 'ineligible_no_targets' ELSE 'ready' END AS state FROM orders) GROUP BY ALL""")
def eligibility_states(t):
    """Prepared jobs of the infill task by condition and state."""
    k = F.col("o_orderkey")
    base = t("orders").select(F.lit("en").alias("lang"), k.alias("sample_id"), F.lit("<p></p>").alias("html"), F.when(k % 6 != 0, F.lit("c")).alias("context"), (F.col("o_custkey") % 4).alias("targets"), "o_orderstatus")
    parts = [J.jobs(base.where(w), "infill", c).select("condition", F.col("status").alias("state")) for c, w in (("filled", "o_orderstatus = 'F'"), ("empty", "o_orderstatus <> 'F'"))]
    return parts[0].unionByName(parts[1]).groupBy("condition", "state").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 3 = 0 THEN false WHEN o_orderkey % 2 = 0 THEN o_custkey % 2 = 0 ELSE true END AS changed FROM orders""")
def file_change_ladder(t):
    """New files, files of equal time and size, files told by digest, files told by time."""
    k = F.col("o_orderkey")
    old_time = F.when(k % 5 != 0, 100)
    time = F.when(k % 3 == 0, 100).otherwise(120)
    old_sha = F.when(k % 2 == 0, "a")
    sha = F.when(F.col("o_custkey") % 2 == 0, "b").otherwise("a")
    return t("orders").select(k.alias("sample_id"), K.changed(old_time, F.lit(1), old_sha, time, F.lit(1), sha).alias("changed"))


@query("""
WITH j AS (SELECT c_custkey, c_custkey % 3 = 0 AS has FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'c' || c.c_custkey AS custom_id, CASE WHEN j.c_custkey IS NULL THEN 'unknown' WHEN c.c_custkey % 5 = 0 THEN 'failed' WHEN c.c_custkey % 7 = 0 THEN 'empty' WHEN has THEN 'skip' ELSE 'write' END AS state
FROM customer c LEFT JOIN j ON c.c_custkey = j.c_custkey""")
def batch_output_states(t):
    k = F.col("c_custkey")
    ident = F.concat(F.lit("c"), k.cast("string")).alias("custom_id")
    jobs = t("customer").where("c_mktsegment <> 'BUILDING'").select(ident, (k % 3 == 0).alias("has_prediction"))
    out = t("customer").select(ident, F.when(k % 5 == 0, "e").alias("error"), F.when(k % 7 != 0, F.col("c_name")).alias("response"))
    return J.batch_outcome(jobs, out)


@query("""
SELECT s_suppkey, sha256('{"custom_id":"infill__s' || s_suppkey || '","method":"POST","url":"/v1/chat/completions","body":{"model":"' || s_name || '","messages":[{"role":"system","content":"You are a precise table and JSON conversion assistant."},{"role":"user","content":"n' || s_nationkey || '"}]}}') AS line FROM supplier""")
def request_lines(t):
    ident = J.custom_id(F.lit("infill"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    line = J.request_line(F.col("s_name"), ident, J.messages(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))))
    return t("supplier").select("s_suppkey", F.sha2(line, 256).alias("line"))


@query("""
SELECT doc_id, lang || '_' || doc_id AS prefixed, CAST(CASE WHEN lang = 'en' THEN doc_id ELSE doc_id + 100000 END AS VARCHAR) AS moved, CASE WHEN starts_with(trim(source), '```') THEN trim(source) ELSE '```html' || chr(10) || trim(source) || chr(10) || '```' END AS fenced FROM documents""")
def record_ids(t):
    return t("documents").select("doc_id", J.record_id(F.col("lang"), F.col("doc_id")).alias("prefixed"), J.record_id(F.col("lang"), F.col("doc_id"), "offset").alias("moved"), X.fenced_html(F.col("source")).alias("fenced"))


@query("""
SELECT p_partkey, 'data:image/png;base64,' || base64(encode(p_name)) AS url FROM part""")
def image_data_urls(t):
    return t("part").select("p_partkey", X.data_url(F.col("p_name").cast("binary")).alias("url"))


@query("""
SELECT c_custkey, CAST(1 AS INTEGER) AS col, CAST(i AS INTEGER) AS idx, kind, value FROM (
SELECT c_custkey, 0 AS i, 'text' AS kind, lower(c_mktsegment) AS value FROM customer UNION ALL
SELECT c_custkey, 1, 'checkbox', CASE WHEN c_custkey % 2 = 0 THEN 'checked' ELSE 'unchecked' END FROM customer UNION ALL
SELECT c_custkey, 2, 'select', CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END FROM customer UNION ALL
SELECT c_custkey, 3, 'textarea', 'n' || c_nationkey FROM customer)""")
def control_values(t):
    """Kinds and values of a cell's controls; a select without a choice has its first option."""
    k = F.col("c_custkey")
    cell = F.concat(
        F.lit('<td><input value="'), "c_mktsegment", F.lit('"><input type="Checkbox"'), F.when(k % 2 == 0, " checked").otherwise(""),
        F.lit('><select><option value="A">x</option><option'), F.when(k % 3 == 0, " selected").otherwise(""), F.lit(">B</option></select><textarea>n"), F.col("c_nationkey").cast("string"), F.lit("</textarea></td>"),
    )
    docs = dealt(t("customer"), "c_custkey").select("c_custkey", H.as_table(F.array(F.array(F.lit("<td>L</td>"), cell))).alias("html"))
    grid = H.cells(docs)
    return grid.select("c_custkey", "col", F.explode("controls").alias("x")).select("c_custkey", "col", "x.idx", "x.kind", "x.value")


@query("""
SELECT r_regionkey, CAST(k + 1 AS INTEGER) AS width, CAST(2 AS INTEGER) AS rows FROM (SELECT r_regionkey, count(*) AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)""")
def row_width_profile(t):
    """Columns that each row covers, spans from above counted."""
    rows = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("k"))
    table = F.concat(F.lit('<table><tr><td rowspan="2">h</td><td colspan="'), F.col("k").cast("string"), F.lit('">a</td></tr><tr>'), F.repeat(F.lit("<td>x</td>"), F.col("k").cast("int")), F.lit("</tr></table>"))
    w = H.row_widths(table)[0]
    return rows.select("r_regionkey", F.array_max(w).alias("width"), F.size(F.filter(w, lambda x: x == F.col("k") + 1)).alias("rows"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END::INTEGER AS changed FROM nation""")
def static_cell_check(t):
    """Labels that an output changed against its template."""
    row = lambda a, b: F.concat(F.lit("<table><tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td></tr></table>"))
    label = F.col("n_name")
    out = F.when(F.col("n_nationkey") % 2 == 0, row(label, F.lit("[Name]"))).otherwise(row(F.lit("other"), F.lit("[Name]")))
    changes = H.static_changes(row(label, F.lit("")), row(label, F.lit("value")), out)
    return t("nation").select("n_nationkey", F.size(changes).alias("changed"))


@query("""
SELECT n_nationkey, '<p>' || n_name || ' <input type="text" name="F' || n_nationkey || '" value="placeholder"/></p>' AS html FROM nation""")
def marker_inputs(t):
    html = F.concat(F.lit("<p>"), "n_name", F.lit(" [F"), F.col("n_nationkey").cast("string"), F.lit("]</p>"))
    return t("nation").select("n_nationkey", H.inputs_for_markers(html).alias("html"))


_DETAIL = "SELECT o_orderkey AS sample_id, CASE o_custkey % 2 WHEN 0 THEN 'infill' ELSE 'alignment' END AS task, 'm' || (o_custkey % 3) AS model, o_orderkey % 5 AS correct, 5 AS total, o_orderstatus AS s, o_orderpriority AS p FROM orders"


@query(f"""
WITH d AS ({_DETAIL}), b AS (SELECT * FROM d WHERE s <> 'P'), u AS (SELECT sample_id, task, model, (correct + 1) % 6 AS correct, total FROM d WHERE p <> '5-LOW'),
j AS (SELECT model, task, sum(b.correct) / sum(b.total) AS base, sum(u.correct) / sum(u.total) AS tuned, count(*) AS samples FROM b JOIN u USING (sample_id, task, model) GROUP BY ALL),
w AS (SELECT model, avg(base) AS base, avg(tuned) AS tuned, CAST(sum(samples) AS BIGINT) AS samples FROM j GROUP BY model)
SELECT model, round(base, 9) AS base, round(tuned, 9) AS tuned, round(tuned - base, 9) AS delta, samples FROM w
UNION ALL SELECT 'Average', round(avg(base), 9), round(avg(tuned), 9), round(avg(tuned) - avg(base), 9), CAST(sum(samples) AS BIGINT) FROM w""")
def base_vs_tuned(t):
    """Scores over the samples that both sides have, a mean over tasks, and the average row."""
    c = F.col("o_custkey")
    d = t("orders").select(F.col("o_orderkey").alias("sample_id"), F.when(c % 2 == 0, "infill").otherwise("alignment").alias("task"), F.concat(F.lit("m"), (c % 3).cast("string")).alias("model"), (F.col("o_orderkey") % 5).alias("correct"), F.lit(5).alias("total"), "o_orderstatus", "o_orderpriority")
    tuned = d.where("o_orderpriority <> '5-LOW'").withColumn("correct", (F.col("correct") + 1) % 6)
    out = T.base_vs_tuned(d.where("o_orderstatus <> 'P'"), tuned)
    return out.select("model", *(F.round(x, 9).alias(x) for x in ("base", "tuned", "delta")), "samples")


@query("""
WITH a AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS n FROM part), b AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN 'other' ELSE p_name END AS p_name, row_number() OVER (ORDER BY p_partkey) AS n FROM part)
SELECT a.p_partkey, a.p_name IS NOT DISTINCT FROM b.p_name AS same FROM a LEFT JOIN b USING (n)""")
def manifest_prefix(t):
    """Whether a shorter manifest is the beginning of a longer one, row by row."""
    part = t("part").select("p_partkey", "p_name")
    other = t("part").select("p_partkey", F.when(F.col("p_size") == 7, "other").otherwise(F.col("p_name")).alias("p_name"))
    return T.zipped(part, other, "p_partkey").select("p_partkey", F.col("p_name").eqNullSafe(F.col("other_p_name")).alias("same"))


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'B%' THEN 'building' WHEN c_mktsegment LIKE '%E%' THEN 'has e' ELSE 'none' END AS alias FROM customer""")
def alias_by_fragment(t):
    """Names mapped by the first alias whose fragment they hold."""
    spark = t("customer").sparkSession
    aliases = spark.createDataFrame([("b", "building", 0, True), ("e", "has e", 1, False)], "fragment string, alias string, rank int, starts boolean")
    return G.first_alias(t("customer").select("c_custkey", X.word_text(F.col("c_mktsegment")).alias("name")), aliases, ["c_custkey"], "name", "none")


@query("""
SELECT s_suppkey, CAST(floor(s_acctbal * 10) AS BIGINT) / 10.0 AS value FROM supplier""")
def percent_parse(t):
    tenth = F.floor(F.col("s_acctbal") * 10).cast("bigint")
    text = F.concat(F.when(tenth >= 0, "+").otherwise(""), (tenth.cast("decimal(20,1)") / 10).cast("decimal(20,1)").cast("string"), F.lit("%"))
    return t("supplier").select("s_suppkey", X.parse_percent(text).alias("value"))


@query("""
SELECT sample_id, language, count(*) > 1 AS repeated, bool_or(source = '' OR license = '') AS incomplete FROM (
SELECT o_custkey AS sample_id, 'l' || (o_orderkey % 2) AS language, CASE WHEN o_orderkey % 40 = 0 THEN '' ELSE 's' END AS source, CASE WHEN o_orderkey % 60 = 1 THEN '' ELSE 'l' END AS license FROM orders) GROUP BY ALL""")
def inventory_check(t):
    """Identities that repeat, and rows that lack a required value."""
    k = F.col("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("sample_id"), F.concat(F.lit("l"), (k % 2).cast("string")).alias("language"), F.when(k % 40 == 0, "").otherwise("s").alias("source"), F.when(k % 60 == 1, "").otherwise("l").alias("license"))
    return T.inventory(rows, ["sample_id", "language"], ["source", "license"])


@query("""
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (SELECT o_custkey, o_orderkey, bytes, n, CAST(0 AS BIGINT) AS shard, bytes AS used FROM o WHERE n = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.bytes, o.n, CASE WHEN s.used > 0 AND s.used + o.bytes > 500000 THEN s.shard + 1 ELSE s.shard END, CASE WHEN s.used > 0 AND s.used + o.bytes > 500000 THEN o.bytes ELSE s.used + o.bytes END FROM s JOIN o ON o.o_custkey = s.o_custkey AND o.n = s.n + 1)
SELECT o_custkey, o_orderkey, bytes, shard FROM s""")
def shard_by_bytes(t):
    """Greedy shards of each customer's orders."""
    rows = t("orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("bytes"))
    return sharded(rows, ["o_custkey"], "o_orderkey", "bytes", 500_000)


@query("""
WITH RECURSIVE o AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS bytes, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
p AS (SELECT n, sum(bytes) OVER (ORDER BY n) AS upto FROM o),
s(first, shard) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT (SELECT min(q.n) FROM p q WHERE q.n > s.first AND q.upto > 5000000 + (SELECT r.upto - o.bytes FROM p r JOIN o USING (n) WHERE r.n = s.first)), shard + 1 FROM s WHERE s.first IS NOT NULL)
SELECT o_orderkey, bytes, (SELECT max(shard) FROM s WHERE first <= n) AS shard FROM o""")
def shard_of_all(t):
    """Greedy shards of all orders as one group, whose ranges are summed up as maps of the open shard's fill."""
    rows = t("orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("bytes"))
    return sharded(rows, [], "o_orderkey", "bytes", 5_000_000, rows_a_range=2_000)


@query("""
WITH RECURSIVE o AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
p AS (SELECT n, bytes, sum(bytes) OVER (ORDER BY n) AS upto FROM o),
s(first, shard) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT (SELECT min(q.n) FROM p q WHERE q.n > s.first AND q.upto > 100000 + (SELECT r.upto - r.bytes FROM p r WHERE r.n = s.first)), shard + 1 FROM s WHERE s.first IS NOT NULL)
SELECT doc_id, bytes, (SELECT max(shard) FROM s WHERE first <= n) AS shard FROM o""")
def document_shards(t):
    """Greedy shards of all documents under a byte budget."""
    rows = t("documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return sharded(rows, [], "doc_id", "bytes", 100_000)


@query("""
SELECT model, status, n, CAST(sum(n) OVER (PARTITION BY model) AS BIGINT) AS of FROM (SELECT l_linestatus AS model, l_returnflag AS status, count(*) AS n FROM lineitem GROUP BY ALL)""")
def status_histogram(t):
    return G.histogram(t("lineitem").select(F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("status")), ["model"], "status")


@query("""
WITH m AS (SELECT DISTINCT 'm' || (o_custkey % 4) AS model FROM orders WHERE o_orderstatus = 'F')
SELECT model, CAST(coalesce(CASE model WHEN 'm2' THEN 0 WHEN 'm0' THEN 1 END, 99) AS INTEGER) AS rank FROM m""")
def discovered_models(t):
    """Models that have predictions, known ones by their rank, others behind them."""
    spark = t("orders").sparkSession
    known = spark.createDataFrame([("m2", 0), ("m0", 1)], "model string, rank int")
    seen = t("orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("model"))
    return G.ranked(seen, known, "model")


@query("""
SELECT sample_id, source, value FROM (SELECT o_custkey AS sample_id, o_orderstatus AS source, o_orderkey AS value, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def last_row_wins(t):
    rows = t("orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("value"))
    return G.last_wins(rows, ["sample_id", "source"], "value")
