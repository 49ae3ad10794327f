"""Round trips: documents are rendered from relational rows, read back and
scored; the SQL computes the same from the rows alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import html as H
from ..operators import score as S
from ..operators.clustered import dealt
from .registry import query


def _row(*cells: Column) -> Column:
    return H.as_table(F.array(F.array(*cells)))


def _forms(t):
    """A form for each customer: two fields, gold values, and a prediction that
    errs by key."""
    key = F.col("c_custkey")
    c = dealt(t("customer"), "c_custkey").select("c_custkey", "c_name", "c_mktsegment")
    blank = _row(H.td(F.lit("Name")), H.td(F.lit("[Name]")), H.td(F.lit("[Segment]")))
    gold = _row(H.td(F.lit("Name")), H.td(F.col("c_name")), H.td(F.col("c_mktsegment")))
    name = F.when(key % 5 == 0, "").when(key % 7 == 0, F.concat("c_name", F.lit(" and more"))).otherwise(F.col("c_name"))
    segment = F.when(key % 3 == 0, "OTHER").otherwise(F.lower("c_mktsegment"))
    pred = _row(H.td(F.lit("Name")), H.td(name), H.td(segment))
    condition = F.when(key % 2 == 0, "filled").otherwise("empty")
    return c.select("c_custkey", "c_mktsegment", condition.alias("condition"), pred.alias("pred"), gold.alias("gold"), blank.alias("blank"))


_OK = "CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 0 ELSE 1 END + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END"


@query(f"""
SELECT condition, CAST(sum(ok) AS BIGINT) AS correct, CAST(sum(2) AS BIGINT) AS total, count(*) AS samples, round(sum(ok) / sum(2), 9) AS score
FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'filled' ELSE 'empty' END AS condition, {_OK} AS ok FROM customer) GROUP BY condition""")
def infill_micro_by_condition(t):
    scored = _forms(t).select("condition", S.infill_counts()("pred", "gold", "blank").alias("s")).select("condition", "s.correct", "s.total")
    return A.micro(scored, ["condition"]).withColumn("score", F.round("score", 9))


@query("""
SELECT c_custkey, CAST(1 AS INTEGER) AS col, CASE WHEN c_custkey % 5 = 0 THEN 'empty_prediction' WHEN c_custkey % 7 = 0 THEN 'mismatch' ELSE 'exact' END AS kind FROM customer
UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 3 = 0 THEN 'mismatch' ELSE 'exact' END FROM customer""")
def infill_exact_verdict(t):
    found = S.infill_targets("source_faithful_v2")("pred", "gold", "blank")
    return _forms(t).select("c_custkey", F.explode(found).alias("x")).select("c_custkey", "x.col", "x.kind")


@query("""
SELECT c_custkey, CAST(1 AS INTEGER) AS col, CASE WHEN c_custkey % 5 = 0 THEN 'mismatch' WHEN c_custkey % 7 = 0 THEN 'gold_in_prediction' ELSE 'exact' END AS kind FROM customer
UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 3 = 0 THEN 'mismatch' ELSE 'exact' END FROM customer""")
def infill_legacy_verdict(t):
    found = S.infill_targets("legacy_v1")("pred", "gold", "blank")
    return _forms(t).select("c_custkey", F.explode(found).alias("x")).select("c_custkey", "x.col", "x.kind")


@query("""
WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation)
SELECT r_regionkey, CAST(r AS INTEGER) AS row, CAST(1 AS INTEGER) AS col, CAST(1 AS INTEGER) AS rowspan, n_name AS text FROM n JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_regionkey, 0, 0, CAST(k AS INTEGER), r_name FROM n JOIN region ON n_regionkey = r_regionkey WHERE r = 0""")
def html_grid_roundtrip(t):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by_region = rows.groupBy("r_regionkey", "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    head = H.td(F.col("r_name"), rowspan=F.size("names"))
    table = H.as_table(F.transform("names", lambda n, i: F.when(i == 0, F.array(head, H.td(n))).otherwise(F.array(H.td(n)))))
    return H.cells(by_region.select("r_regionkey", table.alias("html"))).select("r_regionkey", "row", "col", "rowspan", "text")


@query("""
SELECT o_orderkey, CAST(0 AS INTEGER) AS row, CAST(0 AS INTEGER) AS col, o_orderstatus AS name, CAST(0 AS INTEGER) AS idx FROM orders
UNION ALL SELECT o_orderkey, 0, 0, o_orderpriority, 0 FROM orders UNION ALL SELECT o_orderkey, 0, 0, o_orderstatus, 1 FROM orders
UNION ALL SELECT o_orderkey, 0, 1, 'Total', 0 FROM orders""")
def placeholder_extract(t):
    cell = F.concat(F.lit("is ["), "o_orderstatus", F.lit("] of ["), "o_orderpriority", F.lit("], ["), "o_orderstatus", F.lit("]"))
    docs = dealt(t("orders"), "o_orderkey").select("o_orderkey", _row(H.td(cell), H.td(F.lit("[Total]"))).alias("html"))
    grid = H.cells(docs)
    return H.placeholder_rows(grid, ["o_orderkey"], X.label_text).select("o_orderkey", "row", "col", "name", "idx")


@query("""
SELECT o_orderkey, CAST(2 + o_orderkey % 3 AS BIGINT) AS occurrences, CAST(CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 2 + o_orderkey % 3 END AS BIGINT) AS slots,
  CAST(CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 3 ELSE 0 END AS BIGINT) AS collisions, CAST(CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS BIGINT) AS multi FROM orders""")
def slot_inventory(t):
    """Marks of a form: one to three in its first cell, one in its second; equal names of a cell have slots of their own, others share one."""
    k = F.col("o_orderkey") % 3
    name = lambda i: F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("[N"), F.substring(F.lit("abc"), i + 1, F.lit(1)), F.lit("]"))).otherwise(F.lit("[N]"))
    cell = F.array_join(F.transform(F.sequence(F.lit(0), k.cast("int")), name), " ")
    docs = dealt(t("orders"), "o_orderkey").select("o_orderkey", _row(H.td(cell), H.td(F.lit("[Total]"))).alias("html"))
    return A.slot_inventory(H.placeholder_rows(H.cells(docs), ["o_orderkey"], X.label_text), ["o_orderkey"])


def _meta(key: Column) -> Column:
    item = lambda name, col: F.struct(F.lit(name).alias("key"), F.struct(F.lit(0).alias("row"), F.lit(col).alias("col")).alias("label_info"), F.struct(F.lit(1).alias("rows"), F.lit(0).alias("cols")).alias("placeholder_offset"), F.lit("SI").alias("type"))
    return F.to_json(F.array(item("Name", 0), item("Balance", 1)))


@query("""
SELECT s_suppkey, 'analysis' AS strategy, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS correct, CAST(2 AS INTEGER) AS total FROM supplier""")
def alignment_roundtrip(t):
    """Every fourth prediction names its second input wrongly; every third puts
    a row in between, which the fallback by label finds."""
    head = F.array(H.td(F.lit("Name")), H.td(F.lit("Balance")))
    marks = F.array(F.lit("<td>[Name]</td>"), F.lit("<td>[Balance]</td>"))
    second = F.when(F.col("s_suppkey") % 4 == 0, F.lit('<td><input name="Wrong"></td>')).otherwise(F.lit('<td><input name="Balance"></td>'))
    fields = F.array(F.lit('<td><input name="Name"></td>'), second)
    title = F.array(F.lit('<td colspan="2">Form</td>'))
    pred = F.when(F.col("s_suppkey") % 3 == 0, H.as_table(F.array(title, head, fields))).otherwise(H.as_table(F.array(head, fields)))
    docs = dealt(t("supplier"), "s_suppkey").select("s_suppkey", pred.alias("pred"), H.as_table(F.array(head, marks)).alias("gold"), _meta(F.col("s_suppkey")).alias("meta"))
    return docs.select("s_suppkey", S.alignment_result("pred", "gold", "meta").alias("a")).select("s_suppkey", "a.strategy", "a.correct", "a.total")


@query("""
SELECT c_custkey, 'Name' AS key, 'SI' AS type, CAST(0 AS INTEGER) AS row, CAST(0 AS INTEGER) AS col, CAST(1 AS INTEGER) AS n FROM customer
UNION ALL SELECT c_custkey, 'Item', 'LI', 1, 0, 2 FROM customer
UNION ALL SELECT c_custkey, 'Agree', 'SO', 4, 0, 1 FROM customer""")
def meta_roundtrip(t):
    """Field types of a form: one simple field, a repeated one, one to tick."""
    cell = lambda s: F.lit(f"<td>{s}</td>")
    table = H.as_table(F.array(F.array(cell("Name"), cell("[Name]")), F.array(cell("Item"), cell("Qty")), F.array(cell("[Item1]"), H.td(F.col("c_custkey"))), F.array(cell("[Item2]"), cell("")), F.array(cell("Agree"), cell('<input type="checkbox">[Agree]'))))
    items = dealt(t("customer"), "c_custkey").select("c_custkey", F.explode(S.meta_items(table)).alias("m"))
    return items.select("c_custkey", "m.key", "m.type", "m.row", "m.col", F.size("m.offsets").alias("n"))


def _json_pair(t):
    """Flat objects; by key the prediction changes a value, drops a key or is broken."""
    k = F.col("o_orderkey")
    gold = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("customer")))
    other = F.to_json(F.struct(F.lit("?").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("customer")))
    fewer = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    pred = F.when(k % 5 == 0, other).when(k % 5 == 1, fewer).when(k % 5 == 2, F.lit("{broken")).when(k % 5 == 3, F.concat(F.lit("Here it is:\n```json\n"), gold, F.lit("\n```"))).otherwise(gold)
    return dealt(t("orders"), "o_orderkey").select("o_orderkey", pred.alias("pred"), gold.alias("gold"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN 'unrepairable' ELSE 'ok' END AS pred_status,
  round(CASE o_orderkey % 5 WHEN 0 THEN 1 - 1 / 14.0 WHEN 1 THEN 1 - 2 / 12.0 WHEN 2 THEN 0 ELSE 1 END, 9) AS similarity FROM orders""")
def tree_edit_flat(t):
    scored = _json_pair(t).select("o_orderkey", S.schema_result()("pred", "gold").alias("s"))
    return scored.select("o_orderkey", "s.pred_status", F.round("s.similarity", 9).alias("similarity"))


@query("""
SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 8 ELSE 0 END AS BIGINT) AS distance,
  round(CASE o_orderkey % 5 WHEN 0 THEN 1 - 2 / 14.0 WHEN 1 THEN 1 - 2 / 12.0 WHEN 2 THEN 0 ELSE 1 END, 9) AS similarity FROM orders""")
def json_label_multiset_distance(t):
    """A prediction without a document has no labels, so all of gold's count."""
    return _json_pair(t).select("o_orderkey", S.label_distance("pred", "gold").alias("d")).select("o_orderkey", "d.distance", F.round("d.similarity", 9).alias("similarity"))


@query("""
SELECT o_orderkey, 3 AS nodes_of_broken, CAST(CASE o_orderkey % 5 WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 0 ELSE 7 END AS INTEGER) AS nodes FROM orders""".replace("3 AS nodes_of_broken, ", ""))
def json_tree_size(t):
    """Nodes of the labelled tree: the root, keys and values."""
    return _json_pair(t).select("o_orderkey", F.size(S.json_nodes("pred")).alias("nodes"))


@query("""
SELECT CASE WHEN o_orderkey % 5 IN (3, 4) THEN 'exact' WHEN o_orderkey % 5 = 2 THEN 'failed' ELSE 'partial' END AS bucket, count(*) AS samples,
  round(avg(round(CASE o_orderkey % 5 WHEN 0 THEN 1 - 1 / 14.0 WHEN 1 THEN 1 - 2 / 12.0 WHEN 2 THEN 0 ELSE 1 END, 6)), 9) AS score FROM orders GROUP BY 1""")
def schema_macro(t):
    scored = _json_pair(t).select("o_orderkey", S.schema_result()("pred", "gold")["similarity"].alias("score"))
    k = F.col("o_orderkey") % 5
    bucket = F.when(k.isin(3, 4), "exact").when(k == 2, "failed").otherwise("partial")
    return A.macro(scored.withColumn("bucket", bucket), ["bucket"]).select("bucket", "samples", F.round("score", 9).alias("score"))


@query("""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'non_string' WHEN 2 THEN 'unrepairable' WHEN 3 THEN 'empty' WHEN 6 THEN 'repaired' ELSE 'ok' END AS status,
  CASE event_id % 8 WHEN 6 THEN '{"type": "' || event_type || '", "tags": ["a", "b"]}' END AS repaired FROM events""")
def json_status_ladder(t):
    """Every state of a lenient reading; a cut-off response is repaired."""
    k = F.col("event_id") % 8
    cut = F.concat(F.lit('So: {"type": "'), "event_type", F.lit('", "tags": ["a", "b'))
    doc = F.when(k == 0, F.lit("  ")).when(k == 1, F.lit("42")).when(k == 2, F.concat("props", F.lit("")).substr(1, 4)).when(k == 3, F.lit("null")).when(k == 4, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).when(k == 6, cut).otherwise(F.col("props"))
    read = dealt(t("events"), "event_id").select("event_id", S.lenient_json(doc).alias("j"))
    return read.select("event_id", "j.status", F.when(F.col("j.status") == "repaired", F.col("j.json")).alias("repaired"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'non_object_json' WHEN 3 THEN 'empty_response' ELSE 'ready' END AS status FROM events""")
def prediction_status_ladder(t):
    k = F.col("event_id") % 6
    full = F.to_json(F.struct(F.concat(F.lit("<think>x</think>"), "event_type").alias("raw_response")))
    doc = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("{")).when(k == 2, F.lit("[1]")).when(k == 3, F.lit('{"raw_response": "<think>a</think> "}')).otherwise(full)
    return t("events").select("event_id", S.prediction_status(doc).alias("status"))


@query("""
SELECT s_suppkey, s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AS ok FROM supplier""")
def json_conformity(t):
    """Outputs follow their template, but for those that lack a key or hold a list for an object."""
    k = F.col("s_suppkey")
    template = F.lit('{"name": "", "tags": {"value": [""]}}')
    good = F.to_json(F.struct(F.col("s_name").alias("name"), F.struct(F.array("s_name", "s_name").alias("value")).alias("tags")))
    fewer = F.to_json(F.struct(F.col("s_name").alias("name")))
    other = F.to_json(F.struct(F.col("s_name").alias("name"), F.array(F.lit(1)).alias("tags")))
    return dealt(t("supplier"), "s_suppkey").select("s_suppkey", S.conforms(template, F.when(k % 3 == 0, fewer).when(k % 7 == 0, other).otherwise(good))["ok"].alias("ok"))


@query("""
SELECT s_suppkey, s_suppkey % 4 <> 0 AS same, s_suppkey % 5 <> 0 AS same_table FROM supplier""")
def dom_signature_stable(t):
    """Filling in values and ticks keeps a form's signature; another element changes it, another row its table's."""
    k = F.col("s_suppkey")
    blank = F.lit('<table><tr><td>Name</td><td><input type="text" name="a"></td><td><input type="checkbox"></td></tr></table>')
    filled = F.concat(F.lit('<table><tr><td>'), "s_name", F.lit('</td><td><input type="text" name="a" value="'), "s_name", F.lit('"></td><td><input type="checkbox" checked>'), F.when(k % 4 == 0, "<b></b>").otherwise(""), F.lit("</td></tr></table>"))
    tables = lambda row: F.concat(F.lit("<table><tr><td>a</td><td>"), "s_name", F.lit("</td></tr>"), row, F.lit("</table>"))
    same_table = H.table_signature(tables(F.lit(""))) == H.table_signature(tables(F.when(k % 5 == 0, "<tr><td>x</td></tr>").otherwise("")))
    return dealt(t("supplier"), "s_suppkey").select("s_suppkey", (H.structure_signature(blank) == H.structure_signature(filled)).alias("same"), same_table.alias("same_table"))


@query("""
SELECT s_suppkey, CAST(1 + s_suppkey % 4 AS INTEGER) AS tables, CAST(1 + s_suppkey % 4 AS INTEGER) AS depth, s_suppkey % 4 > 0 AS nested FROM supplier""")
def dom_table_profile(t):
    """Tables inside cells of tables, none to three deep."""
    k = (F.col("s_suppkey") % 4).cast("int")
    html = F.concat(F.repeat(F.lit("<table><tr><td>"), k), F.lit("<table><tr><td>"), "s_name", F.lit("</td></tr></table>"), F.repeat(F.lit("</td></tr></table>"), k))
    found = dealt(t("supplier"), "s_suppkey").select("s_suppkey", H.table_profile(html).alias("p"))
    return found.select("s_suppkey", F.size("p").alias("tables"), F.array_max(F.transform("p", lambda x: x["depth"])).alias("depth"), F.exists("p", lambda x: x["nested"] > 0).alias("nested"))


@query()
def visible_text_stats(t):
    """Visible text of whole web pages; the parser has no SQL form."""
    return t("pages").select("page_id", H.table_tags(F.col("html")).cast("long").alias("table_tags"), F.char_length(H.visible_text("html")).cast("long").alias("chars"))
