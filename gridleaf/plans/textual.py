"""Text, form and JSON functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import coverage as G
from ..operators import html as H
from ..operators import score as S
from ..operators import validate as V
from ..operators.clustered import dealt
from .registry import query


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END::INTEGER AS whole, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id + 0.5 END::DOUBLE AS real,
  event_id % 2 = 0 AS han, event_id % 5 <> 0 AS latin, CASE WHEN event_id % 2 = 0 THEN 'zh' ELSE 'en' END AS lang, CAST('x' || event_id AS VARCHAR) AS prefix FROM events""")
def coerced_values(t):
    """Numbers out of text with a default, scripts and languages of names."""
    k = F.col("event_id")
    whole = F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    real = F.when(k % 4 == 0, "").otherwise(F.concat(k.cast("string"), F.lit(".5")))
    name = F.concat(F.when(k % 2 == 0, "表").otherwise("9"), F.when(k % 5 != 0, "b").otherwise("+"))
    split = F.concat(F.when(k % 2 == 0, "ZH-hans").otherwise("other"), F.lit(" test"))
    return t("events").select("event_id", X.int_or(whole, -1).alias("whole"), X.double_or(real, None).alias("real"), X.has_han(name).alias("han"), X.has_latin(name).alias("latin"), X.split_language(split).alias("lang"), X.language_prefix(F.concat(F.lit("x"), k.cast("string"), F.lit(" test"))).alias("prefix"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN '' ELSE 'r' || o_custkey END AS text FROM orders""")
def response_shapes(t):
    """The text of a response under each API's shape."""
    k, r = F.col("o_orderkey") % 6, F.concat(F.lit("r"), F.col("o_custkey").cast("string"))
    quoted = F.concat(F.lit('"'), r, F.lit('"'))
    wrap = lambda a, b: F.concat(F.lit(a), quoted, F.lit(b))
    doc = F.when(k == 0, wrap('{"output_text": ', "}")).when(k == 1, wrap('{"choices": [{"message": {"content": ', "}}]}")).when(k == 2, wrap('{"output": [{"content": [{"text": ', "}]}]}")).when(k == 3, wrap('{"content": [{"text": ', "}]}")).when(k == 4, wrap('{"message": {"content": ', "}}")).otherwise(F.lit('{"id": 1}'))
    return t("orders").select("o_orderkey", X.response_text(doc).alias("text"))


@query("""
SELECT c_custkey, '<table><tr><td>' || c_name || '</td></tr></table>' AS html FROM customer""")
def cleaned_responses(t):
    """Forms out of responses with fences, prologues or neither."""
    k = F.col("c_custkey") % 4
    form = F.concat(F.lit("<table><tr><td>"), "c_name", F.lit("</td></tr></table>"))
    text = F.when(k == 0, F.concat(F.lit("Sure:\n```html\n"), form, F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("```\n"), form, F.lit("```"))).when(k == 2, F.concat(F.lit("Here it is: "), form, F.lit("\n"))).otherwise(form)
    return t("customer").select("c_custkey", X.clean_html(text).alias("html"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Name,Tel' WHEN 1 THEN 'Item' ELSE 'Mr,X' END AS parts, s_suppkey % 4 < 2 AS safe, s_suppkey % 5 = 0 AS control,
  CASE s_suppkey % 2 WHEN 0 THEN 'a_b_' || s_suppkey || '.json' ELSE 'x' || s_suppkey END AS name FROM supplier""")
def name_parts(t):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Name12- Tel"), k.cast("string"))).when(k % 3 == 1, F.lit("Item3")).otherwise(F.lit("Mr/-X1"))
    lang = F.when(k % 4 == 0, "en").when(k % 4 == 1, "zh_Hans").when(k % 4 == 2, "e").otherwise("../en")
    cell = F.when(k % 5 == 0, F.element_at(F.array(F.lit("<td><INPUT></td>"), F.lit("yes ( )"), F.lit("[√] no")), (1 + k % 3).cast("int"))).otherwise(F.lit("<td>plain (x)</td>"))
    safe = F.when(k % 2 == 0, F.concat(F.lit("a b/"), k.cast("string"), F.lit(".json"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return t("supplier").select(k, F.array_join(X.base_parts(name), ",").alias("parts"), X.safe_language(lang).alias("safe"), X.non_pure_text(cell).alias("control"), X.safe_name(safe).alias("name"))


@query("""
SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0) ELSE printf('%.1f GiB', n / 1073741824.0) END AS size,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE printf('%.1f%%', CAST((p_partkey % 64) AS DOUBLE) * 100 / 64) END AS share, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN printf('+%.1f%%', CAST((p_partkey % 64) AS DOUBLE) * 100 / 64) ELSE printf('%.1f%%', CAST(-(p_partkey % 64) AS DOUBLE) * 100 / 64) END AS change
FROM (SELECT *, CAST(p_size AS BIGINT) * p_size * p_size * p_size * (1 + p_partkey % 100) AS n FROM part)""")
def shown_numbers(t):
    """Sizes and shares as reports show them."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    share = F.when(k % 3 != 0, (k % 64) / 64)
    return t("part").select("p_partkey", X.bytes_text(s * s * s * s * (1 + k % 100)).alias("size"), X.percent(share).alias("share"), X.signed_percent(F.when(k % 2 == 0, share).otherwise(-share)).alias("change"))


@query("""
SELECT doc_id, 'title' || doc_id || ' ' || source || ' & more' AS text, CAST(1 + doc_id % 3 AS BIGINT) AS tables FROM documents""")
def form_visible_text(t):
    """What a form shows: no markup, scripts or styles, entities resolved; and its table tags."""
    k = F.col("doc_id").cast("string")
    html = F.concat(F.lit("<html><head><style>p{}</style><script>var x='<td>no</td>';</script></head><body>\n<p>title"), k, F.lit("</p>  <!-- no --> "), F.repeat(F.lit("<table></table>"), (F.col("doc_id") % 3).cast("int")), F.lit("<table><tr><td>"), "source", F.lit("</td><td>&amp; more</td></tr></table></body></html>"))
    return t("documents").select("doc_id", H.visible_text(html).alias("text"), H.table_tags(html).cast("long").alias("tables"))


@query("""
SELECT c_custkey, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CASE WHEN c = 0 THEN 'L' || r ELSE c_name || r END AS text FROM customer, range(0, 3) a(r), range(0, 2) b(c) WHERE r <= c_custkey % 3""")
def div_form_cells(t):
    """Forms of divisions instead of tables: rows and columns by class."""
    row = lambda i: F.concat(F.lit('<div class="row"><div class="col-half">L'), i.cast("string"), F.lit('</div><div class="x col">'), F.col("c_name"), i.cast("string"), F.lit("</div><div>no</div></div>"))
    html = F.concat(F.lit('<div class="a form-container">'), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int")), row), ""), F.lit("</div>"))
    return H.cells(dealt(t("customer"), "c_custkey").select("c_custkey", html.alias("html"))).select("c_custkey", "row", "col", "text")


@query("""
SELECT n_nationkey, strategy, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, text FROM nation, (VALUES ('leaf', 0, 0, 'in'), ('leaf', 0, 1, '[A]'), ('leaf', 1, 0, 'two'), ('leaf', 1, 1, '[B]'), ('analysis', 0, 0, 'in'), ('analysis', 0, 1, '[A]'), ('analysis', 1, 0, 'two'), ('analysis', 1, 1, '[B]')) v(strategy, r, c, text) WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, strategy, CAST(r AS INTEGER), CAST(c AS INTEGER), text FROM nation, (VALUES ('leaf', 0, 0, '[A]'), ('analysis', 0, 0, 'out'), ('analysis', 0, 1, '[A]')) v(strategy, r, c, text) WHERE n_nationkey % 2 = 1""")
def coordinate_strategies(t):
    """Cells by leaf and by outermost tables: two tables inside a wrapper are
    stacked alike; a marked table inside a cell with a label beside it is told apart."""
    wrapped = F.lit("<table><tr><td><table><tr><td>in</td><td>[A]</td></tr></table><table><tr><td>two</td><td>[B]</td></tr></table></td></tr></table>")
    inside = F.lit("<table><tr><td>out</td><td><table><tr><td>[A]</td></tr></table></td></tr></table>")
    found = t("nation").select("n_nationkey", F.explode(H.strategy_cells_of("bracket")(F.when(F.col("n_nationkey") % 2 == 0, wrapped).otherwise(inside))).alias("x"))
    return found.where("x.strategy <> 'recursive'").select("n_nationkey", "x.strategy", "x.cell.row", "x.cell.col", "x.cell.text")


@query("""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'leaf' ELSE 'analysis' END AS strategy, CAST(CASE s_suppkey % 3 WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS correct, CAST(1 AS INTEGER) AS total FROM supplier""")
def strategy_choice(t):
    """The reading of a form that finds most targets: of leaf tables, where the
    gold form is a table inside a cell and metadata counts inside it; else of the outer ones."""
    k = F.col("s_suppkey")
    meta = lambda rows: F.lit(f'[{{"key": "A", "label_info": {{"row": 0, "col": 0}}, "placeholder_offset": {{"rows": {rows}, "cols": 1}}, "type": "SI"}}]')
    deep = lambda mark: F.lit(f"<table><tr><td>top</td><td><table><tr><td>A</td><td>x</td></tr><tr><td></td><td>{mark}</td></tr></table></td></tr></table>")
    flat = lambda mark: F.lit(f"<table><tr><td>A</td><td>{mark}</td></tr></table>")
    gold = F.when(k % 3 == 0, deep("[A]")).otherwise(flat("[A]"))
    pred = F.when(k % 3 == 0, deep('<input name="A">')).when(k % 3 == 1, flat('<input name="A">')).otherwise(flat('<input name="B">'))
    docs = dealt(t("supplier"), "s_suppkey").select("s_suppkey", pred.alias("pred"), gold.alias("gold"), F.when(k % 3 == 0, meta(1)).otherwise(meta(0)).alias("meta"))
    return docs.select("s_suppkey", S.alignment_result("pred", "gold", "meta").alias("a")).select("s_suppkey", "a.strategy", "a.correct", "a.total")


@query("""
SELECT c_custkey, CAST(0 AS INTEGER) AS row, CAST(0 AS INTEGER) AS col, c_name || ' & co' AS text FROM customer UNION ALL SELECT c_custkey, 0, 1, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 1, 0, 'x' FROM customer WHERE c_custkey % 2 = 0""")
def pattern_cells(t):
    """Cells by pattern alone."""
    html = F.concat(F.lit("<tr class='a'><td>"), "c_name", F.lit(" &amp;  co</td><TH><b>"), "c_mktsegment", F.lit("</b></TH></tr>"), F.when(F.col("c_custkey") % 2 == 0, "<tr><td>x</td></tr>").otherwise(""))
    return dealt(t("customer"), "c_custkey").select("c_custkey", F.explode(H.scanned_cells(html)).alias("x")).select("c_custkey", "x.row", "x.col", "x.text")


@query("""
SELECT s_suppkey, CAST(2 AS INTEGER) AS target, CAST(CASE s_suppkey % 3 WHEN 0 THEN 0 ELSE 1 END AS INTEGER) AS repaired, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END AS last_span FROM supplier""")
def column_repair(t):
    """Rows that are wider or narrower than the table's usual width."""
    k = F.col("s_suppkey") % 3
    last = F.when(k == 0, "<td>c</td><td>d</td>").when(k == 1, '<td>c</td><td colspan="2">d</td>').otherwise("<td>c</td>")
    html = F.concat(F.lit("<table><tr><td>a</td><td>"), "s_name", F.lit("</td></tr><tr><td>e</td><td>f</td></tr><tr>"), last, F.lit("</tr></table>"))
    fixed = dealt(t("supplier"), "s_suppkey").select("s_suppkey", H.repaired_columns(html).alias("r"))
    cells = H.cells(fixed.select("s_suppkey", "r.target", "r.repaired", F.col("r.html").alias("html")))
    return cells.groupBy("s_suppkey", "target", "repaired").agg(F.max_by("colspan", F.struct("row", "col")).alias("last_span"))


@query("""
SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS empty_cells, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS empty_rows, CAST(4 AS INTEGER) AS cells FROM part""")
def empty_cells_and_rows(t):
    k = F.col("p_partkey")
    html = F.concat(F.lit("<table><tr><td>"), "p_name", F.lit("</td><td>"), F.when(k % 2 == 0, "  ").otherwise("<input>"), F.lit("</td></tr><tr><td></td><td>"), F.when(k % 3 == 0, "&nbsp;").otherwise("y"), F.lit("</td></tr></table>"))
    return t("part").select("p_partkey", H.emptiness(html).alias("e")).select("p_partkey", "e.empty_cells", "e.empty_rows", "e.cells")


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'B' END AS label, '' AS stripped_mark, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS inputs FROM nation""")
def form_repairs(t):
    """Static cells put back, marks taken out for rendering, inputs that gold lacks added."""
    k = F.col("n_nationkey")
    row = lambda a, b: F.concat(F.lit("<table><tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td></tr></table>"))
    label = F.when(k % 2 == 0, F.col("n_name")).otherwise(F.lit("B"))
    out = H.restored_static(row(label, F.lit("")), row(label, F.lit("v")), row(F.lit("changed"), F.lit("[X]")))
    docs = t("nation").select("n_nationkey", out.alias("html"))
    restored = H.cells(docs).where("row = 0 and col = 0").select("n_nationkey", F.col("text").alias("label"))
    bare = H.cells(t("nation").select("n_nationkey", H.stripped_markers(row(label, F.lit("[X]"))).alias("html"))).where("col = 1").select("n_nationkey", F.col("text").alias("stripped_mark"))
    mended = H.repaired_gold(row(F.lit("x"), F.lit('<input name="A">')), row(F.lit("x"), F.concat(F.lit("[A]"), F.when(k % 3 == 0, "[B]").otherwise(""))))
    inputs = t("nation").select("n_nationkey", F.regexp_count(mended, F.lit("<input")).cast("int").alias("inputs"))
    return restored.join(bare, "n_nationkey").join(inputs, "n_nationkey")


@query("""
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'fenced' WHEN 2 THEN 'no table' WHEN 3 THEN 'structure differs' WHEN 4 THEN 'text unchanged' ELSE '' END AS reason FROM supplier""")
def generated_form_check(t):
    k = F.col("s_suppkey") % 6
    form = lambda v, extra="": F.concat(F.lit("<table><tr><td>"), v, F.lit(f"</td>{extra}</tr></table>"))
    out = F.when(k == 0, " ").when(k == 1, F.concat(F.lit("```"), form(F.col("s_name")), F.lit("```"))).when(k == 2, "<p>x</p>").when(k == 3, form(F.lit("x"), "<td></td>")).when(k == 4, form(F.col("s_name"))).otherwise(form(F.lit("other")))
    return t("supplier").select("s_suppkey", V.generated_html(form(F.col("s_name")), out)["reason"].alias("reason"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '电话' WHEN 1 THEN '' ELSE '' END AS unknown FROM customer""")
def placeholder_name_check(t):
    """Names in the output that the source's text does not hold; only Han texts are judged."""
    k = F.col("c_custkey") % 3
    source = F.when(k == 2, "Name and more").otherwise("<td>姓 名</td>")
    output = F.when(k == 0, "[姓名] [电话1]").when(k == 1, "[姓名2]").otherwise("[Other]")
    return t("customer").select("c_custkey", F.array_join(V.placeholder_names(source, output), ",").alias("unknown"))


@query("""
SELECT event_id, event_id % 7 <> 0 AND event_id % 5 < 4 AS ok FROM events""")
def score_bounds(t):
    """Scores that are numbers between 0 and 1."""
    k = F.col("event_id")
    score = F.when(k % 7 == 0, F.lit(float("nan"))).otherwise((k % 5) / 3.0 - F.when(k % 5 == 4, 0.0).otherwise(0.0))
    return t("events").select("event_id", V.score_ok(F.when(k % 5 < 4, F.when(k % 7 == 0, score).otherwise((k % 5) / 3.0)).when(k % 7 == 0, None).otherwise(F.lit(-0.5))).alias("ok"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'gold_non_dict:list' WHEN 2 THEN 'empty' ELSE 'unrepairable' END AS gold_status FROM orders""")
def object_gate(t):
    """Only objects are scored; anything else is a state."""
    k = F.col("o_orderkey") % 4
    gold = F.when(k == 0, '{"a": 1}').when(k == 1, "[1, 2]").when(k == 2, " ").otherwise("no document")
    return t("orders").select("o_orderkey", S.schema_result()(F.lit('{"a": 1}'), gold)["gold_status"].alias("gold_status"))


@query("""
SELECT c_custkey, '{\\{\\}{"name":{"' || c_name || '"}}{"tags":{[]{1}{null}}}}' AS brackets, CAST(CASE c_custkey % 3 WHEN 2 THEN 0 ELSE 3 END AS INTEGER) AS candidates FROM customer""")
def json_bracket_form(t):
    """Trees in bracket form, and the documents that a response may stand for."""
    k = F.col("c_custkey") % 3
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.array(F.lit(1), F.lit(None).cast("int")).alias("tags")))
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n``` so"))).when(k == 1, doc).otherwise(F.lit("none"))
    spaced = F.concat(F.lit('{"name": "'), "c_name", F.lit('", "tags": [1, null]}'))
    return t("customer").select("c_custkey", S.bracket_form(spaced).alias("brackets"), F.size(S.json_candidates(reply)).alias("candidates"))


@query("""
SELECT s_suppkey, i AS place, 'k' || i AS key, CASE i WHEN 1 THEN 'LI' ELSE 'SI' END AS type FROM supplier, range(0, 3) r(i) WHERE i <= s_suppkey % 3""")
def nested_meta_items(t):
    """Items of metadata at any depth of lists, in order."""
    item = lambda i: f'{{"key": "k{i}", "type": "{"LI" if i == 1 else "SI"}", "label_info": {{"row": {i}, "col": 0}}, "placeholder_offset": {{"rows": 0, "cols": 1}}}}'
    k = F.col("s_suppkey") % 3
    meta = F.when(k == 0, f"[[[{item(0)}]]]").when(k == 1, f"[{item(0)}, [[{item(1)}]]]").otherwise(f'{{"structured_analysis": [[{item(0)}], [{item(1)}, [{item(2)}]]]}}')
    items = t("supplier").select("s_suppkey", F.posexplode(S.meta_types(meta)).alias("place", "type"))
    return items.select("s_suppkey", F.col("place").cast("long").alias("place"), F.concat(F.lit("k"), F.col("place").cast("string")).alias("key"), "type")


@query("""
SELECT n_nationkey, key, type, CAST(r AS INTEGER) AS row, CAST(n AS INTEGER) AS n FROM nation, (VALUES (0, 'Mail', 'GI', 0, 2), (0, 'Kind', 'GO', 1, 1), (0, 'Sex', 'SO', 2, 1), (1, 'Row', 'LI', 0, 3), (1, 'Row', 'LI', 1, 1)) v(g, key, type, r, n) WHERE FALSE
UNION ALL SELECT n_nationkey, 'Mail', 'GI', 0, 2 FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 'Sex', 'SO', 1, 1 FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 'Row', 'LI', 0, 2 FROM nation WHERE n_nationkey % 2 = 1""")
def grouped_field_types(t):
    """Fields that share a label, fields to tick and numbered fields."""
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    a = F.lit("<table>" + row("Mail", "[Mail]", "[Mail]") + row("Sex", '<input type="radio">[Sex]', "") + "</table>")
    b = F.lit("<table>" + row("Row", "x") + row("[Row1]", "") + row("[Row2]", "") + "</table>")
    items = t("nation").select("n_nationkey", F.explode(S.meta_items(F.when(F.col("n_nationkey") % 2 == 0, a).otherwise(b))).alias("m"))
    return items.select("n_nationkey", "m.key", "m.type", "m.row", F.size("m.offsets").alias("n"))


@query("""
WITH e AS (SELECT o_orderstatus AS stage, o_orderpriority AS lang, o_custkey AS id FROM orders WHERE o_totalprice < 200000 GROUP BY ALL), f AS (SELECT o_orderstatus AS stage, o_orderpriority AS lang, o_custkey AS id, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY ALL),
j AS (SELECT coalesce(e.stage, f.stage) AS stage, coalesce(e.lang, f.lang) AS lang, e.id AS want, f.id AS have, coalesce(n, 0) AS n FROM e FULL JOIN f ON e.stage = f.stage AND e.lang = f.lang AND e.id = f.id)
SELECT stage, lang, count(*) FILTER (have IS NULL) AS missing, count(*) FILTER (want IS NULL) AS extra, count(*) FILTER (n > 1) AS duplicates FROM j GROUP BY ALL""")
def stage_file_audit(t):
    rows = lambda w: t("orders").where(w).select(F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("lang"), F.col("o_custkey").alias("sample_id"))
    return G.stage_audit(rows("o_totalprice < 200000").distinct(), rows("o_totalprice > 100000")).drop("complete")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'no PNG' WHEN p_partkey % 5 = 0 THEN 'too small' WHEN p_partkey % 7 = 0 THEN 'no layout audit' ELSE '' END AS reason, p_partkey % 3 <> 0 AS rendered FROM part""")
def image_checks(t):
    """PNG headers, sizes and layout audits of images, and whether a rendering had no fault."""
    k = F.col("p_partkey")
    side = F.when(k % 5 == 0, "0000000F").otherwise("00000100")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), side, F.lit("00000200")))
    content = F.when(k % 4 == 0, F.unhex(F.lit("FFD8FF"))).otherwise(png)
    return t("part").select("p_partkey", V.png(content, k % 7 != 0)["reason"].alias("reason"), V.render_ok(F.lit(0), F.when(k % 3 == 0, 2)).alias("rendered"))
