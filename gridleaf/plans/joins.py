"""Coverage, matching, ordering and incremental plans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import coverage as G
from ..operators import incremental as K
from ..operators import ordered as O
from .registry import query

_CONDITION = "CASE WHEN l_linenumber % 2 = 0 THEN 'filled' ELSE 'empty' END"


def _predictions(t):
    """A line item is a prediction of its order under one of two conditions."""
    return t("lineitem").select(F.col("l_orderkey").alias("sample_id"), F.when(F.col("l_linenumber") % 2 == 0, "filled").otherwise("empty").alias("condition"), F.col("l_linestatus").alias("model"), F.when(F.col("l_returnflag") == "R", "empty_response").otherwise("ready").alias("status"))


_PRED = f"SELECT l_orderkey AS sample_id, {_CONDITION} AS condition, l_linestatus AS model, CASE WHEN l_returnflag = 'R' THEN 'empty_response' ELSE 'ready' END AS status FROM lineitem"


@query("""
WITH d AS (SELECT DISTINCT c_mktsegment AS segment FROM customer), s AS (SELECT DISTINCT o_orderstatus AS status FROM orders),
o AS (SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT segment, status, CAST(coalesce(n, 0) AS BIGINT) AS n, min_id, max_id FROM d CROSS JOIN s LEFT JOIN o USING (segment, status)""")
def coverage_cross_join(t):
    """Counts of every combination, those without rows included."""
    c = t("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    o = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    dims = c.select("segment").distinct().crossJoin(O.bounded(o.select("status").distinct()))
    some = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("segment", "status").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("min_id"), F.max("o_orderkey").alias("max_id"))
    return dims.join(some, ["segment", "status"], "left").select("segment", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "min_id", "max_id")


@query(f"""
WITH e AS (SELECT model, sample_id, bool_or(condition = 'filled' AND status = 'ready') AS f, bool_or(condition = 'empty' AND status = 'ready') AS e FROM ({_PRED}) GROUP BY ALL)
SELECT model, count(*) AS samples, count(*) FILTER (f AND e) AS paired, count(*) FILTER (f AND NOT e) AS filled_only, count(*) FILTER (e AND NOT f) AS empty_only, bool_and(f AND e) AS complete FROM e GROUP BY model""")
def pair_coverage(t):
    return G.pair_coverage(_predictions(t), ["model"])


@query(f"""
WITH want AS (SELECT c.condition, o_orderkey AS sample_id FROM orders CROSS JOIN (VALUES ('filled'), ('empty')) c(condition) WHERE o_orderstatus <> 'P'),
seen AS (SELECT condition, sample_id, count(*) AS n FROM ({_PRED}) GROUP BY ALL),
b AS (SELECT coalesce(w.condition, s.condition) AS condition, w.sample_id IS NOT NULL AS w, coalesce(n, 0) AS n FROM want w FULL JOIN seen s ON w.condition = s.condition AND w.sample_id = s.sample_id)
SELECT condition, count(*) FILTER (w AND n = 0) AS missing, count(*) FILTER (NOT w) AS extra, count(*) FILTER (n > 1) AS duplicates,
  count(*) FILTER (w AND n = 0) = 0 AND count(*) FILTER (NOT w) = 0 AND count(*) FILTER (n > 1) = 0 AS complete FROM b GROUP BY condition""")
def detail_audit_anti(t):
    spark = t("orders").sparkSession
    both = spark.createDataFrame([("filled",), ("empty",)], "condition string")
    want = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("sample_id")).crossJoin(F.broadcast(both))  # two rows
    return G.detail_audit(want, _predictions(t), ["condition"])


@query(f"""
SELECT sample_id FROM ({_PRED}) GROUP BY sample_id HAVING count(DISTINCT model || '/' || condition) = 4""")
def common_support_division(t):
    return G.common_support(_predictions(t), F.concat_ws("/", "model", "condition"), ["sample_id"], 4)


@query("""
WITH a AS (SELECT doc_id AS sample_id, lang, 'main' AS root, 0 AS o, sha256(text) AS h FROM documents
  UNION ALL SELECT doc_id, lang, 'overlay', 1, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) FROM documents WHERE lang = 'en')
SELECT lang, sample_id, count(*) AS roots, count(DISTINCT h) AS versions, arg_min(root, o) AS root, count(DISTINCT h) > 1 AS conflict FROM a GROUP BY lang, sample_id""")
def overlay_conflicts(t):
    d = t("documents").select(F.col("doc_id").alias("sample_id"), "lang", "text")
    main = d.select("sample_id", "lang", F.lit("main").alias("root"), F.lit(0).alias("root_order"), F.lit("0").alias("stage"), F.sha2("text", 256).alias("sha256"))
    altered = F.when(F.col("sample_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    over = d.where("lang = 'en'").select("sample_id", "lang", F.lit("overlay").alias("root"), F.lit(1).alias("root_order"), F.lit("0").alias("stage"), F.sha2(altered, 256).alias("sha256"))
    return G.overlay(main.unionByName(over))


_MERGED = """
SELECT lang, doc_id AS sample_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS roots, 'main' AS root, doc_id % 13 <> 0 AS has_core,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 13 <> 0 AND doc_id % 5 = 0 THEN 'conflicting sample' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'conflicting auxiliary'
  WHEN doc_id % 2 = 0 AND (doc_id % 13 = 0 OR doc_id % 17 = 0) THEN 'conflicting auxiliary' END AS issue FROM documents"""


def _roots(t):
    """Two roots; by key the second lacks, changes or adds stages."""
    k, d = F.col("sample_id"), t("documents").select(F.col("doc_id").alias("sample_id"), "lang", "text")
    mark = lambda s: F.sha2(F.concat(F.lit(s), "text"), 256)
    row = lambda stage, sha, issue=None: F.struct(F.lit(stage).alias("stage"), sha.alias("sha256"), F.when(sha.isNull(), F.lit(issue or "OSError")).alias("read_issue"))
    # Samples of every thirteenth key have auxiliaries only; of every seventeenth one core stage is unreadable.
    core = [row(s, F.when((k % 17 != 0) | F.lit(s != "meta"), mark(s))) for s in G.CORE]
    other = [row(s, F.when((k % 17 != 0) | F.lit(s != "meta"), F.when((k % 5 == 0) & F.lit(s == "context"), mark("changed")).otherwise(mark(s)))) for s in G.CORE]
    cores = lambda rows: F.when(k % 13 == 0, F.array().cast("array<struct<stage:string,sha256:string,read_issue:string>>")).otherwise(F.array(*rows))
    one = F.concat(cores(core), F.array(row("html_second", mark("h"))))
    more = F.when(k % 2 == 0, F.array(row("png_empty", mark("p")))).otherwise(F.array().cast("array<struct<stage:string,sha256:string,read_issue:string>>"))
    changed = F.when(k % 7 == 0, mark("other")).when(k % 11 != 0, mark("h"))
    two = F.concat(cores(other), F.array(row("html_second", changed)), more)
    at = lambda rows, name, order: d.select("lang", "sample_id", F.inline(rows), F.lit(name).alias("root"), F.lit(order).alias("root_order"))
    return at(one, "main", 0).unionByName(at(two, "overlay", 1).where("sample_id % 3 <> 0"))


@query(_MERGED)
def merged_roots(t):
    """Roots that agree, differ in core or auxiliary stages, or cannot be read."""
    return G.merged_roots(_roots(t)).select("lang", "sample_id", F.col("roots").cast("int").alias("roots"), "root", "has_core", "issue")


@query("""
SELECT CASE WHEN doc_id % 4 = 0 THEN '0' || doc_id ELSE '' || doc_id END AS first_name, CASE WHEN doc_id % 4 = 0 THEN 'noncanonical' ELSE 'repeated' END AS issue
FROM documents WHERE doc_id > 0 AND (doc_id % 4 = 0 OR doc_id % 6 = 1) UNION ALL SELECT '0', 'noncanonical' FROM documents WHERE doc_id = 0""")
def wrong_file_names(t):
    """Numbers with leading zeros, zero, and numbers that two files have; other names are no samples."""
    k = F.col("doc_id")
    own = k.cast("string")
    names = F.when((k % 4 == 0) & (k > 0), F.array(F.concat(F.lit("0"), own), F.concat(own, F.lit("a")))).when(k % 6 == 1, F.array(own, own)).otherwise(F.array(own))
    files = t("documents").select(F.lit("main").alias("root"), F.lit("meta").alias("stage"), "lang", F.explode(names).alias("name"))
    return G.wrong_names(files).select(F.element_at("names", 1).alias("first_name"), "issue")


@query("""
WITH n AS (SELECT o_orderkey, sha1(CAST(o_totalprice AS BIGINT) || CASE WHEN o_orderkey % 9 = 0 THEN '*' ELSE '' END) AS mark FROM orders), o AS (SELECT o_orderkey, sha1('' || CAST(o_totalprice AS BIGINT)) AS mark FROM orders WHERE o_orderstatus <> 'P')
SELECT n.o_orderkey AS sample_id, o.o_orderkey IS NOT NULL AS reused FROM n LEFT JOIN o ON n.o_orderkey = o.o_orderkey AND n.mark = o.mark""")
def resume_reuse(t):
    price = F.col("o_totalprice").cast("decimal(20,0)").cast("string")
    new = t("orders").select(F.col("o_orderkey").alias("sample_id"), F.sha1(F.concat(price, F.when(F.col("o_orderkey") % 9 == 0, "*").otherwise(""))).alias("mark"))
    old = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("sample_id"), F.sha1(price).alias("mark"))
    kept, rest = K.reuse(new, old, ["sample_id"], ["mark"])
    return kept.select("sample_id", F.lit(True).alias("reused")).unionByName(rest.select("sample_id", F.lit(False).alias("reused")))


@query("""
SELECT o_orderkey AS sample_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'process' WHEN o_orderpriority = '2-HIGH' THEN 'skip' WHEN o_orderstatus = 'F' THEN 'refresh' ELSE 'process' END AS action FROM orders""")
def work_plan_actions(t):
    base = t("orders").select(F.col("o_orderkey").alias("sample_id"), "o_orderpriority", "o_orderstatus")
    inputs = base.select("sample_id", F.lit(100).alias("in_mtime"))
    outputs = base.where("o_orderpriority <> '1-URGENT'").select("sample_id", F.when(F.col("o_orderstatus") == "F", 120).otherwise(90).alias("out_mtime"))
    state = base.where("o_orderpriority = '2-HIGH'").select("sample_id", F.lit(100).alias("state_mtime"))
    return K.actions(inputs, outputs, state, ["sample_id"])


@query("""
SELECT o_orderkey AS sample_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')""")
def pending_jobs_anti(t):
    return K.pending(t("orders").select(F.col("o_orderkey").alias("sample_id")), _predictions(t), ["sample_id"])


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new' ELSE 'old' END AS origin, CASE WHEN c_mktsegment = 'BUILDING' THEN 'X' ELSE c_mktsegment END AS value FROM customer""")
def latest_upsert(t):
    old = t("customer").select("c_custkey", F.lit("old").alias("origin"), F.col("c_mktsegment").alias("value"))
    new = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("new").alias("origin"), F.lit("X").alias("value"))
    return K.upsert(old, new, ["c_custkey"])


@query("""
WITH l AS (SELECT DISTINCT p_type AS label FROM part)
SELECT p_partkey, label FROM part JOIN l ON contains(lower(p_name || ' ' || p_type), lower(label))""")
def label_containment_join(t):
    """Cells whose label text holds a label's."""
    cells = t("part").select("p_partkey", X.field_text(F.concat_ws(" ", "p_name", "p_type")).alias("cell"))
    labels = t("part").select(F.col("p_type").alias("label")).distinct().withColumn("bare", X.field_text(F.col("label")))
    found = O.containing(cells, labels.select("bare"), ["p_partkey"], "cell", "bare")
    return found.join(labels, "bare").select("p_partkey", "label")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber // 3 AS r, l_linenumber % 3 AS col, l_returnflag AS flag, l_partkey AS tie FROM lineitem),
j AS (SELECT p.l_orderkey, p.l_linenumber, p.tie, l.l_linenumber AS label, row_number() OVER (PARTITION BY p.l_orderkey, p.l_linenumber, p.tie ORDER BY
  CASE WHEN l.r = p.r AND l.col = p.col THEN 0 WHEN l.r = p.r AND l.col < p.col THEN 1 WHEN l.r < p.r THEN 2 ELSE 3 END,
  CASE WHEN l.r = p.r AND l.col = p.col THEN 0 WHEN l.col = p.col THEN 0 ELSE 1 END, abs(l.r - p.r) + abs(l.col - p.col), l.l_linenumber, l.tie) AS n
  FROM c p JOIN c l ON p.l_orderkey = l.l_orderkey AND p.flag = 'N' AND l.flag <> 'N')
SELECT l_orderkey, l_linenumber, tie, label FROM j WHERE n = 1""")
def nearest_label(t):
    """Each marker's nearest label in its document, by direction, column, distance and order."""
    n = F.col("l_linenumber")
    cells = t("lineitem").select("l_orderkey", n, F.floor(n / 3).alias("r"), (n % 3).alias("c"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("tie"))
    return O.nearest_labels(cells.where("flag = 'N'"), cells.where("flag <> 'N'"), ["l_orderkey"], ["l_linenumber", "tie"]).select("l_orderkey", "l_linenumber", "tie", F.col("label_l_linenumber").alias("label"))


@query("""
WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT e.user_id, e.event_type, e.event_id, sum(new) OVER (PARTITION BY e.user_id ORDER BY v.ts, e.event_id ROWS UNBOUNDED PRECEDING) AS run FROM e JOIN events v USING (event_id))
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run, event_type""")
def adjacent_runs(t):
    """Runs of equal neighbours in order: gaps and islands."""
    e = t("events").select("user_id", "event_type", "event_id", "ts")
    runs = O.runs(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type"))
    return runs.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM d)
SELECT l_orderkey, CAST(min(l_linenumber) AS INTEGER) AS first, count(*) AS n FROM g GROUP BY l_orderkey, g""")
def gap_sessions_by_index(t):
    """Consecutive numbers of a document; an order holds a handful of lines."""
    return O.sequences(t("lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
WITH f AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey FROM f WHERE n <= 2""")
def limit_per_combo(t):
    return G.first_by(t("orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")], 2).select("o_orderkey")


@query("""
SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_identity(t):
    return G.repeated(t("documents").withColumn("sha256", F.sha2("text", 256)), ["sha256"], "doc_id")


@query("""
SELECT p.page_id FROM pages p ANTI JOIN documents d ON p.page_id = d.doc_id * 2""")
def manifest_unlisted(t):
    listed = t("documents").select((F.col("doc_id") * 2).alias("page_id"))
    return G.unlisted(t("pages").select("page_id"), listed, ["page_id"])


@query("""
WITH b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O'), t AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R')
SELECT b.l_orderkey FROM b SEMI JOIN t USING (l_orderkey)""")
def base_tuned_intersection(t):
    rows = t("lineitem").select("l_orderkey", "l_linestatus", "l_returnflag")
    return G.intersection(rows.where("l_linestatus = 'O'").select("l_orderkey").distinct(), rows.where("l_linestatus = 'F' and l_returnflag <> 'R'").select("l_orderkey").distinct(), ["l_orderkey"])


@query("""
WITH r AS (SELECT o_orderstatus, o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders))
SELECT o_orderstatus, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_custkey) AS preview FROM r WHERE n <= 20 GROUP BY o_orderstatus""")
def id_preview(t):
    out = G.preview(t("orders"), ["o_orderstatus"], "o_custkey", 20)
    return out.select("o_orderstatus", F.array_join(F.transform("preview", lambda x: x.cast("string")), ",").alias("preview"))
