"""Text functions, prompts and records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import jobs as J
from .registry import query


@query(r"""
SELECT part.p_partkey, regexp_replace(lower(p_name || ' (' || p_brand || '): ' || p_type), '[\s\[\]{}()<>:,.;!?''"`_\-/\\|~]', '', 'g') AS label,
  regexp_replace(regexp_replace(regexp_replace(lower('12 ' || p_brand), '[\s\[\]{}()<>:,.;!?''"`_\-/\\|~]', '', 'g'), '^\d+', ''), '\d+$', '') AS field,
  lower(regexp_replace(p_brand || '_' || p_name, '[^A-Za-z0-9]+', '', 'g')) AS word FROM part""")
def normalize_label(t):
    whole = F.concat("p_name", F.lit(" ("), "p_brand", F.lit("): "), "p_type")
    return t("part").select("p_partkey", X.label_text(whole).alias("label"), X.field_text(F.concat(F.lit("12 "), "p_brand")).alias("field"), X.word_text(F.concat("p_brand", F.lit("_"), "p_name")).alias("word"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE o_orderpriority || ' ' || o_orderstatus END AS answer FROM orders""")
def strip_thinking(t):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("<THINK mode=a>one\ntwo</think>\n "), "o_orderpriority", F.lit(" </s>"))).when(k == 1, F.concat(F.lit("<think>a<think/>"), "o_orderstatus", F.lit("<|endoftext|><eos> "))).otherwise(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus"))
    return t("orders").select("o_orderkey", X.without_thinking(raw).alias("answer"))


@query("""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS domain,
  coalesce(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') LIKE '%.gov' OR regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') LIKE '%.mil', false) AS public FROM pages""".replace("\\\\", "\\"))
def domain_filter_forall(t):
    found = t("pages").select("page_id", X.domains(F.col("url")).alias("d"))
    return found.select("page_id", F.coalesce(F.get("d", 0), F.lit("")).alias("domain"), X.all_public(F.col("d")).alias("public"))


@query("""
SELECT o_orderkey, regexp_extract(k, '^(.+?)(\\d+)$', 1) AS base, regexp_extract(k, '^(.+?)(\\d+)$', 2) AS idx,
  regexp_replace('[Form-' || o_orderstatus || '-' || k || ']', '\\[[^\\]]*-([^\\]-]*)\\]', '[\\1]') AS cleaned
FROM (SELECT o_orderkey, o_orderstatus, 'Item' || o_orderkey AS k FROM orders)""".replace("\\\\", "\\"))
def marker_names(t):
    k = F.concat(F.lit("Item"), F.col("o_orderkey").cast("string"))
    name = X.indexed_name(k)
    return t("orders").select("o_orderkey", name["base"].alias("base"), name["index"].alias("idx"), X.unqualified(F.concat(F.lit("[Form-"), "o_orderstatus", F.lit("-"), k, F.lit("]"))).alias("cleaned"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(greatest(1, coalesce(TRY_CAST(nullif(regexp_extract(s, '\\d+', 0), '') AS INTEGER), 1)) AS INTEGER) AS loose,
  CAST(CASE WHEN TRY_CAST(trim(s) AS INTEGER) > 0 THEN TRY_CAST(trim(s) AS INTEGER) ELSE 1 END AS INTEGER) AS strict
FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_linenumber || 'px' WHEN 1 THEN '' || l_linenumber WHEN 2 THEN '0' ELSE 'none' END AS s FROM lineitem)""".replace("\\\\", "\\"))
def span_parsing(t):
    n = F.col("l_linenumber")
    s = F.when(n % 4 == 0, F.concat(n.cast("string"), F.lit("px"))).when(n % 4 == 1, n.cast("string")).when(n % 4 == 2, "0").otherwise("none")
    return t("lineitem").select("l_orderkey", "l_linenumber", X.span_of(s).alias("loose"), X.strict_span(s).alias("strict"))


@query(r"""
SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND trim(text) <> '' THEN sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) END AS verified FROM documents""")
def sha_verify(t):
    """Sources whose recorded digest still holds, with the digest of their text; changed and unreadable ones have none."""
    from ..sources.files import verified_text

    k, content = F.col("doc_id"), F.col("text").cast("binary")
    recorded = F.when(k % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2(content, 256))
    text = verified_text(content, recorded, F.when(k % 7 == 0, "unreadable"))
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), F.sha2(text, 256).alias("verified"))


@query(f"""
SELECT doc_id, sha256({J.sql_prompt('infill', 'empty', "'<table><tr><td>' || source || '</td></tr></table>'", 'text')}) AS infill,
  sha256({J.sql_prompt('schema', 'filled', "'<p>' || lang || '</p>'")}) AS schema, sha256({J.sql_prompt('alignment', 'empty', "'<p>' || lang || '</p>'")}) AS alignment FROM documents""")
def prompt_build(t):
    table = F.concat(F.lit("<table><tr><td>"), "source", F.lit("</td></tr></table>"))
    p = F.concat(F.lit("<p>"), "lang", F.lit("</p>"))
    return t("documents").select("doc_id", F.sha2(J.prompt("infill", "empty", table, F.col("text")), 256).alias("infill"), F.sha2(J.prompt("schema", "filled", p), 256).alias("schema"), F.sha2(J.prompt("alignment", "empty", p), 256).alias("alignment"))


@query("""
SELECT conv_id, 'conv_' || conv_id AS id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def message_records(t):
    rows = J.message_records(t("conversations"), "conv_id", "turn")
    return rows.select("conv_id", F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("id"), F.size("messages").cast("long").alias("messages"), F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.char_length(m["content"])).alias("chars"), F.array_join(F.transform("messages", lambda m: m["role"]), ">").alias("roles"))


@query("""
SELECT task, lang, count(*) AS records, CAST(max(n) AS BIGINT) AS max_chars, CAST(floor(avg(n)) AS BIGINT) AS avg_chars FROM (SELECT source AS task, lang, length(text) AS n FROM documents) GROUP BY task, lang""")
def record_summary(t):
    return J.record_summary(t("documents").select(F.col("source").alias("task"), "lang", F.col("text").alias("completion")), ["task", "lang"])


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'too_large' WHEN 1 THEN 'missing_model' WHEN 2 THEN 'fallback_to_chat' ELSE 'other' END AS class FROM events""")
def api_error_classes(t):
    k = F.col("event_id") % 4
    m = F.when(k == 0, "Request Entity TOO LARGE").when(k == 1, "you must provide a model parameter").when(k == 2, "404: endpoint Not Found").otherwise("timeout")
    return t("events").select("event_id", X.api_error(m).alias("class"))


_TOKENS = r"regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{L}\p{N}_%$€£¥]+')"


@query(rf"""
SELECT conv_id, turn, len({_TOKENS}) AS n, sha256(array_to_string({_TOKENS}, ' ')) AS tokens, sha256(array_to_string(list_sort({_TOKENS}), ' ')) AS multiset,
  len({_TOKENS}) >= 2 AND {_TOKENS} <> {_TOKENS.replace('(text)', "(array_to_string(string_split(text, ' ')[2:], ' ') || ' ' || string_split(text, ' ')[1])")} AS reordered FROM conversations""")
def content_token_multiset(t):
    """Words in order and as a multiset; a text whose first word goes last has the same multiset."""
    words = F.split("text", " ")
    turned = F.concat(F.array_join(F.slice(words, 2, F.size(words)), " "), F.lit(" "), words[0])
    tokens = X.content_tokens("text")
    rows = t("conversations").select("conv_id", "turn", tokens.alias("a"), X.content_tokens(turned).alias("b"))
    digest = lambda c: F.sha2(F.array_join(c, " "), 256)
    reordered = (F.array_sort("a") == F.array_sort("b")) & (F.col("a") != F.col("b")) & (F.size("a") >= 2)
    return rows.select("conv_id", "turn", F.size("a").cast("long").alias("n"), digest("a").alias("tokens"), digest(F.array_sort("a")).alias("multiset"), reordered.alias("reordered"))


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN 'QA' WHEN 3 THEN 'QA' ELSE 'FT' END AS method,
  CAST(CASE c_custkey % 6 WHEN 1 THEN c_custkey % 9 WHEN 3 THEN c_custkey % 9 ELSE 0 END AS INTEGER) AS version FROM customer""")
def model_names(t):
    """The method and version that a tuned model's name tells."""
    k, n = F.col("c_custkey") % 6, (F.col("c_custkey") % 9).cast("string")
    tail = F.when(k == 0, "_InfillFT").when(k == 1, F.concat(F.lit("-infillft v"), n)).when(k == 2, "-QA").when(k == 3, F.concat(F.lit(" QA_"), n)).when(k == 4, F.concat(F.lit("-qabc-v"), n)).otherwise("-InfillFT-seed=3")
    name = F.concat(F.lit("Org/Some-7B"), tail)
    method = X.tuning_method(name)
    return t("customer").select("c_custkey", method.alias("method"), X.tuned_version(name, method).alias("version"))
