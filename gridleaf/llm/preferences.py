"""Preference formatting of paired conversations, with DataFrame functions.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is a completion, in which
only the assistant's text counts for the loss. Masks are runs (length in code
points, 1 where the loss counts), the prompt's run being the first and 0.

A table of conversations holds two kinds of pairs. Siblings open with the same
turn: the one that went on for more assistant turns is chosen (its reader went
on asking), of equal ones the smaller conv_id. Stand-ins: a conversation is
chosen against itself up to one of its assistant turns, which its hash names,
with the turn so named of another conversation in its place, which does not
answer its prompt; so pairs part at all depths. Conversations of equal turns are
one, which the smallest conv_id stands for; n_copies counts them.

Siblings are paired with their neighbours along a fixed order of hashes, first
inside small groups of one opening, then between the groups' first members, so
that an opening of any number of conversations meets in no single task and all
of them are joined. The stand-in of an answer is the next one in the order of
all different answers' hashes, the first following the last, so every
conversation has one unless all answers of the table are equal. Only ids and
hashes move while pairs are found; turns are joined last.

Defined results: null roles and texts are empty; rows without a conv_id belong
to no conversation; turns that share a number follow in the order of role and
text; repeated rows are repeated turns; a conversation without assistant turns
has no stand-in; very long texts are kept whole; empty tables give no pairs;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import scratch, written

#: Hexadecimal digits of the groups of one opening, from level to level.
LEVELS = (3, 1, 0)
#: Parts that the copies of one conversation are counted in.
SALTS = 16


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_copies and ordered turns, array<struct<role, text>>, of each
    conversation of different turns; the smallest conv_id stands for its copies."""
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    plain = ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    same = plain.select("conv_id", F.md5(F.to_json("turns").cast("binary")).alias("same"))
    # In two steps, so that no task meets all parts of a conversation with many copies; only ids and hashes move.
    parts = same.groupBy("same", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    first = parts.groupBy("same").agg(F.min("conv_id").alias("conv_id"), F.sum("n_copies").alias("n_copies"))
    return plain.join(first.drop("same"), "conv_id").select("conv_id", "n_copies", "turns")


def answer_place(ident: Column, turns: Column) -> Column:
    """The place, from 1, of the assistant turn that the id's hash names; 0 without one."""
    own = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda x: x.isNotNull())
    named = F.conv(F.substring(F.md5(ident.cast("string").cast("binary")), 1, 4), 16, 10).cast("int")
    return F.when(F.size(own) > 0, F.element_at(own, (named % F.greatest(F.size(own), F.lit(1)) + 1).cast("int"))).otherwise(0)


def heads(convs: DataFrame) -> DataFrame:
    """conv_id, h (its hash), opening (hash of the first turn), n_answers and
    answer (hash of the text of the assistant turn at answer_place, if there is one)."""
    own = F.filter("turns", lambda t: t["role"] == "assistant")
    first, place = F.col("turns")[0], answer_place(F.col("conv_id"), F.col("turns"))
    text = F.element_at("turns", F.greatest(place, F.lit(1)))["text"]
    return convs.select("conv_id", F.md5(F.col("conv_id").cast("string").cast("binary")).alias("h"), F.md5(F.concat(first["role"], F.lit("\n"), first["text"]).cast("binary")).alias("opening"), F.size(own).alias("n_answers"), F.when(place > 0, F.md5(text.cast("binary"))).alias("answer"))


def siblings(found: DataFrame) -> DataFrame:
    """chosen_id and rejected_id of neighbours among the conversations of one opening."""
    rows, out = found.select("opening", "h", "conv_id", "n_answers"), None
    for digits in LEVELS:
        group = ["opening", F.substring("h", 1, digits)]
        order = W.partitionBy(*group).orderBy("h", "conv_id")
        seen = rows.withColumn("at", F.row_number().over(order))
        for c in ("conv_id", "n_answers"):
            seen = seen.withColumn(f"next_{c}", F.lead(c).over(order))
        met = seen.where("next_conv_id is not null")
        ahead = (F.col("n_answers") > F.col("next_n_answers")) | ((F.col("n_answers") == F.col("next_n_answers")) & (F.col("conv_id") < F.col("next_conv_id")))
        pairs = met.select(F.when(ahead, F.col("conv_id")).otherwise(F.col("next_conv_id")).alias("chosen_id"), F.when(ahead, F.col("next_conv_id")).otherwise(F.col("conv_id")).alias("rejected_id"))
        out = pairs if out is None else out.unionByName(pairs)
        rows = seen.where("at = 1").select(rows.columns)
    return out


def stand_ins(found: DataFrame) -> DataFrame:
    """chosen_id and rejected_id, whose answer stands in for the chosen one's:
    the next different one by hash, of which the smallest conversation is taken."""
    some = found.where("answer IS NOT NULL").select("conv_id", "answer")
    placed = numbered(some.groupBy("answer").agg(F.min("conv_id").alias("other")), [F.col("answer")])
    n = placed.count()
    before = F.when(F.col("place") == 1, n).otherwise(F.col("place") - 1)
    following = placed.select(before.alias("place"), F.col("other").alias("rejected_id"))
    drawn = placed.select("answer", "place").join(following, "place") if n > 1 else placed.where("false").select("answer", F.col("other").alias("rejected_id"))
    return some.join(drawn, "answer").select(F.col("conv_id").alias("chosen_id"), "rejected_id")


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def _mask(prompt: Column, turns: Column) -> Column:
    """Runs as 'length:loss', comma-joined; a header and its final line break never count."""

    def runs(t):
        head = F.char_length(t["role"]) + 5
        body = F.char_length(t["text"])
        own = t["role"] == "assistant"
        return F.when(own, F.concat(head.cast("string"), F.lit(":0,"), body.cast("string"), F.lit(":1,1:0"))).otherwise(F.concat((head + body + 1).cast("string"), F.lit(":0")))

    return F.array_join(F.concat(F.array(F.concat(F.char_length(prompt).cast("string"), F.lit(":0"))), F.transform(turns, runs)), ",")


def formatted(pairs: DataFrame, convs: DataFrame) -> DataFrame:
    """kind, chosen_id, rejected_id, n_copies (of the chosen one), prefix_turns,
    prompt, chosen, rejected, chosen_mask, rejected_mask of each pair (kind,
    chosen_id, rejected_id); the rejected side of a stand-in is the chosen
    conversation up to the answer that its hash names, and the other one's."""
    c = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"), "n_copies")
    r = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    both = pairs.join(c, "chosen_id").join(r, "rejected_id")
    at, theirs = answer_place(F.col("chosen_id"), F.col("c")), answer_place(F.col("rejected_id"), F.col("r"))
    replaced = F.concat(F.slice("c", F.lit(1), at - 1), F.slice("r", theirs, F.lit(1)))
    both = both.withColumn("r", F.when((F.col("kind") == "stand-in") & (at > 0) & (theirs > 0), replaced).otherwise(F.col("r")))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    both = both.withColumn("same", same)
    both = both.withColumn("k", F.when(F.array_position("same", False) > 0, F.array_position("same", False) - 1).otherwise(F.size("same")).cast("int"))
    both = both.withColumns({"prompt": _rendered(F.slice("c", F.lit(1), F.col("k"))), "ct": F.slice("c", F.col("k") + 1, F.size("c")), "rt": F.slice("r", F.col("k") + 1, F.size("r"))})
    return both.select("kind", "chosen_id", "rejected_id", "n_copies", F.col("k").cast("long").alias("prefix_turns"), "prompt", _rendered(F.col("ct")).alias("chosen"), _rendered(F.col("rt")).alias("rejected"), _mask(F.col("prompt"), F.col("ct")).alias("chosen_mask"), _mask(F.col("prompt"), F.col("rt")).alias("rejected_mask"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    convs = written(conversations(turns), "preferences", keep=True)
    with scratch(turns.sparkSession):
        found = written(heads(convs), "preferences-heads")
        pairs = siblings(found).withColumn("kind", F.lit("sibling")).unionByName(stand_ins(found).withColumn("kind", F.lit("stand-in")))
        pairs = written(pairs, "preferences-pairs", keep=True)
    return formatted(pairs, convs)


#: The same in DuckDB SQL over the view conversations.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
told AS (SELECT conv_id, list((role, text) ORDER BY pos) AS turns FROM t GROUP BY 1),
classes AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM told GROUP BY turns),
u AS (SELECT t.* FROM t JOIN classes USING (conv_id)),
own AS (SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM u WHERE role = 'assistant'),
named AS (SELECT conv_id, pos FROM own WHERE i = 1 + ('0x' || left(md5(CAST(conv_id AS VARCHAR)), 4))::INT % n),
ends AS (SELECT u.conv_id, count(*) FILTER (role = 'assistant') AS n_answers, any_value(named.pos) AS last FROM u LEFT JOIN named ON named.conv_id = u.conv_id GROUP BY u.conv_id),
heads AS (
  SELECT e.conv_id, md5(CAST(e.conv_id AS VARCHAR)) AS h, o.role AS orole, o.text AS otext, e.n_answers, e.last, md5(a.text) AS answer
  FROM ends e JOIN u o ON o.conv_id = e.conv_id AND o.pos = 1 LEFT JOIN u a ON a.conv_id = e.conv_id AND a.pos = e.last),
a1 AS (SELECT *, row_number() OVER w AS rn, lead(conv_id) OVER w AS nid, lead(n_answers) OVER w AS nn FROM heads WINDOW w AS (PARTITION BY orole, otext, left(h, 3) ORDER BY h, conv_id)),
a2 AS (SELECT conv_id, h, orole, otext, n_answers, row_number() OVER w AS rn, lead(conv_id) OVER w AS nid, lead(n_answers) OVER w AS nn FROM a1 WHERE rn = 1 WINDOW w AS (PARTITION BY orole, otext, left(h, 1) ORDER BY h, conv_id)),
a3 AS (SELECT conv_id, n_answers, lead(conv_id) OVER w AS nid, lead(n_answers) OVER w AS nn FROM a2 WHERE rn = 1 WINDOW w AS (PARTITION BY orole, otext ORDER BY h, conv_id)),
met AS (
  SELECT conv_id, n_answers, nid, nn FROM a1 UNION ALL SELECT conv_id, n_answers, nid, nn FROM a2 UNION ALL SELECT conv_id, n_answers, nid, nn FROM a3),
sib AS (
  SELECT 'sibling' AS kind, CASE WHEN ahead THEN conv_id ELSE nid END AS chosen_id, CASE WHEN ahead THEN nid ELSE conv_id END AS rejected_id
  FROM (SELECT *, n_answers > nn OR (n_answers = nn AND conv_id < nid) AS ahead FROM met WHERE nid IS NOT NULL)),
ranked AS (SELECT conv_id, dense_rank() OVER (ORDER BY answer) AS rk FROM heads WHERE last IS NOT NULL),
nexts AS (SELECT rk, min(conv_id) AS other, max(rk) OVER () AS most FROM ranked GROUP BY rk),
sta AS (
  SELECT 'stand-in' AS kind, r.conv_id AS chosen_id, n.other AS rejected_id
  FROM ranked r JOIN nexts n ON n.rk = CASE WHEN r.rk = n.most THEN 1 ELSE r.rk + 1 END WHERE n.most > 1),
pairs AS (SELECT * FROM sib UNION ALL SELECT * FROM sta),
c AS (SELECT p.kind, p.chosen_id, p.rejected_id, u.pos, u.role, u.text FROM pairs p JOIN u ON u.conv_id = p.chosen_id),
r AS (
  SELECT p.kind, p.chosen_id, p.rejected_id, u.pos, u.role, u.text FROM pairs p JOIN u ON u.conv_id = p.rejected_id WHERE p.kind = 'sibling'
  UNION ALL
  SELECT p.kind, p.chosen_id, p.rejected_id, u.pos, u.role, u.text FROM pairs p JOIN ends e ON e.conv_id = p.chosen_id JOIN u ON u.conv_id = p.chosen_id AND u.pos < e.last WHERE p.kind = 'stand-in'
  UNION ALL
  SELECT p.kind, p.chosen_id, p.rejected_id, e.last, u.role, u.text FROM pairs p JOIN ends e ON e.conv_id = p.chosen_id JOIN ends o ON o.conv_id = p.rejected_id JOIN u ON u.conv_id = p.rejected_id AND u.pos = o.last WHERE p.kind = 'stand-in'),
lcp AS (
  SELECT coalesce(c.kind, r.kind) AS kind, coalesce(c.chosen_id, r.chosen_id) AS chosen_id, coalesce(c.rejected_id, r.rejected_id) AS rejected_id,
         coalesce(min(CASE WHEN c.role = r.role AND c.text = r.text THEN NULL ELSE coalesce(c.pos, r.pos) END) - 1, count(*)) AS k
  FROM c FULL JOIN r ON c.kind = r.kind AND c.chosen_id = r.chosen_id AND c.rejected_id = r.rejected_id AND c.pos = r.pos GROUP BY ALL),
cc AS (
  SELECT c.kind, c.chosen_id, c.rejected_id, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) FILTER (pos <= k), '') AS prompt,
         coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) FILTER (pos > k), '') AS chosen,
         string_agg(CASE WHEN role = 'assistant' THEN (length(role) + 5) || ':0,' || length(text) || ':1,1:0' ELSE (length(role) + 6 + length(text)) || ':0' END, ',' ORDER BY pos) FILTER (pos > k) AS mask
  FROM c JOIN lcp USING (kind, chosen_id, rejected_id) GROUP BY ALL),
rr AS (
  SELECT r.kind, r.chosen_id, r.rejected_id, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) FILTER (pos > k), '') AS rejected,
         string_agg(CASE WHEN role = 'assistant' THEN (length(role) + 5) || ':0,' || length(text) || ':1,1:0' ELSE (length(role) + 6 + length(text)) || ':0' END, ',' ORDER BY pos) FILTER (pos > k) AS mask
  FROM r JOIN lcp USING (kind, chosen_id, rejected_id) GROUP BY ALL)
SELECT l.kind, l.chosen_id, l.rejected_id, x.n_copies, CAST(l.k AS BIGINT) AS prefix_turns, cc.prompt, cc.chosen, rr.rejected,
       concat_ws(',', length(cc.prompt) || ':0', cc.mask) AS chosen_mask, concat_ws(',', length(cc.prompt) || ':0', rr.mask) AS rejected_mask
FROM lcp l JOIN cc USING (kind, chosen_id, rejected_id) JOIN rr USING (kind, chosen_id, rejected_id) JOIN classes x ON x.conv_id = l.chosen_id
"""
