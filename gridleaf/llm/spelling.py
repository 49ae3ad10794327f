"""Spelling variants: words one edit apart, and the frequent form behind a rare one.

An even-partition pigeonhole join. A word of l letters is indexed by its two
even segments (l // 2 letters and the rest); of two words one edit apart, the
edit lies in one segment and the other is intact. A word probes the index with
the substrings that stand where an intact segment would be: those of words of
its own length at the same place, those of words one letter shorter shifted by
one behind the edit. Candidates are verified by one edit.

A pair can be met by several segments. It counts where the edit comes last:
a candidate whose damaged segment is followed by others is left out if the two
words also agree up to that segment's end. So no pair is listed twice, and no
shuffle is needed to remove repeats.

A segment that more than MOST rows share is cut evenly again, its damaged part
becoming two, until groups are small or the damaged part has a single letter;
a group then holds only words that differ in that letter. So no group lists
pairs by the square of the vocabulary, and none is capped.

Defined results: null and empty texts have no words, a null doc_id counts as an
empty one; very long words and texts are read whole; of near words with equal
counts the first in code-point order is the form; rows that repeat a doc_id
count each, their damaged words alike; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one key up to which they are compared with each other.
MOST = 256


def vocabulary(docs: DataFrame, ident: str = "doc_id", text: str = "text", letters: int = 7, least: int = 2, damage: int = 31) -> DataFrame:
    """word, n: lower-cased runs of letters of at least `letters` code points
    that occur `least` times. A run whose hash with its document is divisible by
    `damage` loses one letter first, so that variants are there to be found."""
    runs = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    rows = rows.select("run", h.alias("h"), at.alias("at"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.char_length("run")))
    words = rows.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _intact(word: str, role: str = "longer", a: str = "a", b: str = "b") -> list[Column]:
    """What stands before and behind the damaged part [a, b) of the shorter word."""
    w, extra = F.col(word), F.col(role).cast("int")
    return [F.substring(w, F.lit(1), F.col(a)), F.substring(w, F.col(b) + 1 + extra, F.char_length(w))]


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of each row's damaged part, with their keys."""
    middle = (F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)).cast("int")
    parts = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    out = rows.select("word", "n", "l", "longer", F.inline(parts))
    return out.withColumn("key", F.xxhash64("l", "a", "b", *_intact("word")))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """x, xn, y, yn: each pair of different words (word, n) one edit apart, once."""
    n = F.char_length("word")
    roles = F.array(*(F.struct((n - k).alias("l"), F.lit(0).alias("a"), (n - k).alias("b"), F.lit(k == 1).alias("longer")) for k in (0, 1)))
    rows = _halves(words.where("word <> ''").select("word", "n", F.inline(roles)))
    pairs = []
    while True:
        crowded = written(rows.where("b - a > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("key"), "crowded")
        if crowded.isEmpty():
            pairs.append(_verified(rows))
            break
        pairs.append(_verified(rows.join(crowded, "key", "left_anti")))
        rows = written(_halves(rows.join(crowded, "key", "left_semi")), "halves")
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def _verified(rows: DataFrame) -> DataFrame:
    x = rows.select(*(F.col(c).alias(f"x_{c}") for c in rows.columns))
    y = rows.where(~F.col("longer")).select(*(F.col(c).alias(f"y_{c}") for c in rows.columns))
    same = [F.col(f"x_{c}") == F.col(f"y_{c}") for c in ("l", "a", "b")]
    ends = [p == q for p, q in zip(_intact("x_word", "x_longer", "x_a", "x_b"), _intact("y_word", "y_longer", "y_a", "y_b"), strict=True)]
    one = F.levenshtein("x_word", "y_word", 1) == 1
    upto = lambda w: F.substring(F.col(w), F.lit(1), F.col("y_b"))
    last = (F.col("y_b") == F.col("y_l")) | (upto("x_word") != upto("y_word"))
    once = F.col("x_longer") | (F.col("x_word") > F.col("y_word"))
    met = x.join(y, F.col("x_key") == F.col("y_key")).where(once)
    for c in (*same, *ends, last, one):
        met = met.where(c)
    return met.select(F.col("x_word").alias("x"), F.col("x_n").alias("xn"), F.col("y_word").alias("y"), F.col("y_n").alias("yn"))


def forms(words: DataFrame, pairs: DataFrame, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n, if that is `times` the word's."""
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(f"{b}n").alias("other_n"))
    both = pairs.select(F.inline(F.array(way("x", "y"), way("y", "x"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    often = -F.col("best.m") >= times * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word, root: where the forms of each word that has one end. Each round
    doubles the steps; counts grow tenfold a step, so rounds are few."""
    at = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        a, b = at.alias("a"), at.alias("b")
        nxt = written(a.join(b, F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "roots")
        at = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    with scratch(docs.sparkSession):
        words = written(vocabulary(docs, ident, text), "words")
        found = written(forms(words, near_words(words)), "forms")
        out = found.join(roots(found), "word", "left")
        return written(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants", keep=True)


ORACLE_SQL = r"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, encode(doc_id || ':' || run) AS said FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(said)), lambda i: ('0x' || substr(hex(said), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM counted, crc),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
steps(word, goal, k) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN formed f ON f.word = s.goal WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(goal, k) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)
"""
