"""Importance resampling of documents towards a target, by hashed word n-grams.

Texts become a table of positions (posexplode); a window's lead() over each
document sets the following words behind each word, which gives the runs of
every order; their buckets are counted in corpus and target, and the gains of
the buckets (at most as many rows as there are buckets) are joined back and
summed for each document. A Gumbel draw per document makes the highest scores
a sample without replacement.

Runs of one word need no following word, so no window and no shuffle of words:
each pass over the texts is pre-aggregated in its tasks. With longer runs the
words of a document meet in one task, and the counts of its buckets are
written once for both passes.

Defined results: null and empty texts have no features, weight 0 and are never
drawn; a null doc_id counts as an empty one in the draw and comes first among
equal scores; very long texts are read whole; of equal scores the smaller
doc_id is drawn; rows are independent, so repeated rows repeat their result and
take ranks of their own; an empty corpus gives an empty result, an empty target
leaves the gains to the corpus; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The complement of [\x00-\x2F\x3A-\x60\x7B-\x7F] and capitals, which Java matches much faster in this form.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Buckets up to which their gains go to every task; beyond, they are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """word with A-Z in lower case; lower() changes just those where all is ASCII."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def features(docs: DataFrame, ident: str, text: str, orders: int, buckets: int) -> DataFrame:
    """row, ident, bucket, n (repeats) and n_words (those of one word) of each
    document's features; a document without words has one row without bucket."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("ident"), F.col(text).alias("text"))
    places = rows.select("row", "ident", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    places = places.withColumn("word", lowered(F.col("word")))
    following = W.partitionBy("row").orderBy("pos")
    runs = [F.col("word")]
    for k in range(1, orders):
        runs.append(F.concat(runs[-1], F.lit(" "), F.lead("word", k).over(following)))  # null where the text ends
    found = places.select("row", "ident", *(r.alias(f"run{k}") for k, r in enumerate(runs)))
    if orders == 1:
        cut = found.select("row", "ident", F.col("run0").alias("run"), F.lit(True).alias("single"))
    else:
        some = F.array(*(F.struct(F.col(f"run{k}").alias("run"), F.lit(k == 0).alias("single")) for k in range(orders)))
        cut = found.select("row", "ident", F.inline(F.filter(some, lambda x: x["single"] | x["run"].isNotNull())))
    one = F.col("run").isNotNull().cast("long")
    cut = cut.select("row", "ident", (F.crc32("run") % buckets).alias("bucket"), one.alias("n"), F.when(F.col("single"), one).otherwise(0).alias("n_words"))
    if orders == 1:
        return cut
    return written(cut.groupBy("row", "ident", "bucket").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words")), "features")


def gains(corpus: DataFrame, target: DataFrame, buckets: int, unit: int) -> DataFrame:
    """bucket, gain: how much likelier its features are in the target, with one
    added to each bucket, in whole units of 1/unit nats, rounded down."""
    count = lambda d, c: d.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias(c))
    both = written(count(corpus, "s").join(count(target, "t"), "bucket", "full").na.fill(0), "bucket-counts")
    all_s, all_t = (float(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return both.where("s > 0").select("bucket", F.floor(unit * F.log(ratio)).alias("gain"))


def draw(ident: Column, seed: int, unit: int) -> Column:
    """A Gumbel draw of an id, in whole units, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-unit * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text", orders: int = 1, buckets: int = 10_000, share: int = 10, least: int = 20, seed: int = 2024, unit: int = 1000) -> DataFrame:
    """ident, n_features, weight, score, rank of each document: rank counts the
    share (percent, rounded down) of documents of at least `least` words that
    have the highest scores, and is null for the rest."""
    spark = docs.sparkSession
    with scratch(spark):
        found = features(docs, ident, text, orders, buckets)
        table = gains(found, features(target.select(F.lit(None).alias("none"), text), "none", text, orders, buckets), buckets, unit)
        side = F.broadcast(table) if buckets <= BROADCAST_BUCKETS else table
        weighed = found.join(side, "bucket", "left").groupBy("row", "ident").agg(
            F.sum("n").alias("n_features"), F.sum("n_words").alias("n_words"), F.coalesce(F.sum(F.col("n") * F.col("gain")), F.lit(0)).alias("weight")
        )
        scored = weighed.select("ident", "n_features", "weight", (F.col("weight") + draw(F.col("ident"), seed, unit)).alias("score"), (F.col("n_words") >= least).alias("fit"))
        placed = numbered(scored, [F.col("fit").desc(), F.col("score").desc(), F.col("ident").asc()])
        drawn = placed.where("fit").count() * share // 100
    rank = F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("ident").alias(ident), "n_features", "weight", "score", rank.alias("rank"))


ORACLE_SQL = r"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
own AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
counted AS (SELECT doc_id, w, count(*) AS n FROM own GROUP BY ALL),
seen AS (SELECT DISTINCT w FROM (SELECT w FROM counted UNION ALL SELECT w FROM aim)),
hashed AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM seen, crc),
s AS (SELECT bucket, sum(n) AS s FROM counted JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (w) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM s) AS all_s, (SELECT coalesce(sum(t), 0)::DOUBLE FROM t) AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
weighed AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS p, count(*) OVER () * 10 // 100 AS k FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= k THEN p END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
