"""Near-duplicates by circulant MinHash, banding and exact verification.

Two fixed permutations of [0, 2^20) make every signature coordinate: the first
scatters the shingles, and coordinate k is the least value of the second one
shifted circularly by k. Bands of coordinates are hashed to buckets. In each
bucket all members are compared with the smallest member first, and, where
this leaves several components, with a few pseudo-random leaders. Members that
are still in different components meet through an exact prefix filter, which
pairs only those that share one of their rarest shingles at a place from which
the similarity can be reached; no bucket's pairs are listed. Every link is
confirmed on full sets.

Defined results: null and empty texts have no shingles and are linked with
nothing; texts with fewer words than a shingle have one, the whole sequence;
equal sets are one class and always linked; very long texts are read whole;
ties of leaders go by number, and no result depends on them; rows that repeat a
doc_id each get a row and keep the links of their own text (a null doc_id is no
component's least id); empty tables give empty results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, map_batches, mixed, scratch, unused, windows, written

SPACE = 1 << 20
BANDS, ROWS = 56, 6
#: Further leaders that a bucket gets where the first leaves several components.
LEADERS = 3
#: Members and those leaders are compared by one bit of each coordinate before
#: they are verified: similar sets differ in one of ten bits on average, and the
#: bound is this many standard deviations above that. It only saves work; what
#: it holds back still goes through the prefix filter.
DEVIATIONS = 6.5


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but ASCII white space."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(windows(cache.of(words(text)), width))


class Circulant:
    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.scatter = rng.permutation(SPACE).astype(np.int64)
        second = rng.permutation(SPACE).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)
        self.factors = rng.integers(1, 2**63, rows, np.uint64) | np.uint64(1)
        self.salts = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, sets: np.ndarray) -> np.ndarray:
        at = self.scatter[(sets & np.uint64(SPACE - 1)).astype(np.int64)]
        best = self.shifted[at[:256]].min(axis=0)
        for i in range(256, len(at), 256):
            np.minimum(best, self.shifted[at[i : i + 256]].min(axis=0), out=best)
        return best

    def buckets(self, sets: np.ndarray) -> np.ndarray:
        """One 64-bit key a band."""
        return self.keys_of(self.signature(sets))

    def keys_of(self, signature: np.ndarray) -> np.ndarray:
        by_band = signature.astype(np.uint64).reshape(self.bands, self.rows)
        return mixed((by_band * self.factors).sum(axis=1) + self.salts).view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, as 64-bit words."""
    bits = np.zeros(-(-len(signature) // 64) * 64, np.uint8)
    bits[: len(signature)] = signature & 1
    return np.packbits(bits).view(np.int64)


def bits_apart(coordinates: int, percent: int) -> int:
    """The most sketch bits in which similar sets may differ."""
    p = (1 - percent / 100) / 2
    return int(coordinates * p + DEVIATIONS * (coordinates * p * (1 - p)) ** 0.5) + 1


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def make():
        cache, circulant = WordHashes(), Circulant(bands, rows)

        def work(x):
            out = {"doc_id": x["doc_id"], "h": x["h"], "n": [], "set_id": [], "keys": [], "bits": []}
            for text in x["text"]:
                found = shingles(text, width, cache)
                out["n"].append(len(found))
                out["set_id"].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sign = circulant.signature(found) if len(found) else None
                out["keys"].append(None if sign is None else circulant.keys_of(sign))
                out["bits"].append(None if sign is None else sketch(sign))
            return out

        return work

    some = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return map_batches(some, "doc_id long, h long, n long, set_id binary, keys array<long>, bits array<long>", make)


def _fits(a: Column, b: Column, percent: int) -> Column:
    """What lengths must satisfy for the similarity to be reachable."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def make():
        cache, last = WordHashes(), [None, None]

        def work(x):
            out = {"u": [], "v": []}
            for u, v, a, b in zip(x["u"], x["v"], x["u_text"], x["v_text"], strict=True):
                if last[0] != u:
                    last[:] = u, shingles(a, width, cache)
                mine, other = last[1], shingles(b, width, cache)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    out["u"].append(u)
                    out["v"].append(v)
            return out

        return work

    joined = pairs.join(texts.select(F.col("rep").alias("v"), F.col("text").alias("v_text")), "v")
    joined = joined.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("u_text")), "u")
    return map_batches(joined.select("u", "v", "u_text", "v_text"), "u long, v long", make)


def components(edges: DataFrame, name: str = "minhash-cc") -> DataFrame:
    """(node, root) for the nodes of undirected edges (u, v), root being the
    smallest node that can be reached. Each round maps every node to its
    smallest neighbour's smallest neighbour and contracts the edges; stars are
    done in one round, chains in logarithmically many."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        up = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("up"))
        to = written(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"), name)
        tu, tv = (to.select(F.col("node").alias(c), F.col("top").alias(f"t{c}")) for c in "uv")
        edges = written(edges.join(tu, "u").join(tv, "v").where("tu <> tv").select(F.greatest("tu", "tv").alias("u"), F.least("tu", "tv").alias("v")).distinct(), name)
        if found is None:
            found = to.select("node", F.col("top").alias("root"))
        else:
            found = written(found.join(to.withColumnsRenamed({"node": "root"}), "root", "left").select("node", F.coalesce("top", "root").alias("root")), name)
    return found if found is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links; the graph of roots is all that is contracted."""
    at = roots.select(F.col("node").alias("x"), F.col("root").alias("r"))
    lifted = links
    for c in "uv":
        lifted = lifted.join(at.withColumnRenamed("x", c), c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
    new = components(lifted, "minhash-cc")
    to = new.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(old.unionByName(new.join(roots, "node", "left_anti")), "minhash-cc")


def _near(a: str, b: str, words_: int, apart: int) -> Column:
    """Whether the sketches in two structs or relations differ in few enough bits."""
    return sum((F.bit_count(F.col(f"{a}b{i}").bitwiseXOR(F.col(f"{b}b{i}"))) for i in range(words_)), F.lit(0)) <= apart


def _unsettled(shared: DataFrame, roots: DataFrame, bits: DataFrame) -> DataFrame:
    """Bucket rows (key, rep, n, root, sketch words) of the buckets that hold several components."""
    rows = shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    several = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    return written(rows.join(several, "key").join(bits, "rep"), "minhash-rest")


def _prefixes(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of members (rep, root) of different components that can be similar
    enough. In an order by rareness, the first common shingle of such a pair
    stands, on either side, before so many others that the overlap can still be
    reached. Nothing is left to chance, and sets that differ in more shingles of
    their own than the similarity allows make no pair, however many they are."""

    def make():
        cache = WordHashes()

        def work(x):
            sets = [shingles(text, width, cache).view(np.int64) for text in x["text"]]
            sizes = np.array([len(s) for s in sets])
            return {"rep": np.repeat(np.array(x["rep"], np.int64), sizes), "root": np.repeat(np.array(x["root"], np.int64), sizes), "n": np.repeat(sizes, sizes), "s": np.concatenate(sets)}

        return work

    from pyspark.sql import Window as W

    rows = written(map_batches(texts.join(members, "rep").select("rep", "root", "text"), "rep long, root long, n long, s long", make), "minhash-prefix")
    # A shingle of one component only makes no pair between components, but keeps its place in the order.
    often = rows.groupBy("s").agg(F.count("*").alias("df"), (F.min("root") != F.max("root")).alias("across"))
    order = W.partitionBy("rep").orderBy("df", "s")
    first = rows.join(often, "s").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("across")
    first = written(first.select("s", "rep", "root", "n", "at"), "minhash-prefix")
    a, b = first.alias("a"), first.alias("b")
    # What follows the first common shingle on either side bounds the overlap.
    reach = (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) + 1) * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n"))
    return a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.root") != F.col("b.root")) & _fits(F.col("a.n"), F.col("b.n"), percent) & reach).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return _judged(docs, width, percent, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The same with h, the hash of each row's text."""
    signed = written(_signed(docs, width, bands, rows), "minhash-signed", keep=True)
    with scratch(docs.sparkSession):
        labels = _labels(docs, signed, width, percent, bands, rows)
    # Rows without shingles have no set; each has a key of its own, so that they meet in no one task.
    out = signed.select("doc_id", "h", "n", F.coalesce("set_id", F.concat(F.lit("id "), F.col("doc_id").cast("string")).cast("binary"), F.lit("").cast("binary")).alias("set_id")).join(labels, "set_id", "left")
    top = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), top.alias("component_id"), F.coalesce(top == F.col("doc_id"), F.lit(True)).alias("kept"))


def _labels(docs: DataFrame, signed: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """component_id of each set_id. Classes of equal sets are told apart by a
    number of their own (rep), as rows of different sets may share a doc_id."""
    some = signed.where("n > 0")
    classes = some.groupBy("set_id").agg(F.min(F.struct("doc_id", "h")).alias("row"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "minhash-classes")
    apart, width_ = bits_apart(bands * rows, percent), -(-bands * rows // 64)
    words_ = [f"b{i}" for i in range(width_)]
    bits = classes.select("rep", *(F.col("bits")[i].alias(c) for i, c in enumerate(words_)))
    keyed = classes.select("rep", "n", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.min_by("n", "rep").alias("leader_n"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = written(keyed.join(leaders, "key"), "minhash-shared")
    stars = shared.where("rep <> leader").where(_fits(F.col("n"), F.col("leader_n"), percent)).select(F.col("leader").alias("u"), F.col("rep").alias("v")).distinct()
    involved = classes.join(shared.select("rep").distinct(), "rep").select("rep", F.col("row.doc_id").alias("__d"), F.col("row.h").alias("__h"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(involved, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")))
    texts = written(texts.select("rep", "text").dropDuplicates(["rep"]), "minhash-texts")
    links = written(_verified(stars, texts, width, percent), "minhash-links")
    roots = components(links, "minhash-cc")
    rest = _unsettled(shared, roots, bits)
    lead = rest.groupBy("key").agg(*(F.min_by(F.struct("rep", "n", "root", *words_), F.xxhash64("rep", F.lit(i))).alias(f"lead{i}") for i in range(LEADERS)))
    tries = rest.join(lead, "key").select("rep", "n", "root", *words_, F.explode(F.array(*(f"lead{i}" for i in range(LEADERS)))).alias("lead"))
    tries = tries.where((F.col("root") != F.col("lead.root")) & _fits(F.col("n"), F.col("lead.n"), percent) & _near("", "lead.", width_, apart)).select(F.col("lead.rep").alias("u"), F.col("rep").alias("v")).distinct()
    more = written(_verified(tries, texts, width, percent), "minhash-links")
    if not more.isEmpty():
        roots = _merged(roots, more)
        rest = _unsettled(shared, roots, bits)
    # What buckets still hold in different components.
    few = _prefixes(texts, rest.select("rep", "root").distinct(), width, percent)
    more = written(_verified(few.distinct(), texts, width, percent), "minhash-links")
    if not more.isEmpty():
        roots = _merged(roots, more)
    found = classes.select("set_id", "least", F.col("rep").alias("node")).join(roots, "node", "left").select("set_id", "least", "node", "root")
    # Classes without links are their own component; the others take the least doc_id of theirs.
    tops = found.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    found = found.join(tops, F.col("root") == F.col("r"), "left").select("set_id", F.coalesce("component_id", "least").alias("component_id"))
    return written(found, "minhash-labels", keep=True)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: one document of each group; rows that repeat an id go or stay by their own texts."""
    ident, mark = unused(docs, "__id", "__mark")
    gone = _judged(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias(ident), F.col("h").alias(mark)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(ident)) & (F.xxhash64("text") == F.col(mark)), "left_anti").select(*docs.columns)
