"""Line dedup by a log-template tree of fixed depth.

A line descends by its number of words and by its leading words; words that
hold digits, addresses or signs of variable fields are wildcards on the way,
unless more than half of the line's words are such fields. A leaf keeps one
template for the whole masked line and five more in which one fifth of the
words is a wildcard, the leading words' branch included where the fifth covers
them. Lines of one leaf that agree in all words outside one fifth (a similarity
of 0.8 or more) thus merge in one template, which needs a fixed number of
constant words. A template that recurs in enough documents is dropped from all
but the document of the smallest doc_id; lines of fifty words and more need one
document less. Keys are 64-bit hashes of all constant words and their places.

A passage of fifty words that recurs verbatim (but for case and white space)
goes wherever it stands, broken into lines or inside longer ones: every run of
fifty words of the whole text is compared. So that few runs move, those are
told by their anchor, the least hash of 16 words inside them, which equal runs
share. Neighbouring runs of one anchor are a stretch. Where all documents with
an anchor have the same stretch, its runs recur or not as one; only the runs of
other anchors that recur are listed. Lines that such passages cover are dropped
whatever their length, and lines that they cover in part lose the covered words
only.

Lines to drop are named by document and by the hash of their own text, so no
other line goes with them.

Defined results: null texts stay null and empty ones empty; lines of fewer
words than the least stay unless a passage covers them; very long texts are
read whole; a line that repeats inside one document counts once, and its later
copies go if its template recurs; a line of several recurring templates is
dropped once; rows that repeat a doc_id count as one holder, and each loses
only lines that recur elsewhere; rows without a doc_id are no holders and lose
nothing; empty
tables give empty results; other columns are kept, whatever their names, and
those named like the counts come first under the name with underscores added.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, collected, map_batches, mixed, powers, scratch, slices, span_hashes, unused, written

DEPTH, FIFTHS, LONG = 3, 5, 50
#: Words outside the wildcard fifth that a template needs at least.
CONSTANT = 6
#: Words of an anchor.
GRAM = 16
#: Columns that dedup_lines adds.
COUNTS = ("n_lines", "n_dropped", "chars_before", "chars_after")
_BASE = 0x9E3779B97F4A7C15
#: Tables for translate(): signs of a variable field (besides '://'), white space, lower case.
_FIELD = bytes(np.isin(np.arange(256), list(b"0123456789@\\")).astype(np.uint8))
_WHITE = bytes(np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c")).astype(np.uint8))
_LOWER = bytes(LOWER)
VARIABLE = re.compile(rb"[0-9@]|://|\\")
_STAR = np.uint64(0x2545F4914F6CDD1D)


def _spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs without white space start and end."""
    white = np.frombuffer(raw.translate(_WHITE), np.uint8)
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(white) and not white[0]:
        edges = np.concatenate([[0], edges])
    if len(white) and not white[-1]:
        edges = np.concatenate([edges, [len(white)]])
    return edges[::2], edges[1::2]


def stretch_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of few stretches of bytes, which cost less one by one than sums over all bytes."""
    view = memoryview(raw)
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)


class Words:
    """The words and lines of texts, as positions in their joined bytes, with hashes."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode() for t in texts]
        self.raw = b"\n".join(parts)
        self.data = data = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        self.since = np.cumsum(sizes + 1) - sizes - 1  # where each text starts
        low = np.frombuffer(self.raw.translate(_LOWER), np.uint8)
        self.starts, self.ends = _spans(self.raw)
        self.hashes = span_hashes(low, self.starts, self.ends)
        self.text = np.searchsorted(self.since, self.starts, "right") - 1
        self.sizes = np.bincount(self.text, minlength=len(parts))
        #: Lines as stretches of bytes; the last one of a text ends where the next text starts.
        breaks = np.flatnonzero(data == 10)
        self.line_starts = np.concatenate([[0], breaks + 1])
        self.line_ends = np.concatenate([breaks, [len(data)]])
        self.first = np.searchsorted(self.starts, self.line_starts)  # each line's first word
        self.words = np.diff(self.first, append=len(self.starts))

    def masked(self) -> np.ndarray:
        """The words' hashes, those of variable fields replaced by one."""
        signs = [np.flatnonzero(np.frombuffer(self.raw.translate(_FIELD), np.uint8))]
        at, found = self.raw.find(b"://"), []
        while at >= 0:
            found.append(at)
            at = self.raw.find(b"://", at + 1)
        out = self.hashes.copy()
        out[np.searchsorted(self.starts, np.concatenate([*signs, np.array(found, np.int64)]), "right") - 1] = _STAR
        return out

    def line_hashes(self) -> np.ndarray:
        return stretch_hashes(self.raw, self.line_starts, self.line_ends)


def templates(plain: np.ndarray, masked: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the templates of lines of words (none empty), and the line each
    belongs to; plain and masked are the hashes of all lines' words."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    fields = np.add.reduceat(plain != masked, starts)
    h = np.where(np.repeat(2 * fields > sizes, sizes), plain, masked)
    place = np.arange(1, len(h) + 1) - np.repeat(starts, sizes)
    placed = mixed(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)])
    total, lead = sums[ends] - sums[starts], np.minimum(sizes, DEPTH)
    branch = mixed(sums[starts + lead] - sums[starts] + sizes.astype(np.uint64))
    keys, owner = [mixed(branch ^ total)], [np.arange(len(sizes))]
    for i in range(FIFTHS):
        since, until = sizes * i // FIFTHS, sizes * (i + 1) // FIFTHS
        some = np.flatnonzero((until > since) & (sizes - (until - since) >= CONSTANT))
        at, a, b = starts[some], since[some], until[some]
        gone = sums[at + b] - sums[at + a]
        # Leading words inside the fifth descend by the wildcard.
        la, lb = np.minimum(a, lead[some]), np.minimum(b, lead[some])
        leading = sums[at + lead[some]] - sums[at] - (sums[at + lb] - sums[at + la])
        branch = mixed(leading + sizes[some].astype(np.uint64))
        keys.append(mixed((branch ^ (total[some] - gone)) + np.uint64((i + 1) << 40)))
        owner.append(some)
    return np.concatenate(keys).view(np.int64), np.concatenate(owner)


def runs(h: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of width words start that lie inside one text, and their
    hashes; h has the words of all texts, sizes the words of each."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))
    at = np.flatnonzero(left >= width)
    power, inverse = powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
    return at, mixed((sums[at + width] - sums[at]) * inverse[at])


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each width neighbours."""
    k = 1
    while 2 * k <= width:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (width - k)], x[width - k :])


def passages(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of LONG words start, their hashes, and their anchors."""
    at, keys = runs(h, sizes, LONG)
    if not len(at):
        return at, keys, keys
    where, found = runs(h, sizes, GRAM)
    grams = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    grams[where] = found
    return at, keys, _sliding(grams, LONG - GRAM + 1, np.minimum)[at]


def stretches(at: np.ndarray, keys: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first run of each stretch, and a hash of its first and last run and length."""
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return first, mixed(keys[first] + mixed(keys[last] + (last - first).astype(np.uint64)))


def _once(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of the first of each document's equal keys."""
    order = np.lexsort((keys, doc))
    first = np.ones(len(keys), bool)
    first[1:] = (np.diff(keys[order]) != 0) | (np.diff(doc[order]) != 0)
    return order[first]


#: Kinds of rows: templates of lines, and anchors. A template's key is odd if its lines are long ones.
TEMPLATE, ANCHOR = 0, 1
#: Bytes of texts at a time: arrays of 64 bits for each byte stay in a core's cache.
SLICE = 512 << 10


def _keyed(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, kind (twice the kind, and one more at the document's first such
    key), key and mark (the hash of the line or of the anchor's stretch), of each
    line's templates and of each text's anchors; neighbouring equal marks of a
    document's key once."""

    def make():
        def work(x):
            w = Words(x["text"])
            at, runs_, low = passages(w.hashes, w.sizes)
            begins, stretch = stretches(at, runs_, low)
            used = np.flatnonzero(w.words >= least)
            lengths = w.words[used]
            keys, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(used):
                inside = np.repeat(w.first[used] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                keys, owner = templates(w.hashes[inside], w.masked()[inside], lengths)
                keys = keys & ~1 | (lengths >= LONG)[owner]
            doc = np.concatenate([w.text[w.first[used]][owner], w.text[at[begins]]])
            key = np.concatenate([keys, low[begins].view(np.int64)])
            mark = np.concatenate([w.line_hashes()[used][owner], stretch.view(np.int64)])
            kind = np.repeat([TEMPLATE, ANCHOR], [len(keys), len(begins)])
            pair = _pairs(doc, key)
            order = np.argsort(pair)
            doc, key, mark, kind, pair = doc[order], key[order], mark[order], kind[order], pair[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = pair[1:] != pair[:-1]
            keep = fresh.copy()
            keep[1:] |= np.diff(mark) != 0
            return {"doc_id": pa.array(x["doc_id"], pa.int64()).take(pa.array(doc[keep])), "kind": (2 * kind + fresh)[keep].astype(np.int32), "key": key[keep], "mark": mark[keep]}

        return work

    return map_batches(docs.select("doc_id", "text"), "doc_id long, kind int, key long, mark long", make, SLICE)


def _around(docs: DataFrame) -> DataFrame:
    """doc_id and keys of the runs of LONG words of the given anchors of each
    row of doc_id, text, anchors; a key once in each text."""

    def make():
        def work(x):
            w = Words(x["text"])
            at, keys, low = passages(w.hashes, w.sizes)
            some = np.isin(_pairs(w.text[at], low), _marked(x["anchors"]))
            doc, keys = w.text[at[some]], keys[some].view(np.int64)
            some = _once(doc, keys)
            return {"doc_id": pa.array(x["doc_id"], pa.int64()).take(pa.array(doc[some])), "key": keys[some]}

        return work

    return map_batches(docs, "doc_id long, key long", make, SLICE)


def _pairs(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a document's place in its batch and a key."""
    return mixed(key.view(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def recurring(docs: DataFrame, least: int = 5, short_docs: int = 3, long_docs: int = 2) -> DataFrame:
    """doc_id, gone (hashes of the lines to drop), settled (anchors all of whose
    runs are to drop) and covered (keys of further runs to drop, or null).
    Templates, anchors and runs are counted by partial aggregates, so no key's
    rows ever have to meet; the joins with those that recur, which are hashed as
    they are the few, are ones whose large partitions Spark splits."""
    spark, ends = docs.sparkSession, (F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    with scratch(spark):
        docs = docs.where("doc_id IS NOT NULL")
        keyed = written(_keyed(docs, least), "lines-keyed")
        lines, anchors = keyed.where(F.col("kind") < 2 * ANCHOR), keyed.where(F.col("kind") >= 2 * ANCHOR)
        counts = lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum(F.col("kind") - 2 * TEMPLATE).alias("docs"))
        enough = F.col("docs") >= F.when(F.col("key").bitwiseAND(1) == 1, long_docs).otherwise(short_docs)
        often = written(counts.where(enough).where("docs > 1").select("key", "first"), "lines-often")
        if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            # Rows were counted; where ids repeat, the holders of what recurs are counted as well.
            held = lines.join(often.select("key"), "key", "left_semi").groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
            held = held.groupBy("key").agg(F.count("*").alias("docs")).where(enough).where("docs > 1")
            often = written(often.join(held.select("key"), "key", "left_semi"), "lines-held")
        gone = lines.join(often.hint("shuffle_hash"), "key").where("doc_id <> first").select("doc_id", F.col("mark").alias("gone"))
        known = anchors.groupBy("key").agg(*ends, (F.min("mark") == F.max("mark")).alias("same")).where("first < last")
        known = written(known.select("key", "first", "same"), "lines-anchors")
        met = anchors.join(known.hint("shuffle_hash"), "key").where("not same or doc_id <> first")
        met = met.select("doc_id", F.when(F.col("same"), F.col("key")).alias("settled"), F.when(~F.col("same"), F.col("key")).alias("anchors"))
        marks = gone.unionByName(met, allowMissingColumns=True).groupBy("doc_id").agg(*(F.collect_set(c).alias(c) for c in ("gone", "settled", "anchors")))
        marks = written(marks, "lines-marks", keep=True)
    collected(spark)
    with scratch(spark):
        near = marks.where(F.size("anchors") > 0).select("doc_id", "anchors")
        listed = written(_around(docs.select("doc_id", "text").join(near.hint("shuffle_hash"), "doc_id")), "lines-passages")
        collected(spark)
        twice = written(listed.groupBy("key").agg(*ends).where("first < last").select("key", "first"), "lines-twice")
        collected(spark)
        covered = listed.join(twice.hint("shuffle_hash"), "key").where("doc_id <> first").groupBy("doc_id").agg(F.collect_set("key").alias("covered"))
        covered = written(covered, "lines-covered", keep=True)
    collected(spark)
    return marks.select("doc_id", "gone", "settled").join(covered, "doc_id", "left")


def uncovered(texts: list[str], gone: list, settled: list, covered: list) -> tuple[list[str], list[int]]:
    """The texts without the lines whose hashes are gone and without the words
    of the passages of settled anchors and of the covered ones, and how many
    lines of each are dropped whole."""
    w = Words(texts)
    holder = np.searchsorted(w.since, w.line_starts, "right") - 1
    drop = np.isin(_pairs(holder, w.line_hashes()), _marked(gone))
    at, keys, low = passages(w.hashes, w.sizes)
    at = at[np.isin(_pairs(w.text[at], keys), _marked(covered)) | np.isin(_pairs(w.text[at], low), _marked(settled))]
    ends = np.zeros(len(w.starts) + LONG + 1, np.int64)
    ends[at] += 1
    ends[at + LONG] -= 1
    lost = np.cumsum(ends)[: len(w.starts)] > 0
    before = np.concatenate([[0], np.cumsum(lost)])
    cut = before[w.first + w.words] - before[w.first]
    drop |= (w.words > 0) & (cut == w.words)
    dropped = np.bincount(holder[drop], minlength=len(texts))
    kept = [[] for _ in texts]
    rows = np.flatnonzero(~drop)
    for i, doc, a, b, part in zip(rows.tolist(), holder[rows].tolist(), w.line_starts[rows].tolist(), w.line_ends[rows].tolist(), cut[rows].tolist(), strict=True):
        kept[doc].append(w.raw[a:b] if not part else b" ".join(w.raw[s:e] for s, e in _left(w, i, lost)))
    return [b"\n".join(x).decode() for x in kept], dropped.tolist()


def without_lines(texts: list[str], gone: list) -> tuple[list[str], list[int]]:
    """As uncovered, of texts that lose whole lines only: their words are not read."""
    parts = [t.encode() for t in texts]
    raw = b"\n".join(parts)
    data = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    since = np.cumsum([len(p) + 1 for p in parts])
    holder = np.searchsorted(since, starts, "right")
    drop = np.isin(_pairs(holder, stretch_hashes(raw, starts, ends)), _marked(gone))
    kept: list[list[bytes]] = [[] for _ in texts]
    for doc, a, b in zip(holder[~drop].tolist(), starts[~drop].tolist(), ends[~drop].tolist(), strict=True):
        kept[doc].append(raw[a:b])
    return [b"\n".join(x).decode() for x in kept], np.bincount(holder[drop], minlength=len(texts)).tolist()


def _marked(of: list) -> np.ndarray:
    """The pairs of each row's place and the keys in its list (or None)."""
    sizes = [0 if x is None else len(x) for x in of]
    return _pairs(np.repeat(np.arange(len(of)), sizes), np.array([k for x in of if x is not None for k in x], np.int64))


def _left(w: Words, line: int, lost: np.ndarray) -> list[list[int]]:
    """The stretches of a line's words that are not lost."""
    parts: list[list[int]] = []
    for j in range(w.first[line], w.first[line] + w.words[line]):
        if not lost[j]:
            if j > w.first[line] and not lost[j - 1]:
                parts[-1][1] = w.ends[j]
            else:
                parts.append([w.starts[j], w.ends[j]])
    return parts


def _uncovered(text: pa.Array, gone: pa.Array, settled: pa.Array, covered: pa.Array) -> pa.Array:
    """Worked on in slices of few bytes; a null text stays."""
    kind = pa.struct([("text", pa.string()), ("dropped", pa.int32())])
    out: list = [None] * len(text)
    some = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text, gone, settled, covered], ["at", "text", "gone", "settled", "covered"]).filter(text.is_valid())
    for since, n in slices(some, size=SLICE):
        part = some.slice(since, n)
        rows = part.to_pylist()
        whole = [r for r in rows if not r["settled"] and not r["covered"]]
        rest = [r for r in rows if r["settled"] or r["covered"]]
        of = lambda rows, *names: [[r[c] for r in rows] for c in names]
        for some_, cut, names in ((whole, without_lines, ("text", "gone")), (rest, uncovered, ("text", "gone", "settled", "covered"))):
            if some_:
                for r, t, d in zip(some_, *cut(*of(some_, *names)), strict=True):
                    out[r["at"]] = {"text": t, "dropped": d}
    return pa.array(out, kind)


def length(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0)).cast("long")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """All columns of docs, text without its recurring lines and passages, and
    n_lines, n_dropped (lines dropped whole), chars_before, chars_after."""
    ident, lost, rest, over, cut, new = unused(docs, "__id", "__gone", "__settled", "__covered", "__cut", "__new")
    text, gone, settled, covered = F.col("text"), F.col(lost), F.col(rest), F.col(over)
    marks = recurring(docs, **options).withColumnsRenamed({"doc_id": ident, "gone": lost, "settled": rest, "covered": over})
    out = docs.join(marks.hint("shuffle_hash"), F.col("doc_id") == F.col(ident), "left")
    some = covered.isNotNull() | (F.size(gone) > 0) | (F.size(settled) > 0)
    # Not deterministic only to the planner: a filter on the text would else be pushed below and cut it a second time.
    once = F.arrow_udf(_uncovered, "struct<text: string, dropped: int>").asNondeterministic()
    out = out.withColumn(cut, once(F.when(some, text), gone, settled, covered))
    out = out.withColumn(new, F.coalesce(F.col(cut)["text"], text))
    n = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    dropped = F.coalesce(F.col(cut)["dropped"], F.lit(0)).cast("long")
    # Texts that are left as they are have the same length again.
    (size,) = unused(out, "__size")
    out = out.withColumn(size, length(text))
    before = F.col(size)
    after = F.when(F.col(cut)["text"].isNull(), before).otherwise(length(F.col(cut)["text"]))
    counts = dict(zip(COUNTS, (n, dropped, before, after), strict=True))
    aside = {c: unused(docs, f"{c}_")[0] for c in docs.columns if c in counts}
    return out.select(*(F.col(new).alias("text") if c == "text" else F.col(c).alias(aside.get(c, c)) for c in docs.columns), *(v.alias(c) for c, v in counts.items()))
