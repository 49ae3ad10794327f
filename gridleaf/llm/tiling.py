"""Benchmark decontamination by greedy string tiling.

A document meets a benchmark item where they share a run of five words (a
seed; all words of a shorter item). For each such pair, running Karp-Rabin repeatedly finds the longest
common runs of unmarked words and marks them on both sides, so that no word
counts twice and the order of the passages does not matter. A document whose
tiles cover enough of an item's words is contaminated.

While the benchmark's words fit a stated bound they go to every task, and each
document is tiled where it is read; beyond the bound, seeds are joined.

Defined results: words are compared lower-cased and without ASCII punctuation;
null and empty texts, items without words and empty tables match nothing
(coverage 0); an item of fewer than five words is met whole or not at all; very
long texts are read whole, and only their stretches around seeds are tiled; of
equally covered items the smallest item_id is named, of equally long matches
the first; a repeated item counts once, with the least of its texts; rows are
independent, so repeated rows repeat their result and rows that repeat an id
with another text have their own; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, map_batches, unused, windows

SEED, COVER = 5, 0.6
#: Characters of benchmark text up to which the items go to every task.
BOUND = 8_000_000
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def _scan(a: list[int], b: list[int], free_a: list[bool], free_b: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, start in a, start in b) of at least size
    free words, found by rolling hashes of all windows of that size."""
    mod, base = (1 << 61) - 1, 1_000_003
    top = pow(base, size - 1, mod)

    def rolled(x: list[int], free: list[bool]):
        h = run = 0
        for i, w in enumerate(x):
            if not free[i]:
                h = run = 0
                continue
            if run >= size:
                h = (h - x[i - size] * top) % mod
            h = (h * base + w) % mod
            run += 1
            if run >= size:
                yield i - size + 1, h

    places: dict[int, list[int]] = {}
    for i, h in rolled(a, free_a):
        places.setdefault(h, []).append(i)
    found = []
    for j, h in rolled(b, free_b):
        for i in places.get(h, ()):
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue  # part of the run that starts before
            k = 0
            while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                k += 1
            if k >= size:
                found.append((k, i, j))
    return found


def tiles(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """The tiles (length, start in item, start in doc), longest first; of equally
    long ones the first in the item, then in the document. Search lengths run
    down to least; what a longer tile leaves of a match waits for its own turn."""
    free_a, free_b = [True] * len(item), [True] * len(doc)
    out, size = [], max(least, min(20, len(item)))
    while True:
        queue = [(-k, i, j) for k, i, j in _scan(item, doc, free_a, free_b, size)]
        heapq.heapify(queue)
        while queue:
            k, i, j = heapq.heappop(queue)
            open_ = [free_a[i + x] and free_b[j + x] for x in range(-k)]
            if all(open_):
                free_a[i : i - k] = free_b[j : j - k] = [False] * -k
                out.append((-k, i, j))
                continue
            start = 0
            for x, o in enumerate([*open_, False]):
                if not o:
                    if x - start >= size:
                        heapq.heappush(queue, (start - x, i + start, j + start))
                    start = x + 1
        if size == least:
            return out
        size = max(least, size // 2)


class Items:
    """Benchmark items with an index of their seeds: runs of SEED words, or all
    words of a shorter item."""

    def __init__(self, items: list[tuple[int, list[bytes]]], cache: WordHashes):
        self.items = {i: cache.of(w).tolist() for i, w in items}
        by_width: dict[int, dict[int, list[int]]] = {}
        for i, w in self.items.items():
            if w:
                at = by_width.setdefault(min(SEED, len(w)), {})
                for s in set(windows(np.array(w, np.uint64), SEED).tolist()):
                    at.setdefault(s, []).append(i)
        self.at = {width: (at, self._gate(at)) for width, at in by_width.items()}

    @staticmethod
    def _gate(at: dict[int, list[int]]) -> np.ndarray:
        gate = np.zeros(1 << 16, bool)
        gate[(np.array(sorted(at), np.uint64) & np.uint64(0xFFFF)).astype(np.int64)] = True
        return gate

    def best(self, doc: np.ndarray) -> tuple[int | None, float, int, int]:
        """(item_id, coverage, tiles, items met) of a document's word hashes."""
        near: dict[int, list[int]] = {}
        for width, (at, gate) in self.at.items():
            if len(doc) < width:
                continue
            runs = windows(doc, width)
            for p in np.flatnonzero(gate[(runs & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                for i in at.get(int(runs[p]), ()):
                    near.setdefault(i, []).append(p)
        best = (None, 0.0, 0)
        for i in sorted(near):
            item = self.items[i]
            least = min(SEED, len(item))
            found = tiles(item, self._around(doc, near[i], least), least)
            cover = sum(t[0] for t in found) / len(item)
            if cover > best[1]:
                best = (i, cover, len(found))
        return (*best, len(near))

    @staticmethod
    def _around(doc: np.ndarray, hits: list[int], width: int) -> list[int]:
        """The document's words that seeds cover, in order; a tile lies inside
        one stretch of overlapping seeds, and a number that no word has parts
        the stretches."""
        keep = np.zeros(len(doc) + 1, bool)
        at = np.array(hits)
        for k in range(width):
            keep[at + k] = True
        out: list[int] = []
        for k in np.flatnonzero(keep).tolist():
            if out and not keep[k - 1]:
                out.append(-1)
            out.append(int(doc[k]))
        return out


def _one_each(benchmark: DataFrame) -> DataFrame:
    """item_id and text; of an item's several texts the least in order."""
    return benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))


def _items(rows) -> list[tuple[int, list[bytes]]]:
    return [(r["item_id"], words(r["text"])) for r in rows]


_FOUND = "item_id long, coverage double, n_tiles long, n_items long"
_ROW = "row struct<doc_id: long, h: long>"


def _tiled_in_place(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = rows.sparkSession.sparkContext.broadcast(_items(_one_each(benchmark).collect()))

    def make():
        cache = WordHashes()
        index = Items(items.value, cache)

        def work(x):
            found = [index.best(cache.of(words(t))) for t in x["text"]]
            return {"row": x["row"], "item_id": [f[0] for f in found], "coverage": [f[1] for f in found], "n_tiles": [f[2] for f in found], "n_items": [f[3] for f in found]}

        return work

    return map_batches(rows, f"{_ROW}, {_FOUND}", make)


def _tiled_by_join(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    some = _one_each(benchmark)
    short = sorted(r["n"] for r in map_batches(some, "n long", _widths).distinct().collect())

    def seeds(name: str, whole: bool):
        def make():
            cache = WordHashes()

            def work(x):
                out = {name: [], "s": []}
                for i, t in zip(x[name], x["text"], strict=True):
                    h = cache.of(words(t))
                    widths = [min(SEED, len(h))] if whole else [w for w in short if w <= len(h)]
                    for w in widths:
                        found = np.unique(windows(h, w)).view(np.int64).tolist()
                        out[name] += [i] * len(found)
                        out["s"] += found
                return out

            return work

        return make

    by_item = map_batches(some, "item_id long, s long", seeds("item_id", True))
    pairs = map_batches(rows, f"{_ROW}, s long", seeds("row", False)).join(by_item, "s").select("row", "item_id").distinct()

    def make():
        cache = WordHashes()

        def work(x):
            out = {c: [] for c in ("row", "item_id", "coverage", "n_tiles")}
            for d, t, i, item in zip(x["row"], x["text"], x["item_id"], x["item"], strict=True):
                _, cover, n, _ = Items([(i, words(item))], cache).best(cache.of(words(t)))
                for c, v in zip(out, (d, i, cover, n), strict=True):
                    out[c].append(v)
            return out

        return work

    texts = rows.groupBy(F.col("row").alias("r")).agg(F.first("text").alias("text"))
    met = pairs.join(some.withColumnRenamed("text", "item"), "item_id").join(texts, F.col("row").eqNullSafe(F.col("r")))
    scored = map_batches(met.select("row", "text", "item_id", "item"), f"{_ROW}, item_id long, coverage double, n_tiles long", make)
    top = F.max_by(F.struct("item_id", "coverage", "n_tiles"), F.struct("coverage", -F.col("item_id"))).alias("top")
    best = scored.groupBy(F.col("row").alias("r")).agg(top, F.count_distinct("item_id").alias("n_items"))
    none = F.lit(0).cast("long")
    return rows.select("row").join(best, F.col("row").eqNullSafe(F.col("r")), "left").select("row", "top.item_id", F.coalesce("top.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("top.n_tiles", none).alias("n_tiles"), F.coalesce("n_items", none).alias("n_items"))


def _widths():
    """The seed widths that the items of a batch need (each once)."""
    return lambda x: {"n": sorted({min(SEED, len(words(t))) for t in x["text"]} - {0})}


def _tiled(docs: DataFrame, benchmark: DataFrame, cover: float, bound: int) -> DataFrame:
    """row (doc_id and hash of the text, which tell repeated ids apart) and the findings."""
    size = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row"), "text")
    found = (_tiled_in_place if size <= bound else _tiled_by_join)(rows, benchmark)
    return found.withColumn("contaminated", F.col("coverage") >= cover)


def contamination(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, bound: int = BOUND) -> DataFrame:
    """doc_id, item_id (the best covered), coverage, n_tiles, n_items (met by a
    seed), contaminated for each row of docs."""
    found = _tiled(docs, benchmark, cover, bound)
    return found.select("row.doc_id", *(c for c in found.columns if c != "row"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, bound: int = BOUND) -> DataFrame:
    """The rows of docs that are not contaminated; rows that repeat an id go or stay by their own texts."""
    ident, mark = unused(docs, "__id", "__mark")
    gone = _tiled(docs, benchmark, cover, bound).where("contaminated").select(F.col("row.doc_id").alias(ident), F.col("row.h").alias(mark)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(mark)), "left_anti").select(*docs.columns)
