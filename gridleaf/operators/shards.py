"""Greedy shards under a byte budget, for groups of any size.

Rows are sorted in ranges of bounded size. Where a shard ends depends on what
was open before the range, and only through the open shard's fill, so each
range of a group is summed up as a map from the fill before it to the shards it
opens and the fill after it. Maps are composed in a tree, which gives each range
its true start, and the ranges are then cut from there. No task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import numbered
from .staging import staged

#: Rows of a range, and maps that one task composes.
ROWS, FAN = 200_000, 32


def following(sizes: np.ndarray, budget: int) -> np.ndarray:
    """For a shard that begins at each row, the row at which the next begins (the number of rows if none)."""
    n = len(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    i = np.arange(n)
    # The first row with which the budget is passed; a shard without bytes takes it all the same.
    over = np.searchsorted(ends, ends[:-1] + budget, "right") - 1
    over = np.maximum(over, i)
    empty = ends[np.minimum(over, n)] == ends[:-1]
    return np.minimum(np.where(empty & (over < n), over + 1, over), n)


def summary(sizes: np.ndarray, budget: int) -> tuple[list[int], list[int], list[int], int]:
    """The map of a range: for fills above below[k] (and not above below[k - 1])
    it opens shards[k] and leaves fills[k]; a fill of at most the last of below
    and above 0 only grows by the range's bytes, the last value. The fill 0 is
    the first entry, with a bound of its own."""
    n = len(sizes)
    to = following(sizes, budget)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    opened, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = to[i]
        opened[i] = 1 + (opened[j] if j < n else 0)
        left[i] = left[j] if j < n else ends[n] - ends[i]
    below, shards, fills = [-1], [int(opened[0]) - 1], [int(left[0])]
    for i in range(n):
        low = max(0, budget - int(ends[i + 1]))
        if i and budget - int(ends[i]) <= 0:
            break
        if len(below) > 1 and (shards[-1], fills[-1]) == (opened[i], left[i]):
            below[-1] = low
        elif low < (below[-1] if len(below) > 1 else 1 << 62):
            below.append(low)
            shards.append(int(opened[i]))
            fills.append(int(left[i]))
    return below, shards, fills, int(ends[n])


def applied(m: tuple[Sequence[int], Sequence[int], Sequence[int], int], shard: int, fill: int) -> tuple[int, int]:
    """The open shard and its fill after a range."""
    below, shards, fills, total = m
    if fill == 0:
        return shard + int(shards[0]), int(fills[0])
    # below falls from its second entry on; the first bound under the fill counts.
    at = 1 + int(np.searchsorted(-np.asarray(below[1:], np.int64), -fill, "right"))
    if at < len(below):
        return shard + int(shards[at]), int(fills[at])
    return shard, fill + int(total)


def composed(first, second):
    """The map of two ranges that follow each other. Fills that pass the first
    range without a break are cut at the second's bounds."""
    below, shards, fills = [], [], []
    for b, s, f in zip(*first[:3], strict=True):
        s, f = applied(second, int(s), int(f))
        if len(below) > 1 and (shards[-1], fills[-1]) == (s, f):
            below[-1] = int(b)
        else:
            below.append(int(b))
            shards.append(s)
            fills.append(f)
    last = below[-1] if len(below) > 1 else 1 << 62
    for b, s, f in zip(*(x[1:] for x in second[:3]), strict=True):
        low = max(0, int(b) - int(first[3]))
        if low >= last:
            continue
        if len(below) > 1 and (shards[-1], fills[-1]) == (int(s), int(f)):
            below[-1] = low
        else:
            below.append(low)
            shards.append(int(s))
            fills.append(int(f))
        last = low
    return below, shards, fills, int(first[3]) + int(second[3])


_MAP = "below array<bigint>, shards array<bigint>, fills array<bigint>, total bigint"
_COLUMNS = ["below", "shards", "fills", "total"]


def _starts(maps: DataFrame) -> DataFrame:
    """grp, range, shard, fill: what is open before each range of a group (maps: grp, range, no (its place among the group's), a map)."""
    most = maps.agg(F.max("no")).first()[0] or 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, fill, out = int(pdf["shard"].iloc[0]), int(pdf["fill"].iloc[0]), []
        for r in pdf.sort_values("no").itertuples():
            out.append((r.grp, r.range, shard, fill))
            shard, fill = applied((r.below, r.shards, r.fills, r.total), shard, fill)
        return pd.DataFrame(out, columns=["grp", "range", "shard", "fill"])

    kind = dict(maps.dtypes)["grp"]
    schema = f"grp {kind}, range bigint, shard bigint, fill bigint"
    if most < FAN:
        return maps.withColumns({"shard": F.lit(0), "fill": F.lit(0)}).groupBy("grp").applyInPandas(run, schema)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("no")
        m = None
        for r in rows.itertuples():
            one = (r.below, r.shards, r.fills, r.total)
            m = one if m is None else composed(m, one)
        return pd.DataFrame([(rows["grp"].iloc[0], rows["up"].iloc[0], rows["up"].iloc[0], *m)], columns=["grp", "range", "no", *_COLUMNS])

    part = maps.withColumn("up", F.floor(F.col("no") / FAN))
    above = staged(part.groupBy("grp", "up").applyInPandas(joined, f"grp {kind}, range bigint, no bigint, {_MAP}"), "shard-maps")
    begun = _starts(above).withColumnRenamed("range", "up")
    return part.join(begun, ["grp", "up"]).groupBy("grp", "up").applyInPandas(run, schema)


def sharded(rows: DataFrame, group: Sequence[str], order: str, size: str, budget: int, rows_a_range: int = ROWS) -> DataFrame:
    """rows with a shard number: greedy in order, a new shard where the budget
    would be passed; a row above it has its own. Rows of equal order stand in
    the order of all columns' hash; a null size counts as 0."""
    keyed = rows.withColumn("__grp", F.to_json(F.struct(*group)) if group else F.lit(""))
    ranges = max(1, -(-rows.count() // rows_a_range))
    table = numbered(keyed, [F.col("__grp"), F.col(order), F.xxhash64(*rows.columns)], "__place", ranges, "__range")
    light = table.select("__grp", "__range", "__place", F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("__size"))

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, part in pdf.sort_values("__place").groupby("__grp", sort=False):
            out.append((g, part["__range"].iloc[0], *summary(part["__size"].to_numpy(np.int64), budget)))
        return pd.DataFrame(out, columns=["grp", "range", *_COLUMNS])

    # A group that lies in one range needs no map.
    spread = light.groupBy("__grp", "__range").agg(F.count("*").alias("n"))
    spread = staged(spread.groupBy("__grp").agg(F.sort_array(F.collect_list("__range")).alias("ranges")).where(F.size("ranges") > 1).select("__grp", F.posexplode("ranges").alias("no", "__range")), "spread")
    wide = light.join(spread.drop("no"), ["__grp", "__range"], "left_semi")
    found = wide.groupBy("__range").applyInPandas(maps, f"grp string, range bigint, {_MAP}")
    numbered_ = found.join(spread.select(F.col("__grp").alias("grp"), F.col("__range").alias("range"), F.col("no").cast("bigint")), ["grp", "range"])
    starts = staged(_starts(staged(numbered_.select("grp", "range", "no", *_COLUMNS), "shard-maps")), "shard-starts")
    open_ = light.join(starts.select(F.col("grp").alias("__grp"), F.col("range").alias("__range"), F.col("shard").alias("__shard"), F.col("fill").alias("__fill")), ["__grp", "__range"], "left")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__place")
        same = pdf["__grp"].to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        # Only the range's first group can have been open before.
        first, fill = pdf["__shard"].iloc[0], pdf["__fill"].iloc[0]
        first, fill = (0, 0) if pd.isna(first) else (int(first), int(fill))
        return pd.DataFrame({"__place": pdf["__place"], "shard": placed(pdf["__size"].to_numpy(np.int64), begins, budget, first, fill)})

    found = open_.groupBy("__range").applyInPandas(cut, "__place bigint, shard bigint")
    return table.join(found, "__place").select(*rows.columns, F.col("shard").cast(T.LongType()))


def placed(sizes: np.ndarray, begins: np.ndarray, budget: int, shard: int, fill: int) -> np.ndarray:
    """The shards of groups of rows (begins: their first rows); the first group goes on from an open shard and its fill."""
    n = len(sizes)
    closes = np.append(begins[1:], n)
    to = np.minimum(following(sizes, budget), np.repeat(closes, np.diff(np.append(begins, n))))
    new = np.zeros(n, np.int64)
    for k, (at, end) in enumerate(zip(begins.tolist(), closes.tolist(), strict=True)):
        at = int(np.searchsorted(np.cumsum(sizes[:end]), budget - fill, "right")) if fill and not k else int(to[at])
        while at < end:
            new[at] = 1
            at = int(to[at])
    count = np.cumsum(new)
    count -= np.repeat(count[begins] - new[begins], np.diff(np.append(begins, n)))
    count[: closes[0]] += shard
    return count
