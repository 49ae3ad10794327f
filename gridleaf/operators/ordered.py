"""Order-dependent operators: runs, nearest labels, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import staged

#: Rows up to which a side of codes goes to every task.
BOUND = 10_000


def bounded(side: DataFrame, rows: int = BOUND) -> DataFrame:
    """side, broadcast if it has few rows, as it is otherwise."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def times(rows: DataFrame, few: DataFrame, most: int = BOUND) -> DataFrame:
    """Each row with each of few others, which go to every task; more of those
    than the bound are an error, as no caller can want that many for every row."""
    n = few.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows for each row")
    return rows.crossJoin(F.broadcast(few))


#: Bytes of labels up to which every task reads them all at once.
LABEL_BYTES = 8 << 20


def containing(cells: DataFrame, labels: DataFrame, ident: Sequence[str], cell: str, label: str, bound: int = LABEL_BYTES) -> DataFrame:
    """ident and label of each cell text that holds a label text. Up to a bound
    on all labels' bytes one automaton of them reads each text once, in its own
    task; nothing is shuffled. Beyond it texts and labels meet by runs of
    characters. Empty labels are in nothing."""
    text = labels.select(label).where(F.octet_length(label) > 0).distinct()
    if (text.agg(F.sum(F.octet_length(label))).first()[0] or 0) > bound:
        return _met(cells, text, ident, cell, label)
    known = cells.sparkSession.sparkContext.broadcast([r[0] for r in text.collect()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(known.value)
        for batch in batches:
            rows, names = [], []
            for i, value in enumerate(batch.column(cell)):
                held = {n for _, n in found.iter(value.as_py() or "")} if len(found) else ()
                rows += [i] * len(held)
                names += held
            if rows:
                at = pa.array(rows, pa.int64())
                out = [batch.column(c).take(at) for c in ident]
                yield pa.RecordBatch.from_arrays([*out, pa.array(names, pa.string())], names=[*ident, label])

    kinds = cells.select(*ident).schema
    return cells.select(*ident, cell).mapInArrow(find, T.StructType([*kinds.fields, T.StructField(label, T.StringType())]))


def automaton(labels: Sequence[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for text in labels:
        out.add_word(text, text)
    if labels:
        out.make_automaton()
    return out


def _met(cells: DataFrame, text: DataFrame, ident: Sequence[str], cell: str, label: str, width: int = 3) -> DataFrame:
    """As containing, by each label's rarest run of width characters, so that no
    text meets all labels; labels shorter than a run meet as a whole. Only rows'
    numbers travel with the runs; the texts are joined to what met and verified."""
    n = F.char_length(label)
    grams = text.select(label, F.least(n, F.lit(width)).alias("__w")).select(label, "__w", F.explode(F.expr(f"transform(sequence(1, char_length(`{label}`) - __w + 1), i -> substring(`{label}`, i, __w))")).alias("__g"))
    often = grams.groupBy("__g").agg(F.count("*").alias("__f"))
    keyed = grams.join(often, "__g").groupBy(label).agg(F.min_by("__g", F.struct("__f", "__g")).alias("__g"))
    rows = staged(cells.select(*ident, cell).withColumn("__row", F.monotonically_increasing_id()), "cells")

    def of_width(w: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.char_length(cell) - w + 1, F.lit(1)))
        return F.transform(places, lambda i: F.substring(F.col(cell), i, F.lit(w)))

    starts = F.flatten(F.array(*map(of_width, range(1, width + 1))))
    met = rows.select("__row", F.explode(F.array_distinct(starts)).alias("__g")).join(keyed, "__g").select("__row", label)
    return met.join(rows, "__row").where(F.contains(F.col(cell), F.col(label))).select(*ident, label)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column) -> DataFrame:
    """df with the number of the run of equal neighbouring values."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def nearest_labels(markers: DataFrame, labels: DataFrame, doc: Sequence[str], ident: Sequence[str]) -> DataFrame:
    """Each marker (doc, r, c, ident) with its nearest label of the document:
    same cell, then to the left, then above, then anything; the marker's column
    first, then the smallest distance, then the labels' order."""
    b = labels.select(*doc, F.col("r").alias("lr"), F.col("c").alias("lc"), *(F.col(i).alias(f"label_{i}") for i in ident))
    rows = markers.join(b, list(doc))
    same = (F.col("lr") == F.col("r")) & (F.col("lc") == F.col("c"))
    place = F.when(same, 0).when((F.col("lr") == F.col("r")) & (F.col("lc") < F.col("c")), 1).when(F.col("lr") < F.col("r"), 2).otherwise(3)
    off = F.when(F.col("lc") == F.col("c"), 0).otherwise(1)
    away = F.abs(F.col("lr") - F.col("r")) + F.abs(F.col("lc") - F.col("c"))
    # The least of each marker is kept as rows arrive; nothing is sorted.
    kept = [c for c in rows.columns if c not in (*doc, *ident)]
    names = [f"label_{i}" for i in ident]
    best = F.min_by(F.struct(*kept), F.struct(place.alias("p"), off.alias("o"), away.alias("a"), *names)).alias("__best")
    return rows.groupBy(*doc, *ident).agg(best).select(*doc, *ident, "__best.*")


def numbered(df: DataFrame, order: Sequence[Column], place: str = "place", ranges: int | None = None, number: str | None = None) -> DataFrame:
    """df with each row's place (1, 2, ...) in an order, and with the number of
    its range where that has a name. Tasks sort ranges of the
    order; rows that are equal in it are dealt over ranges as well, so a single
    value that fills the table is no single task's. Sorted ranges are written
    once, and the sizes of the ranges before (one number a range) are added."""
    rows = df.withColumn("__tie", F.monotonically_increasing_id())
    sorted_ = rows.repartitionByRange(*([ranges] if ranges else []), *order, F.col("__tie")).sortWithinPartitions(*order, "__tie").drop("__tie")
    # The id is the range's number, shifted by 33 bits, and the place in the range.
    table = staged(sorted_.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    at = F.shiftright("__id", 33)
    sizes = table.groupBy(at.alias("__range")).agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.col("__id").bitwiseAND((1 << 33) - 1)
    out = table.withColumn("__range", at).join(F.broadcast(before), "__range")
    out = out.withColumn(place, F.col("__before") + within + 1)
    return (out.withColumn(number, F.col("__range")) if number else out).drop(*({"__range", "__before", "__id"} - {number}))


def smallest(df: DataFrame, keys: Sequence[str], k: int, bits: int = 60, step: int = 12) -> list[int]:
    """The k-th smallest keys of df, which are numbers of so many bits, the first
    that differs deciding. Each pass counts the rows of 2 ** step ranges of the
    one that holds the k-th; at most so many counts reach the driver."""
    out: list[int] = []
    for key in keys:
        prefix, known = 0, 0
        while known < bits:
            width = min(step, bits - known)
            known += width
            at = F.shiftright(key, bits - known)
            counts = dict(df.groupBy(at.bitwiseAND((1 << width) - 1).alias("at")).agg(F.count("*")).collect())
            for place in sorted(counts):
                if k <= counts[place]:
                    break
                k -= counts[place]
            prefix = prefix << width | place
            df = df.where(at == prefix)
        out.append(prefix)
        if counts[place] == 1 and len(out) < len(keys):
            return out + list(df.select(*keys[len(out) :]).first())
    return out


def sequences(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """keys, first and n of each run of consecutive numbers; a repeated number counts once."""
    some = rows.select(*keys, number).distinct()
    g = some.withColumn("__g", F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number)))
    return g.groupBy(*keys, "__g").agg(F.min(number).alias("first"), F.count("*").alias("n")).drop("__g")
