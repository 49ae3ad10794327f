"""Distances of pairs of JSON documents: bounds on the JVM side, then the exact distance of what is left."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsondistance, jsontree
from ..functions.text import arrow
from . import score


def document_labels(text: Column) -> Column:
    """One text for each node of a document, so that nodes the exact distance
    takes for equal have equal texts (nodes that differ may share one): strings
    without escapes and white space, numbers as doubles. Null if the text is no
    JSON object or array as it stands."""
    plain = F.to_json(F.try_parse_json(text))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\\u[0-9a-fA-F]{4}|\\.", ""), r"(?U)\s", "")
    tokens = F.regexp_extract_all(plain, F.lit(r'"[^"]*":?|[{\[]|[^\[\]{},:"]+'), F.lit(0))
    same = F.transform(tokens, lambda t: F.when(t.rlike(r"^-?[0-9]"), t.cast("double").cast("string")).otherwise(t))
    return F.when(plain.rlike(r"^[{\[]"), same)


def least_distance(a: Column, b: Column) -> Column:
    """What the counts of labels alone require of two documents (arrays of labels)."""
    numbered = lambda xs: F.transform(F.sort_array(xs), lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(F.sort_array(xs), x)).cast("string")))
    return F.greatest(F.size(a), F.size(b)) - F.size(F.array_intersect(numbered(a), numbered(b)))


def json_distance(threshold: int):
    """distance and state of two texts: exact, beyond, or no_document where one cannot be read; null for null texts."""

    @arrow("struct<distance:int,state:string>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for pair in zip(a, b, strict=True):
            if pair[0] is None or pair[1] is None:
                rows.append((None, None))
                continue
            found = [jsontree.lenient(x) for x in pair]
            usable = all(s in jsontree.USABLE for _, s in found)
            rows.append(jsondistance.json_distance_bounded(found[0][0], found[1][0], threshold) if usable else (None, "no_document"))
        return pd.DataFrame(rows, columns=["distance", "state"]).astype({"distance": "Int32"})

    return run


def bounded_distances(pairs: DataFrame, a: str, b: str, threshold: int = 1000) -> DataFrame:
    """pairs with least (the JVM-side bound, null where a text is no plain JSON),
    distance, state and pruned. Pairs whose bound is beyond the threshold are
    never sent to Python."""
    rows = pairs.withColumns({"__a": document_labels(F.col(a)), "__b": document_labels(F.col(b))})
    rows = rows.withColumn("least", F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), least_distance(F.col("__a"), F.col("__b")))).drop("__a", "__b")
    pruned = F.coalesce(F.col("least") > threshold, F.lit(False))
    sent = lambda c: F.when(~pruned, F.coalesce(F.col(c), F.lit("")))
    rows = rows.withColumns({"pruned": pruned, "__d": json_distance(threshold)(sent(a), sent(b))})
    state = F.when(F.col("pruned"), "beyond").otherwise(F.col("__d.state"))
    return rows.withColumns({"distance": F.col("__d.distance"), "state": state}).drop("__d")


def validated(pairs: DataFrame, a: str, b: str, keys: Sequence[str], threshold: int = 1000) -> DataFrame:
    """By group: pairs, those pruned and beyond, and the mean and greatest
    difference of the ordered tree distance from the exact one, where both are
    known. The ordered distance is computed only for those."""
    rows = bounded_distances(pairs, a, b, threshold)
    known = F.col("state") == "exact"
    rows = rows.withColumn("ordered", score.tree_edit_distance(F.when(known, F.col(a)), F.when(known, F.col(b))))
    error = F.abs(F.col("ordered") - F.col("distance"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.count_if("pruned").alias("pruned"), F.count_if(F.col("state") == "beyond").alias("beyond"),
        F.count(error).alias("compared"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"),
    )
