"""Checks of rendered images by their grey values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import png

#: Grey values from here on count as white, and sides below this as implausible.
WHITE, LEAST = 250, 16


def _grey(content: pa.Array) -> pa.Array:
    """One image is held at a time; counts stay arrays and become no Python numbers."""
    sizes, errors = np.zeros((2, len(content)), np.int32), [None] * len(content)
    counts = np.zeros((len(content), 256), np.int64)
    for i, data in enumerate(content):
        try:
            sizes[0, i], sizes[1, i], counts[i] = png.histogram(data.as_py() or b"")
        except ValueError as e:
            errors[i] = f"invalid PNG: {e}"
    error = pa.array(errors, pa.string())
    places = pa.array(np.arange(len(content) + 1, dtype=np.int32) * 256)
    lists = pa.ListArray.from_arrays(places, pa.array(counts.reshape(-1)), mask=error.is_valid())
    return pa.StructArray.from_arrays([pa.array(sizes[0]), pa.array(sizes[1]), lists, error], ["width", "height", "histogram", "error"])


def grey_values(content: Column) -> Column:
    """Size and counts of the grey values of each PNG; what cannot be read is an error of its row."""
    return F.arrow_udf(_grey, "struct<width:int,height:int,histogram:array<bigint>,error:string>")(content)


def nonwhite(histogram: Column) -> Column:
    """The share of pixels that are not white."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.coalesce(total(F.slice(histogram, 1, WHITE)) / F.nullif(total(histogram), F.lit(0)), F.lit(0.0))


def checked(images: DataFrame, content: str, audited: str) -> DataFrame:
    """images with width, height, histogram, nonwhite, ok and reason (audited:
    what the layout audit says of the image, null if it has no record)."""
    rows = images.withColumn("__i", grey_values(F.col(content))).withColumns({c: F.col(f"__i.{c}") for c in ("width", "height", "histogram")})
    rows = rows.withColumn("nonwhite", nonwhite(F.col("histogram")))
    size = F.concat(F.lit("implausible dimensions: "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    bad = F.when((F.col("width") < LEAST) | (F.col("height") < LEAST), size).when(F.col("nonwhite") == 0, "blank white image").when(F.col(audited).isNull(), "missing layout-audit record")
    reason = F.coalesce("__i.error", bad, F.lit(""))
    return rows.withColumns({"reason": reason, "ok": (reason == "") & F.coalesce(F.col(audited), F.lit(False))}).drop("__i")


def merged(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, images, failed, the ranges of sizes that could be read, and the share
    of all pixels that are not white: counts of grey values add up before any shuffle."""
    known = F.col("width") > 0
    of = lambda f, c: f(F.when(known, F.col(c)))
    sums = [F.sum(F.element_at("histogram", i + 1)).alias(f"h{i}") for i in range(256)]
    out = images.groupBy(*keys).agg(
        F.count("*").alias("images"), F.count_if(~F.col("ok")).alias("failed"), of(F.min, "width").alias("min_width"), of(F.max, "width").alias("max_width"),
        of(F.min, "height").alias("min_height"), of(F.max, "height").alias("max_height"), *sums,
    )
    return out.withColumn("nonwhite", nonwhite(F.array(*(F.coalesce(f"h{i}", F.lit(0)) for i in range(256))))).drop(*(f"h{i}" for i in range(256)))
