"""Images drawn from the rows of documents, and what their grey values tell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import png
from ..functions.text import arrow
from ..operators import images
from ..operators.clustered import dealt
from .registry import query


@arrow("binary")
def drawn(width: pd.Series, height: pd.Series, dark: pd.Series, kind: pd.Series) -> pd.Series:
    """A PNG of width x height pixels, the first of which are dark, in one of six forms; form 6 is cut short."""

    def one(w: int, h: int, n: int, k: int) -> bytes:
        grey = np.where(np.arange(w * h) < n, 249, 250).astype(np.uint8).reshape(h, w)
        every = (0, 1, 2, 3, 4)
        if k == 0:
            return png.encoded(grey, filters=every)
        if k == 1:
            return png.encoded(np.repeat(grey, 3, axis=1), colour=2, filters=every)
        if k == 2:
            return png.encoded(250 - grey, colour=3, filters=(0, 4), palette=bytes([250] * 3 + [249] * 3))
        if k == 3:
            return png.encoded(np.stack([grey, grey, grey, np.full_like(grey, 7)], axis=2).reshape(h, 4 * w), colour=6, filters=(4, 3))
        if k == 4:
            return png.encoded(np.stack([grey, np.full_like(grey, 200)], axis=2).reshape(h, 2 * w), depth=16, filters=(2, 1))
        if k == 5:
            return png.encoded(np.stack([grey, 255 - grey], axis=2).reshape(h, 2 * w), colour=4, filters=every)
        return png.encoded(grey)[:-20]

    return pd.Series([one(*map(int, r)) for r in zip(width, height, dark, kind, strict=True)])


def _images(t):
    k = F.col("doc_id")
    width, height = F.lit(15) + k % 17, F.lit(16) + k % 11
    rows = dealt(t("documents"), "doc_id").select(k, "lang", width.alias("w"), height.alias("h"), F.when(k % 13 == 0, 0).otherwise(F.col("n_chars") % (width * height + 1)).alias("n"), (k % 7).alias("form"))
    audited = F.when(k % 5 == 0, None).otherwise(k % 3 != 0)
    return rows.select("doc_id", "lang", drawn("w", "h", "n", "form").alias("content"), audited.alias("audited"))


_DRAWN = """(SELECT doc_id, lang, 15 + doc_id % 17 AS w, 16 + doc_id % 11 AS h, doc_id % 7 = 6 AS broken, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 <> 0 END AS audited,
  CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars % ((15 + doc_id % 17) * (16 + doc_id % 11) + 1) END AS n FROM documents)"""
_CHECKED = f"""(SELECT *, CASE WHEN broken THEN 'invalid PNG: cut short' WHEN w < 16 THEN 'implausible dimensions: ' || w || 'x' || h WHEN n = 0 THEN 'blank white image' WHEN audited IS NULL THEN 'missing layout-audit record' ELSE '' END AS reason FROM {_DRAWN})"""


@query(f"""
SELECT doc_id, CAST(CASE WHEN broken THEN 0 ELSE w END AS INTEGER) AS width, CAST(CASE WHEN broken THEN 0 ELSE h END AS INTEGER) AS height, CASE WHEN broken THEN 0.0::DOUBLE ELSE n::DOUBLE / (w * h) END AS nonwhite,
  reason, reason = '' AND coalesce(audited, false) AS ok FROM {_CHECKED}""")
def grey_image_checks(t):
    """Broken, small, blank and unaudited images, and the share of pixels that are not white."""
    return images.checked(_images(t), "content", "audited").select("doc_id", "width", "height", "nonwhite", "reason", "ok")


@query(f"""
SELECT lang, count(*) AS images, count(*) FILTER (NOT (reason = '' AND coalesce(audited, false))) AS failed, CAST(min(w) FILTER (NOT broken) AS INTEGER) AS min_width, CAST(max(w) FILTER (NOT broken) AS INTEGER) AS max_width,
  CAST(min(h) FILTER (NOT broken) AS INTEGER) AS min_height, CAST(max(h) FILTER (NOT broken) AS INTEGER) AS max_height, coalesce(sum(n) FILTER (NOT broken)::DOUBLE / sum(w * h) FILTER (NOT broken)::DOUBLE, 0) AS nonwhite
FROM {_CHECKED} GROUP BY lang""")
def grey_image_groups(t):
    """The same by language; counts of grey values add up."""
    return images.merged(images.checked(_images(t), "content", "audited"), ["lang"])
