"""Nested documents around whole texts with edits of known cost, and what the JSON distances say of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jsonpairs
from ..operators.clustered import dealt
from .registry import query

#: Distances beyond this are not told.
THRESHOLD = 6


def _pairs(t):
    """doc_id, edit, gold, pred: a document with its whole text; the edit is told by the key."""
    status, tags = F.concat(F.lit("s "), "source"), [F.col("lang"), F.concat(F.lit("by "), "source")]
    price, kind = F.col("n_chars"), F.col("doc_id") % 7
    obj = lambda **members: F.struct(*(v.alias(k) for k, v in members.items()))
    top = {"id": F.col("doc_id"), "owner": F.col("doc_id") + 1, "text": F.col("text")}
    inner = obj(status=status, price=price, tags=F.array(*tags))
    made = {
        "order": obj(**dict(reversed(top.items())), form=obj(tags=F.array(*tags), price=price, status=status)),
        "key": obj(sheet=inner, **top),
        "value": obj(form=obj(status=F.lit("other"), price=price, tags=F.array(*tags)), **top),
        "swap": obj(form=obj(status=status, price=price, tags=F.array(*reversed(tags))), **top),
        "removed": obj(form=obj(status=status, price=price), **top),
        "wrapped": obj(form=obj(body=inner), **top),
        "unrelated": F.array(*(F.lit(f"q{i}") for i in range(15))),
    }
    edit, pred = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, x) in enumerate(made.items()):
        edit, pred = F.when(kind == i, name).otherwise(edit), F.when(kind == i, F.to_json(x)).otherwise(pred)
    return dealt(t("documents"), "doc_id").select("doc_id", edit.alias("edit"), F.to_json(obj(form=inner, **top)).alias("gold"), pred.alias("pred"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 < 6 THEN CAST([0, 1, 1, 2, 4, 2][doc_id % 7 + 1] AS INTEGER) END AS distance,
  CASE WHEN doc_id % 7 < 6 THEN 'exact' ELSE 'beyond' END AS state, doc_id % 7 = 6 AS pruned FROM documents""")
def json_distance_exact(t):
    """The exact distance ignores the order of members and sees a renamed key or a wrapped object as one step a node."""
    return jsonpairs.bounded_distances(_pairs(t), "pred", "gold", THRESHOLD).select("doc_id", "distance", "state", "pruned")


@query("""
WITH k AS (SELECT doc_id % 7 AS k, count(*) AS pairs FROM documents GROUP BY 1),
known(k, edit, exact, ordered) AS (VALUES (0, 'order', 0, 0), (1, 'key', 1, 9), (2, 'value', 1, 1), (3, 'swap', 2, 2), (4, 'removed', 4, 4), (5, 'wrapped', 2, 14), (6, 'unrelated', NULL, NULL))
SELECT edit, pairs, CASE WHEN exact IS NULL THEN pairs ELSE 0 END AS pruned, CASE WHEN exact IS NULL THEN pairs ELSE 0 END AS beyond,
  CASE WHEN exact IS NULL THEN 0 ELSE pairs END AS compared, CAST(ordered - exact AS DOUBLE) AS mean_error, CAST(ordered - exact AS INTEGER) AS max_error
FROM k JOIN known USING (k)""")
def json_metric_validation(t):
    """The ordered tree distance against the exact one: what it overstates, by kind of edit."""
    return jsonpairs.validated(_pairs(t), "pred", "gold", ["edit"], THRESHOLD)
