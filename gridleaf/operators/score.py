"""Scorers of the three tasks: one row in, one row out, states instead of failures."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsontree, meta, scoring
from ..functions.text import arrow, arrow_rows, without_thinking

COUNTS = "struct<correct:int,total:int>"


def infill_counts(matcher: str = "source_faithful_v3"):
    @arrow_rows(COUNTS)
    def run(pred: str | None, gold: str | None, blank: str | None) -> dict:
        correct, total = scoring.infill(pred, gold, blank, matcher)
        return {"correct": correct, "total": total}

    return run


def infill_targets(matcher: str = "source_faithful_v3"):
    @arrow_rows("array<struct<row:int,col:int,kind:string,correct:boolean>>")
    def run(pred: str | None, gold: str | None, blank: str | None) -> list[dict]:
        fields = ("row", "col", "kind", "correct")
        return [{f: t[f] for f in fields} for t in scoring.MATCHERS[matcher](pred, gold, blank)]

    return run


@arrow_rows("struct<strategy:string,correct:int,total:int,types:array<struct<type:string,ok:boolean>>>")
def alignment_result(pred: str | None, gold: str | None, meta_json: str | None) -> dict:
    document, _ = jsontree.lenient(meta_json)
    strategy, found = scoring.alignment(pred, gold, jsontree.expected_of(document or []))
    return {"strategy": strategy, "correct": sum(ok for _, ok in found), "total": len(found), "types": [{"type": t, "ok": ok} for t, ok in found]}


@arrow_rows("array<string>")
def meta_types(meta_json: str | None) -> list[str] | None:
    """The types of a meta document's targets, in order; null where it cannot be read."""
    document, status = jsontree.lenient(meta_json)
    return [x["type"] for x in jsontree.expected_of(document)] if status == "ok" else None


def meta_targets(meta_json: Column) -> Column:
    found = meta_types(meta_json)
    return F.when(found.isNotNull(), F.size(found))


#: Metrics that are computed here; the external one ('cpp') has no backend.
SCHEMA_METRICS = ("py_tree", "py_fast")


def schema_result(mode: str = "py_tree"):
    """similarity and the states of both sides; an unusable side scores 0."""
    if mode not in SCHEMA_METRICS:
        raise ValueError(f"no backend for the metric {mode}")

    @arrow_rows("struct<similarity:double,pred_status:string,gold_status:string>")
    def run(pred: str | None, gold: str | None) -> dict:
        a, sa = jsontree.object_only(pred, "pred")
        b, sb = jsontree.object_only(gold, "gold")
        return {"similarity": jsontree.similarity(a, b, mode) if a is not None and b is not None else 0.0, "pred_status": sa, "gold_status": sb}

    return run


@arrow("struct<json:string,status:string>")
def lenient_json(x: pd.Series) -> pd.DataFrame:
    import json

    rows = []
    for v in x:
        found, status = jsontree.lenient(v)
        rows.append((json.dumps(found, ensure_ascii=False) if status in ("ok", "repaired", "non_string") else None, status))
    return pd.DataFrame(rows, columns=["json", "status"])


@arrow("array<struct<node:int,parent:int,label:string,size:int>>")
def json_nodes(x: pd.Series) -> pd.Series:
    def one(v):
        found, status = jsontree.lenient(v)
        if status not in jsontree.USABLE:
            return []
        t = jsontree.Tree(jsontree.normalised(found))
        return [{"node": i, "parent": p, "label": label, "size": s} for i, (p, label, s) in enumerate(zip(t.parents, t.labels, t.sizes, strict=True))]

    return x.map(one)


@arrow("string")
def bracket_form(x: pd.Series) -> pd.Series:
    """A document's tree in bracket form for external tools; null without a document."""

    def one(v):
        found, status = jsontree.lenient(v)
        return jsontree.brackets(jsontree.Tree(found)) if status in jsontree.USABLE else None

    return x.map(one)


@arrow("array<string>")
def json_candidates(x: pd.Series) -> pd.Series:
    """The documents that a response may stand for, in order."""
    import json

    return x.map(lambda v: [json.dumps(c, ensure_ascii=False) for c in jsontree.candidates(v or "")])


@arrow("int")
def tree_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        (p, sp), (q, sq) = jsontree.lenient(x), jsontree.lenient(y)
        return jsontree.edit_distance(jsontree.Tree(p), jsontree.Tree(q)) if {sp, sq} <= jsontree.USABLE else None

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@arrow("struct<ok:boolean,reason:string>")
def conforms(template: pd.Series, output: pd.Series) -> pd.DataFrame:
    rows = []
    for t, o in zip(template, output, strict=True):
        a, b = jsontree.lenient(t)[0], jsontree.lenient(o)[0]
        rows.append(jsontree.conforms(a, b) if a is not None and b is not None else (False, "$: no document"))
    return pd.DataFrame(rows, columns=["ok", "reason"])


@arrow_rows("array<struct<key:string,row:int,col:int,offsets:array<struct<rows:int,cols:int>>,is_object_type:boolean,is_non_pure_text:boolean,type:string>>")
def meta_items(html: str | None) -> list[dict]:
    return [{**i, "offsets": [{"rows": r, "cols": c} for r, c in i["offsets"]]} for i in meta.meta_items(html)]


@arrow("struct<distance:long,na:long,nb:long,similarity:double>")
def label_distance(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """The fast distance of two documents that meet in a row: differences of
    their label counts, and one for different roots. A side without a document has no labels."""
    rows = []
    for pair in zip(pred, gold, strict=True):
        trees = [jsontree.Tree(jsontree.normalised(d)) if s in jsontree.USABLE else None for d, s in map(jsontree.lenient, pair)]
        a, b = (Counter(t.labels) if t else Counter() for t in trees)
        roots = [t.labels[0] if t else None for t in trees]
        na, nb = a.total(), b.total()
        d = ((a - b) + (b - a)).total() + (roots[0] != roots[1])
        rows.append((d, na, nb, max(0.0, min(1.0, 1 - d / (na + nb))) if na + nb else 1.0))
    return pd.DataFrame(rows, columns=["distance", "na", "nb", "similarity"])


def prediction_status(document: Column) -> Column:
    """The state of a prediction file's content: missing, invalid_json, non_object_json, empty_response or ready."""
    parsed = F.try_parse_json(document)
    kind = F.schema_of_variant(parsed)
    raw = F.get_json_object(document, "$.raw_response")
    return (
        F.when(document.isNull(), "missing")
        .when(parsed.isNull(), "invalid_json")
        .when(~F.startswith(kind, F.lit("OBJECT")), "non_object_json")
        .when(F.coalesce(F.trim(without_thinking(raw)), F.lit("")) == "", "empty_response")
        .otherwise("ready")
    )


