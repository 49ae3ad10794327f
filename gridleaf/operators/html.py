"""Documents to rows: each document is parsed once, in an Arrow UDF."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions import dom
from ..functions.text import arrow, arrow_rows

CONTROL = "struct<idx:int,kind:string,value:string>"
CELL = f"struct<row:int,col:int,rowspan:int,colspan:int,tag:string,text:string,html:string,controls:array<{CONTROL}>>"


def _cell(row: int, col: int, node: dom.Node) -> dict:
    return {
        "row": row,
        "col": col,
        "rowspan": dom.span(node.attrs.get("rowspan")),
        "colspan": dom.span(node.attrs.get("colspan")),
        "tag": node.name,
        "text": node.text(" ", True),
        "html": node.markup(),
        "controls": [{"idx": i, "kind": dom.control_kind(c), "value": dom.control_value(c)} for i, c in enumerate(dom.controls(node))],
    }


def cells_of(layout: str):
    @arrow_rows(f"array<{CELL}>")
    def run(h: str | None) -> list[dict]:
        return [_cell(r, c, n) for (r, c), n in sorted(dom.cells(h, layout).items(), key=lambda i: i[0])]

    return run


def strategy_cells_of(marker: str):
    """Cells under all three coordinate strategies, from one call."""

    @arrow(f"array<struct<strategy:string,cell:{CELL}>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda h: [{"strategy": s, "cell": _cell(r, c, n)} for s in ("leaf", "analysis", "recursive") for r, c, n in dom.strategy_cells(h, s, marker)])

    return run


@arrow("string")
def visible_text(x: pd.Series) -> pd.Series:
    return x.map(dom.visible_text)


@arrow("array<struct<depth:int,nested:int,wrapper:boolean,rows:int>>")
def table_profile(x: pd.Series) -> pd.Series:
    return x.map(dom.table_profile)


@arrow("struct<ok:boolean,reason:string>")
def form_verdict(source: pd.Series, generated: pd.Series) -> pd.DataFrame:
    def one(a, b) -> str:
        if b is None or not b.strip():
            return "empty"
        if "```" in b:
            return "fenced"
        if a is None:
            return "structure differs"
        x, y = dom.parse(a), dom.parse(b)
        if x.all("table") and not y.all("table"):
            return "no table"
        if dom.signature_of(x) != dom.signature_of(y):
            return "structure differs"
        return "text unchanged" if dom.text_of(x) == dom.text_of(y) else ""

    reasons = [one(a, b) for a, b in zip(source, generated, strict=True)]
    return pd.DataFrame({"ok": [not r for r in reasons], "reason": reasons})


@arrow("string")
def structure_signature(x: pd.Series) -> pd.Series:
    return x.map(dom.structure_signature)


@arrow("string")
def table_signature(x: pd.Series) -> pd.Series:
    return x.map(dom.table_signature)


@arrow("array<array<int>>")
def row_widths(x: pd.Series) -> pd.Series:
    return x.map(lambda h: [dom.row_widths(t) for t in dom.parse(h).all("table")])


@arrow_rows("string")
def inputs_for_markers(h: str | None) -> str:
    return dom.inputs_for_markers(h or "")


@arrow("string")
def stripped_markers(x: pd.Series) -> pd.Series:
    return x.map(dom.stripped_markers)


@arrow("array<struct<row:int,col:int,text:string>>")
def scanned_cells(x: pd.Series) -> pd.Series:
    """Cells by pattern alone, for documents that no tree can be made of."""
    return x.map(lambda h: [{"row": r, "col": c, "text": t} for (r, c), t in dom.scanned_cells(h or "").items()])


@arrow("struct<html:string,target:int,repaired:int,unresolved:int>")
def repaired_columns(x: pd.Series) -> pd.DataFrame:
    """A document whose tables' rows are brought to each table's modal width, the
    greatest target and the rows repaired and not."""
    rows = []
    for h in x:
        root = dom.parse(h)
        found = [dom.repaired_widths(t) for t in root.all("table")]
        rows.append((root.markup(), max((f["target"] for f in found), default=0), sum(f["repaired"] for f in found), sum(f["unresolved"] for f in found)))
    return pd.DataFrame(rows, columns=["html", "target", "repaired", "unresolved"])


@arrow("struct<empty_cells:int,cells:int,empty_rows:int,rows:int>")
def emptiness(x: pd.Series) -> pd.DataFrame:
    """Cells, and rows of cells, without text and controls."""
    rows = []
    for h in x:
        found = dom.empty_cells(h)
        by_row: dict[int, list[bool]] = {}
        for r, _, empty in found:
            by_row.setdefault(r, []).append(empty)
        rows.append((sum(e for *_, e in found), len(found), sum(map(all, by_row.values())), len(by_row)))
    return pd.DataFrame(rows, columns=["empty_cells", "cells", "empty_rows", "rows"])


@arrow("string")
def repaired_gold(html: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([dom.repaired_gold(a or "", b or "") for a, b in zip(html, reference, strict=True)])


@arrow("string")
def restored_static(template: pd.Series, filled: pd.Series, output: pd.Series) -> pd.Series:
    return pd.Series([dom.restored_static(*r) for r in zip(template, filled, output, strict=True)])


@arrow("array<string>")
def static_changes(template: pd.Series, filled: pd.Series, output: pd.Series) -> pd.Series:
    return pd.Series([dom.static_changes(*r) for r in zip(template, filled, output, strict=True)])


def cells(docs: DataFrame, html: str = "html", layout: str = "all_logical_regions") -> DataFrame:
    """A row for each logical cell, with the document's other columns."""
    rest = [c for c in docs.columns if c != html]
    return docs.select(*rest, F.explode(cells_of(layout)(F.col(html))).alias("cell")).select(*rest, "cell.*")


def placeholder_rows(grid: DataFrame, keys: list[str], normalise) -> DataFrame:
    """Placeholders of each cell with their index among equal normalised names."""
    from pyspark.sql import Window as W

    from ..functions.text import placeholders

    rows = grid.select(*keys, "row", "col", F.posexplode(placeholders(F.col("text"))).alias("pos", "name"))
    order = W.partitionBy(*keys, "row", "col", normalise(F.col("name"))).orderBy("pos")
    return rows.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def table_tags(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<\s*table(?:\s|>|/)"))


def as_table(rows: Column) -> Column:
    """Markup of a table from array<array<string>> of cell markup."""
    row = lambda cells_: F.concat(F.lit("<tr>"), F.array_join(cells_, ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))


def td(x: Column, **attrs: Column | int) -> Column:
    """A cell's markup; text is escaped."""
    safe = F.replace(F.replace(F.replace(x.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.lit("<td")
    for k, v in attrs.items():
        value = v.cast("string") if isinstance(v, Column) else F.lit(str(v))
        head = F.concat(head, F.lit(f' {k}="'), value, F.lit('"'))
    return F.concat(head, F.lit(">"), safe, F.lit("</td>"))




def with_verdicts(rows: DataFrame, verdicts: DataFrame, position: Sequence[str], value: str) -> DataFrame:
    """rows whose value is the reviewer's verdict where the position has one (verdicts: position, verdict)."""
    side = verdicts.select(*position, F.col("verdict").alias("__v"))
    return rows.join(side, list(position), "left").withColumn(value, F.coalesce("__v", value)).drop("__v")
