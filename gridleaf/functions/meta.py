"""From a marked form to meta items: label search, grouping, field types. Plain Python."""

from __future__ import annotations

import re

from . import dom
from .dom import BRACKET, LAZY, Node


def word(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


def cleaned(html: str) -> str:
    """Qualified markers [A-B-C] as [C]."""
    return re.sub(r"\[[^\]]*-([^\]-]*)\]", r"[\1]", html)


def markers(cell: Node, html: str | None = None) -> list[str]:
    """Markers of a cell's text, then of its markup, each once."""
    html = cell.markup() if html is None else html
    if "[" not in html:  # a bracket of the text stands in the markup as it is
        return []
    return list(dict.fromkeys(m[1:-1] for m in [*LAZY.findall(cell.text()), *LAZY.findall(html)]))


def meta_grid(rows: list[list[Node]], most: int = 50) -> list[tuple[int, int, Node]]:
    """Cells at their first slot; spans stay in the table, columns past the last are skipped."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, cells in enumerate(rows):
        c = 0
        for cell in cells:
            while (r, c) in taken:
                c += 1
            if c >= most:
                continue
            down = min(dom.strict_span(cell.attrs.get("rowspan")), len(rows) - r)
            over = min(dom.strict_span(cell.attrs.get("colspan")), most - c)
            taken |= {(r + i, c + j) for i in range(down) for j in range(over)}
            out.append((r, c, cell))
            c += over
    return out


def _search_key(name: str) -> str:
    return word(re.sub(r"\d+$", "", name))


def searched(grid: list[tuple[int, int, Node]]) -> list[tuple[int, int, str, str, str]]:
    """Row, column, text and, as search keys, the text and the text without markers of each cell."""
    texts = [(r, c, n.text()) for r, c, n in grid]
    return [(r, c, t.strip(), word(t), word(LAZY.sub("", t))) for r, c, t in texts]


def nearest(name: str, row: int, col: int, cells: list[tuple[int, int, str, str, str]]) -> tuple[int, int] | None:
    """The label of a marker: cells whose text holds its key, the same cell
    first, then to the left, above, anywhere else; in a class the marker's
    column first, then the smallest distance, then grid order."""
    key = _search_key(name)
    best = None
    if not key:
        return None
    for order, (r, c, text, whole, rest) in enumerate(cells):
        if key not in whole or text == f"[{name}]" or key not in rest:
            continue
        place = 0 if (r, c) == (row, col) else 1 if r == row and c < col else 2 if r < row else 3
        rank = (place, 0, 0, order) if place == 0 else (place, c != col, abs(r - row) + abs(c - col), order)
        if best is None or rank < best[0]:
            best = (rank, (r, c))
    return best[1] if best else None


def _headers(places: list[tuple[int, int, str]]) -> list[tuple[int, int] | None]:
    """For a marker, the nearest marker of the same base name above it."""
    out = []
    for r, c, name in places:
        above = [(c2 != c, r - r2, abs(c - c2), k) for k, (r2, c2, n2) in enumerate(places) if r2 < r and _search_key(n2) == _search_key(name)]
        out.append(places[min(above)[3]][:2] if above else None)
    return out


def _located(grid: list[tuple[int, int, Node]], infer: bool) -> list[dict]:
    texts = searched(grid)
    places = []
    for r, c, n in grid:
        html = n.markup()
        places += [(r, c, name, html) for name in markers(n, html)]
    labels = [nearest(name, r, c, texts) for r, c, name, _ in places]
    if infer and places and not any(labels):
        labels = _headers([p[:3] for p in places])
        if not any(labels):
            labels = [p[:2] for p in places]
    return [{"key": name, "label": at, "row": r, "col": c, "html": html} for (r, c, name, html), at in zip(places, labels, strict=True) if at]


def analysed(html: str) -> list[dict]:
    """Markers with labels, from the first way of reading the tables that gives any."""
    root = dom.parse(cleaned(html))
    has = lambda t: bool(LAZY.search(t.markup()))
    for kind in (dom.leaf_tables, dom.analysis_tables):
        tables = kind(root, has)
        rows = [row.direct("td", "th") for t in tables for row in dom.direct_rows(t)]
        if found := _located(meta_grid(rows), True):
            return found
    rows = root.all("tr")
    if rows:
        return _located(meta_grid([row.all("td") for row in rows]), False)
    names = list(dict.fromkeys(m[1:-1] for m in LAZY.findall(root.text())))
    return [{"key": n, "label": (i, 0), "row": i, "col": 0, "html": f"[{n}]"} for i, n in enumerate(names)]


_NON_PURE = re.compile(r"<input|<select|\(√\)|\( \)|\[√\]|\[ \]|\(×\)|\[×\]", re.I)


def grouped(found: list[dict]) -> list[dict]:
    """Meta items: numbered keys with several numbers are repeated fields, whose
    runs start at 1 and count on in one column; other fields join the run of
    equal key and label."""
    found = sorted(found, key=lambda x: (x["row"], x["col"]))
    split = [re.match(r"^(.+?)(\d+)$", x["key"]) for x in found]
    suffixes: dict[str, set[str]] = {}
    for m in split:
        if m:
            suffixes.setdefault(m[1], set()).add(m[2])
    groups: list[tuple[bool, list[dict]]] = []
    open_runs: dict[str, tuple[list[dict], int]] = {}
    same_cell: dict[tuple, list[dict]] = {}
    last: list[dict] | None = None
    for x, m in zip(found, split, strict=True):
        if m and len(suffixes[m[1]]) >= 2:
            base, n = m[1], int(m[2])
            run = open_runs.get(base)
            if n == 1:
                open_runs[base] = ([x], 1)
                groups.append((True, open_runs[base][0]))
            elif run and n == run[1] + 1 and run[0][0]["col"] == x["col"]:
                run[0].append(x)
                open_runs[base] = (run[0], n)
            else:
                groups.append((True, [x]))
                open_runs.pop(base, None)
            continue
        if x["label"] == (x["row"], x["col"]):
            key = (x["row"], x["col"], x["key"])
            if key not in same_cell:
                same_cell[key] = []
                groups.append((False, same_cell[key]))
            same_cell[key].append(x)
            last = None
        elif last and last[-1]["key"] == x["key"] and last[-1]["label"] == x["label"]:
            last.append(x)
        else:
            last = [x]
            groups.append((False, last))
    out = []
    for repeated, xs in groups:
        r, c = xs[0]["label"]
        choice = any(_NON_PURE.search(x["html"]) for x in xs)
        kind = "LI" if repeated else ("GO" if (r, c) == (xs[0]["row"], xs[0]["col"]) else "SO") if choice else "GI" if len(xs) > 1 else "SI"
        key = re.sub(r"\d+$", "", xs[0]["key"]) if repeated and len(xs) > 1 else xs[0]["key"]
        out.append({"key": key, "row": r, "col": c, "offsets": [(x["row"] - r, x["col"] - c) for x in xs], "is_object_type": repeated, "is_non_pure_text": choice, "type": kind})
    order = ["LI", "GI", "SI", "GO", "SO"]
    out.sort(key=lambda i: order.index(i["type"]))
    out.sort(key=lambda i: (i["row"], i["col"]))
    return out


def meta_items(html: str | None) -> list[dict]:
    return grouped(analysed(html or ""))


__all__ = ["BRACKET", "analysed", "cleaned", "grouped", "markers", "meta_grid", "meta_items", "nearest"]
