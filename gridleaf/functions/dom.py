"""A tolerant HTML tree and the logical grids over it; plain Python, no Spark.

The tree follows the usual behaviour of an html.parser tree builder: void
elements hold nothing, an end tag pops to its opener or is ignored, nothing
closes by itself, entities are decoded, comments are no text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

from .text import infill_value

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "template")
STRIDE = 100_000
BRACKET = re.compile(r"\[([^\[\]]+)\]")
LAZY = re.compile(r"\[.*?\]")


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.name, self.attrs, self.parent, self.children = name, attrs or {}, parent, []

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order, without recursion."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            if node.__class__ is not str:
                yield node
                stack += node.children[::-1]

    def all(self, *names: str) -> list[Node]:
        out, stack = [], self.children[::-1]
        while stack:
            node = stack.pop()
            if node.__class__ is not str:
                if node.name in names:
                    out.append(node)
                if node.children:
                    stack += node.children[::-1]
        return out

    def direct(self, *names: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.name in names]

    def inside(self, *names: str) -> bool:
        up = self.parent
        while up is not None:
            if up.name in names:
                return True
            up = up.parent
        return False

    def strings(self, without: tuple[str, ...] = ()) -> list[str]:
        out, stack = [], self.children[::-1]
        while stack:
            c = stack.pop()
            if c.__class__ is str:
                out.append(c)
            elif c.name not in SILENT and c.name not in without and c.name != "#comment":
                stack += c.children[::-1]
        return out

    def text(self, joined: str = "", strip: bool = False, without: tuple[str, ...] = ()) -> str:
        parts = self.strings(without)
        if strip:
            parts = [s for s in (p.strip() for p in parts) if s]
        return joined.join(parts)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def markup(self, outer: bool = True) -> str:
        out: list[str] = []
        stack: list = [self] if outer else list(reversed(self.children))
        while stack:
            c = stack.pop()
            if c.__class__ is str:
                out.append(entities.escape(c, quote=False))
            elif c.__class__ is tuple:
                out.append(c[0])
            elif c.name == "#comment":
                out.append(f"<!--{c.attrs['']}-->")
            elif c.name == "#document":
                stack.extend(reversed(c.children))
            else:
                attrs = "".join([f' {k}="{entities.escape(v)}"' for k, v in c.attrs.items()]) if c.attrs else ""
                if c.name in VOID:
                    out.append(f"<{c.name}{attrs}/>")
                else:
                    out.append(f"<{c.name}{attrs}>")
                    stack.append((f"</{c.name}>",))
                    stack += [(x,) if isinstance(x, str) else x for x in reversed(c.children)] if c.name in SILENT else c.children[::-1]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up.name != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def handle_comment(self, data):
        self.at.children.append(Node("#comment", {"": data}, self.at))


#: Text up to a tag of the plainest form: names of letters, digits and hyphens, values in double quotes.
_PLAIN_TAG = re.compile(r'([^<]*)<(/?)([A-Za-z][A-Za-z0-9]*)((?: +[A-Za-z][A-Za-z0-9-]*(?:="[^"&<>]*")?)*)( */)?>')
_PLAIN_ATTR = re.compile(r' +([A-Za-z][A-Za-z0-9-]*)(?:="([^"]*)")?')
#: Elements whose content html.parser does not read as markup, in one version or another.
_RAW = frozenset("iframe listing math noembed noframes noscript plaintext script style svg template textarea title xmp".split())


def _plain(html: str) -> Node | None:
    """The tree of a document of the plainest tags only; None where there is anything else."""
    root = at = Node("#document")
    end, whole = 0, None
    while m := _PLAIN_TAG.match(html, end):
        text, closes, name, attrs, empty = m.groups()
        end = m.end()
        name = name.lower()
        if whole and (not closes or name != whole or "&" in text):
            return None
        if text:
            at.children.append(entities.unescape(text) if "&" in text else text)
        if closes:
            if attrs or empty:
                return None
            whole = None
            up = at
            while up is not None and up.name != name:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            continue
        if name in _RAW:
            # A text field of text alone reads the same either way.
            if name != "textarea" or empty:
                return None
            whole = name
        node = Node(name, {k.lower(): v for k, v in _PLAIN_ATTR.findall(attrs)} if attrs else None, at)
        at.children.append(node)
        if not empty and name not in VOID:
            at = node
    rest = html[end:]
    if whole or "<" in rest:
        return None
    if rest:
        at.children.append(entities.unescape(rest) if "&" in rest else rest)
    return root


def parse(html: str | None) -> Node:
    found = _plain(html or "")
    return _parsed(html) if found is None else found


def _parsed(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def span(value: str | None) -> int:
    if not value:
        return 1
    m = re.search(r"\d+", value)
    return max(1, int(m[0])) if m else 1


def strict_span(value: str | None) -> int:
    if not value:
        return 1
    try:
        n = int(value.strip())
    except ValueError:
        return 1
    return n if n > 0 else 1


def top_tables(root: Node) -> list[Node]:
    return [t for t in root.all("table") if not t.inside("table")]


def direct_rows(table: Node) -> list[Node]:
    """A table's own rows, sections being looked into, in document order."""
    out = []
    for c in table.children:
        if isinstance(c, Node):
            out += [c] if c.name == "tr" else c.direct("tr") if c.name in ("thead", "tbody", "tfoot") else []
    return out


def placed(rows: list[list[Node]], most: int | None = None) -> dict[tuple[int, int], Node]:
    """Cells by the slots they hold. A cell takes the first slot that nothing
    above has claimed and claims its spans, over earlier claims if need be; with
    most, rows end at that column."""
    slots: dict[tuple[int, int], Node] = {}
    for r, cells in enumerate(rows):
        c = 0
        for cell in cells:
            while (r, c) in slots:
                c += 1
            if most is not None and c >= most:
                break
            down, over = span(cell.attrs.get("rowspan")), span(cell.attrs.get("colspan"))
            for i in range(down):
                for j in range(over):
                    if most is None or c + j < most:
                        slots[r + i, c + j] = cell
            c += over
    return slots


def origins(slots: dict[tuple[int, int], Node]) -> dict[tuple[int, int], Node]:
    """Each cell once, at the smallest slot it still holds."""
    out, seen = {}, set()
    for at in sorted(slots):
        cell = slots[at]
        if id(cell) not in seen:
            seen.add(id(cell))
            out[at] = cell
    return out


def table_cells(table: Node) -> dict[tuple[int, int], Node]:
    """Grid of all descendant rows and cells."""
    return origins(placed([row.all("td", "th") for row in table.all("tr")]))


def form_cells(root: Node) -> dict[tuple[int, int], Node]:
    """Rows and columns of div forms."""
    out, r = {}, 0
    for box in (n for n in root.all("div") if "form-container" in n.classes()):
        for row in (n for n in box.direct("div") if "row" in n.classes()):
            cols = [n for n in row.direct("div") if {"col", "col-half", "col-full"} & set(n.classes())]
            for c, cell in enumerate(cols):
                out[r, c] = cell
            r += 1
    return out


def cells(html: str | None, layout: str = "all_logical_regions") -> dict[tuple[int, int], Node]:
    """The logical grid of a document: its first table, or all top-level tables
    at strides of rows, or its div form where it has no table."""
    return cells_of(parse(html), layout)


def cells_of(root: Node, layout: str) -> dict[tuple[int, int], Node]:
    tables = top_tables(root)
    if not tables:
        return form_cells(root) if layout == "all_logical_regions" else {}
    if layout == "first_table":
        tables = tables[:1]
    return {(r + STRIDE * k, c): cell for k, t in enumerate(tables) for (r, c), cell in table_cells(t).items()}


@lru_cache(maxsize=16)
def shared_tree(html: str | None) -> Node:
    return parse(html)


@lru_cache(maxsize=64)
def shared_cells(html: str | None, layout: str) -> dict[tuple[int, int], Node]:
    """As cells, for readers that change nothing: rows that hold the same form in turn parse it once, for all layouts."""
    return cells_of(shared_tree(html), layout)


# Controls


def control_kind(node: Node) -> str:
    return (node.attrs.get("type") or "text").casefold() if node.name == "input" else node.name


def control_value(node: Node) -> str:
    kind = control_kind(node)
    if kind in ("checkbox", "radio"):
        return "checked" if "checked" in node.attrs else "unchecked"
    if kind == "select":
        options = node.all("option")
        chosen = [o for o in options if "selected" in o.attrs] or options[:1]
        return "|".join(infill_value(o.attrs.get("value", o.text(" ", True))) for o in chosen)
    if kind == "textarea":
        return infill_value(node.text(" ", True))
    return infill_value(node.attrs.get("value", ""))


def controls(cell: Node) -> list[Node]:
    return cell.all("input", "select", "textarea")


def marked(node: Node) -> bool:
    return bool(BRACKET.search(node.text(" ", True))) or any(BRACKET.search(v) for v in node.attrs.values())


# Grids of the alignment task


def _marker(kind: str) -> Callable[[Node], bool]:
    if kind == "bracket":
        return lambda t: bool(BRACKET.search(t.text()))
    return lambda t: any(n.attrs.get("name") for n in t.all("input"))


def leaf_tables(root: Node, has: Callable[[Node], bool]) -> list[Node]:
    """Marked tables that hold no other marked table."""
    found = [t for t in root.all("table") if has(t)]
    ids = {id(t) for t in found}
    return [t for t in found if not any(id(i) in ids for i in t.all("table"))]


def analysis_tables(root: Node, has: Callable[[Node], bool]) -> list[Node]:
    """Top-level marked tables; of one-cell wrappers without own text, the marked tables right inside."""
    out, queue = [], [t for t in top_tables(root) if has(t)]
    while queue:
        t = queue.pop(0)
        own = [c for row in direct_rows(t) for c in row.direct("td", "th")]
        inner = [i for i in t.all("table") if has(i) and _nearest(i) is t]
        if len(own) == 1 and inner and not own[0].text(without=("table",)).strip():
            queue[:0] = inner
        else:
            out.append(t)
    return out


def _nearest(table: Node) -> Node | None:
    up = table.parent
    while up is not None and up.name != "table":
        up = up.parent
    return up


def strategy_cells(html: str | None, strategy: str, marker: str) -> list[tuple[int, int, Node]]:
    """(row, column, cell) under a coordinate strategy: leaf, analysis or recursive."""
    return strategy_cells_of(parse(html), strategy, marker)


def strategy_cells_of(root: Node, strategy: str, marker: str) -> list[tuple[int, int, Node]]:
    has = _marker(marker)
    if strategy == "recursive":
        tables = root.all("table")[:1]
        rows = [row.all("td", "th") for t in tables for row in t.all("tr")]
        return [(r, c, n) for (r, c), n in origins(placed(rows, 100)).items()]
    out, base = [], 0
    for t in (leaf_tables if strategy == "leaf" else analysis_tables)(root, has):
        rows = direct_rows(t)
        found = origins(placed([row.direct("td", "th") for row in rows], 100))
        out += [(base + r, c, n) for (r, c), n in found.items()]
        base += len(rows)
    return out


# Profiles, signatures and text


def visible_text(html: str | None) -> str:
    return text_of(parse(html))


def text_of(root: Node) -> str:
    return re.sub(r"\s+", " ", root.text(" ", True)).strip()


def table_profile(html: str | None) -> list[dict]:
    """Depth, nested tables and wrapper flag of each table in document order."""
    out = []
    for t in parse(html).all("table"):
        depth, up = 1, t.parent
        while up is not None:
            depth += up.name == "table"
            up = up.parent
        nested = t.all("table")
        own = re.sub(r"\s+", " ", t.text(" ", without=("table",)).replace("\xa0", " ")).strip()
        out.append({"depth": depth, "nested": len(nested), "wrapper": bool(nested) and not own, "rows": len(direct_rows(t))})
    return out


def row_widths(table: Node) -> list[int]:
    """Columns each own row covers, with what hangs down from above."""
    hanging: list[int] = []
    out = []
    for row in direct_rows(table):
        at, claims = 0, []
        for cell in row.direct("td", "th"):
            while at < len(hanging) and hanging[at] > 0:
                at += 1
            over, down = strict_span(cell.attrs.get("colspan")), strict_span(cell.attrs.get("rowspan"))
            claims += [(at + j, down) for j in range(over)]
            at += over
        width = max([at, *(i + 1 for i, n in enumerate(hanging) if n > 0)], default=0)
        hanging = [max(0, n - 1) for n in hanging] + [0] * (width - len(hanging))
        for i, down in claims:
            hanging[i] = max(hanging[i], down - 1)
        out.append(width)
    return out


def modal_width(widths: list[int]) -> int:
    """The most frequent width, the smaller one of ties."""
    return min(set(widths), key=lambda w: (-widths.count(w), w)) if widths else 0


def structure_signature(html: str | None) -> str:
    """The element tree with attributes, but for what filling in changes."""
    return signature_of(parse(html))


def signature_of(root: Node) -> str:
    volatile = ("checked", "selected", "value")
    out, depths = [], {}
    for n in root.walk():  # parents come first
        depths[id(n)] = depth = depths.get(id(n.parent), -1) + 1
        if n.name != "#comment":
            out.append(f"{depth}{n.name}" + "".join(f";{k}={v}" for k, v in sorted(n.attrs.items()) if k not in volatile))
    return "\n".join(out)


def table_signature(html: str | None) -> str:
    """Rows of cells with spans, of all tables."""
    return "/".join("|".join(",".join(f"{c.name}:{strict_span(c.attrs.get('rowspan'))}x{strict_span(c.attrs.get('colspan'))}" for c in row.direct("td", "th")) for row in direct_rows(t)) for t in parse(html).all("table"))


def leaf_cells(root: Node) -> list[Node]:
    return [n for n in root.all("td", "th") if not n.all("table")]


@lru_cache(maxsize=64)
def shared_strategy_cells(html: str | None, strategy: str, marker: str) -> tuple[tuple[int, int, Node], ...]:
    return tuple(strategy_cells_of(shared_tree(html), strategy, marker))


def stripped_markers(html: str | None) -> str:
    """Bracket markers of up to 120 characters on one line removed from text."""
    root = parse(html)
    for n in [root, *root.walk()]:
        n.children = [re.sub(r"\[[^\[\]\n]{1,120}\]", "", c) if isinstance(c, str) and n.name not in SILENT else c for c in n.children]
    return root.markup()


def restored_static(template: str, filled: str, output: str) -> str:
    """output, with every leaf cell that filling did not change put back as in the template."""
    trees = [parse(x) for x in (template, filled, output)]
    grids = [leaf_cells(t) for t in trees]
    if len({len(g) for g in grids}) == 1:
        for t, f, o in zip(*grids, strict=True):
            if _squeezed(t) == _squeezed(f) and t.markup(False).strip() == f.markup(False).strip():
                o.children = t.children
    return trees[2].markup()


def _squeezed(cell: Node) -> str:
    return re.sub(r"\s+", "", cell.text())


def static_changes(template: str, filled: str, output: str, most: int = 8) -> list[str]:
    """Texts of static cells that the output changed, the first few."""
    grids = [leaf_cells(parse(x)) for x in (template, filled, output)]
    if len({len(g) for g in grids}) != 1:
        return ["cell count differs"]
    changed = [t.text(" ", True) for t, f, o in zip(*grids, strict=True) if _squeezed(t) == _squeezed(f) and not t.all("input", "select", "textarea", "button") and _squeezed(o) != _squeezed(t)]
    return changed[:most]


def inputs_for_markers(html: str) -> str:
    """Each bracket marker becomes a named text input, or names the checkbox or
    radio right behind it; checked states go."""
    root = parse(html)
    for n in [root, *root.walk()]:
        n.attrs.pop("checked", None)
        if n.name in SILENT:
            continue
        out: list = []
        for k, c in enumerate(n.children):
            if not isinstance(c, str) or not BRACKET.search(c):
                out.append(c)
                continue
            after = next((x for x in n.children[k + 1 :] if isinstance(x, Node) or x.strip()), None)
            at = 0
            found = list(BRACKET.finditer(c))
            for m in found:
                out.append(c[at : m.start()])
                at = m.end()
                behind = m is found[-1] and not c[at:].strip() and isinstance(after, Node) and after.name == "input" and control_kind(after) in ("checkbox", "radio")
                if behind:
                    after.attrs |= {"name": m[1], "value": "placeholder"}
                else:
                    out.append(Node("input", {"type": "text", "name": m[1], "value": "placeholder"}, n))
            out.append(c[at:])
        n.children = [c for c in out if c != ""]
    return root.markup()


_TABLE_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.I | re.S)
_TABLE_CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)</t[dh]>", re.I | re.S)


def scanned_cells(html: str) -> dict[tuple[int, int], str]:
    """Cell texts by pattern alone: rows and cells in order, spans ignored."""
    return {(r, c): re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", " ", cell))).strip() for r, row in enumerate(_TABLE_ROW.findall(html)) for c, cell in enumerate(_TABLE_CELL.findall(row))}


def repaired_widths(table: Node) -> dict[str, int]:
    """Rows brought to the table's modal width: wider ones give up the columns
    of their widest spans, narrower ones stretch their last cell. The counts of
    repaired and of unresolved rows; spans change in place."""
    rows, widths = direct_rows(table), row_widths(table)
    target = modal_width(widths)
    for row, width in zip(rows, widths, strict=True):
        spare = sum(strict_span(c.attrs.get("colspan")) - 1 for c in row.direct("td", "th"))
        target = max(target, width - spare)
    out = {"target": target, "repaired": 0, "unresolved": 0}
    for row, width in zip(rows, widths, strict=True):
        cells_ = row.direct("td", "th")
        over = width - target
        if over == 0:
            continue
        while over > 0 and cells_:
            widest = max(cells_, key=lambda c: strict_span(c.attrs.get("colspan")))
            n = strict_span(widest.attrs.get("colspan"))
            if n == 1:
                break
            widest.attrs["colspan"] = str(max(1, n - over))
            over -= n - strict_span(widest.attrs["colspan"])
        if over < 0 and cells_:
            cells_[-1].attrs["colspan"] = str(strict_span(cells_[-1].attrs.get("colspan")) - over)
            over = 0
        out["unresolved" if over else "repaired"] += 1
    return out


def empty_cells(html: str | None) -> list[tuple[int, int, bool]]:
    """(row, column, empty) of each cell of all tables; a control is content."""
    return [(r, c, not n.text().strip() and not n.all("input", "select", "textarea", "img")) for (r, c), n in cells(html).items()]


def repaired_gold(html: str, reference: str, strategy: str = "analysis") -> str:
    """html, with a named input in each cell whose bracket in the reference has no input there."""
    names = {(r, c): BRACKET.findall(n.text()) for r, c, n in strategy_cells(reference, strategy, "bracket")}
    root = parse(html)
    base = 0
    for t in analysis_tables(root, _marker("input")) if strategy == "analysis" else leaf_tables(root, _marker("input")):
        rows = direct_rows(t)
        for (r, c), cell in origins(placed([row.direct("td", "th") for row in rows], 100)).items():
            have = [n.attrs.get("name") for n in cell.all("input")]
            for name in names.get((base + r, c), []):
                if name in have:
                    have.remove(name)
                else:
                    cell.children.append(Node("input", {"type": "text", "name": name, "value": "placeholder"}, cell))
        base += len(rows)
    return root.markup()
