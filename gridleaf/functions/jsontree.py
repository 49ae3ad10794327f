"""JSON documents as labelled trees: extraction, repair status, distance. Plain Python."""

from __future__ import annotations

import json
import re
from collections import Counter

from .text import KEY_PUNCTUATION

_DROP = re.compile(rf"[\s{KEY_PUNCTUATION}]")


def first_json(text):
    """The first JSON value in a text, or what remains of the text where there is none."""
    if not isinstance(text, str):
        return text
    body = text.strip()
    body = re.sub(r"^```(?:json)?\s*", "", body, flags=re.I)
    body = re.sub(r"\s*```$", "", body)
    try:
        return json.loads(body)
    except ValueError:
        pass
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return body
    stack, quoted, escaped = [], False, False
    for i in range(start, len(body)):
        c = body[i]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not quoted and c in "}]":
            if not stack or stack.pop() != c:
                break
            if not stack:
                try:
                    return json.loads(body[start : i + 1])
                except ValueError:
                    break
    return body[start:]


#: States of a document that can be used.
USABLE = {"ok", "repaired"}
_TOKEN = re.compile(r'\s+|[{}\[\]:,]|"(?:[^"\\]|\\.)*"?|\'(?:[^\'\\]|\\.)*\'?|//[^\n]*|/\*.*?(?:\*/|$)|[^\s{}\[\]:,"\']+', re.S)
_WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None, "nan": None}


def repaired(text: str):
    """The document that a broken JSON text shows: brackets and strings that do
    not end are ended, missing and spare commas, quotes and comments are forgiven.
    None where the text shows no object or array."""
    tokens = [t for t in _TOKEN.findall(text) if t.strip() and not t.startswith(("//", "/*"))]
    if not tokens or tokens[0] not in "{[":
        return None
    return _value(tokens, 0)[0]


def _scalar(token: str):
    if token[0] in "\"'":
        body = token[1:-1] if len(token) > 1 and token[-1] == token[0] and not token.endswith("\\" + token[0]) else token[1:]
        try:
            return json.loads('"' + body.replace("\n", "\\n").replace("\t", "\\t").replace('\\"', '"').replace('"', '\\"').replace("\\'", "'") + '"')
        except ValueError:
            return body
    if token.lower() in _WORDS:
        return _WORDS[token.lower()]
    try:
        return json.loads(token)
    except ValueError:
        return token


def _value(tokens: list[str], at: int):
    """The value that starts at a token, and the place behind it. Depth is kept
    on a list, so deep texts need no deep calls."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    waits = [False]  # whether an object has a key without its value

    def put(v) -> None:
        top = stack[-1]
        if isinstance(top, list):
            top.append(v)
        elif waits[-1]:
            top[keys[-1]] = v
            waits[-1] = False
        elif not isinstance(v, (dict, list)):
            keys[-1], waits[-1] = str(v), True  # a key without a value is dropped

    while at < len(tokens):
        t = tokens[at]
        at += 1
        if t in "{[":
            new: dict | list = {} if t == "{" else []
            put(new)
            stack.append(new)
            keys.append(None)
            waits.append(False)
        elif t in "}]":
            if len(stack) > 1:
                stack.pop()
                keys.pop()
                waits.pop()
            if len(stack) == 1:
                break
        elif t == ",":
            waits[-1] = False
        elif t != ":":
            words = [t]
            while at < len(tokens) and tokens[at] not in "{}[]:," and t[0] not in "\"'" and tokens[at][0] not in "\"'":
                words.append(tokens[at])
                at += 1
            put(_scalar(" ".join(words)))
    return (root[0] if root else None), at


def lenient(value) -> tuple[object, str]:
    """(document, status): ok, repaired, empty, non_string or unrepairable."""
    if value is None or isinstance(value, str) and not value.strip():
        return None, "empty"
    found = first_json(value) if isinstance(value, str) else value
    if found is None:
        return None, "empty"
    if isinstance(found, str):
        try:
            found = json.loads(found)
        except ValueError:
            found = repaired(found)
            return (found, "repaired") if found else (None, "unrepairable")
        if found is None:
            return None, "empty"
    if isinstance(found, (dict, list)):
        return found, "ok"
    return found, "non_string"


def object_only(value, side: str) -> tuple[dict | None, str]:
    """As lenient, anything but an object being a status of its own."""
    found, status = lenient(value)
    if found is not None and not isinstance(found, dict):
        return None, f"{side}_non_dict:{type(found).__name__}"
    return found, status


def normalised(x):
    """Keys and strings without white space and colon-like marks; of keys that meet, the last wins."""
    if isinstance(x, dict):
        return {_DROP.sub("", str(k)): normalised(v) for k, v in x.items()}
    if isinstance(x, list):
        return [normalised(v) for v in x]
    return _DROP.sub("", x) if isinstance(x, str) else x


class Tree:
    """Nodes in pre-order: labels, sizes of subtrees, children."""

    __slots__ = ("children", "labels", "parents", "sizes")

    def __init__(self, value):
        self.labels: list[str] = []
        self.children: list[list[int]] = []
        self.parents: list[int] = []
        stack = [(value, -1, False)]
        while stack:
            x, up, is_key = stack.pop()
            me = len(self.labels)
            self.parents.append(up)
            self.children.append([])
            if up >= 0:
                self.children[up].append(me)
            if is_key:
                key, inner = x
                self.labels.append(f'"{key}":')
                stack.append((inner, me, False))
            elif isinstance(x, dict):
                self.labels.append("{}")
                stack.extend(((k, x[k]), me, True) for k in sorted(x, reverse=True))
            elif isinstance(x, list):
                self.labels.append("[]")
                stack.extend((v, me, False) for v in reversed(x))
            elif isinstance(x, str):
                self.labels.append('"' + re.sub(r"\s+", "", x) + '"')
            else:
                self.labels.append("null" if x is None else str(x))
        self.sizes = [1] * len(self.labels)
        for i in range(len(self.labels) - 1, 0, -1):
            self.sizes[self.parents[i]] += self.sizes[i]


def edit_distance(a: Tree, b: Tree) -> int:
    """Relabelling costs 1, inserting or deleting a subtree its size; children
    keep their order. Pairs of equal depth are solved from the leaves up, so
    nothing recurses."""
    memo: dict[tuple[int, int], int] = {}
    todo = [(0, 0)]
    while todo:
        i, j = todo[-1]
        if (i, j) in memo:
            todo.pop()
            continue
        ca, cb = a.children[i], b.children[j]
        missing = [(x, y) for x in ca for y in cb if (x, y) not in memo]
        if missing:
            todo.extend(missing)
            continue
        row = [0]
        for y in cb:
            row.append(row[-1] + b.sizes[y])
        for x in ca:
            new = [row[0] + a.sizes[x]]
            for k, y in enumerate(cb):
                new.append(min(row[k + 1] + a.sizes[x], new[k] + b.sizes[y], row[k] + memo[x, y]))
            row = new
        memo[i, j] = (a.labels[i] != b.labels[j]) + row[-1]
        todo.pop()
    return memo[0, 0]


def label_distance(a: Tree, b: Tree) -> int:
    """Differences of label counts, and one for unequal roots."""
    x, y = Counter(a.labels), Counter(b.labels)
    return sum(abs(x[k] - y[k]) for k in {*x, *y}) + (a.labels[0] != b.labels[0])


def similarity(pred, gold, mode: str = "py_tree") -> float:
    """1 less the distance over the sum of sizes, kept in [0, 1]."""
    a, b = Tree(normalised(pred)), Tree(normalised(gold))
    d = (edit_distance if mode == "py_tree" else label_distance)(a, b)
    return max(0.0, min(1.0, 1 - d / (a.sizes[0] + b.sizes[0])))


def brackets(tree: Tree, i: int = 0) -> str:
    """The tree in bracket form for external tools; braces in labels are escaped."""
    out, stack = [], [i]
    while stack:
        n = stack.pop()
        if n < 0:
            out.append("}")
            continue
        out.append("{" + re.sub(r"([{}\\])", r"\\\1", tree.labels[n]))
        stack.append(-1)
        stack.extend(reversed(tree.children[n]))
    return "".join(out)


def candidates(text: str) -> list:
    """The values a response may stand for: the whole, fenced parts, the outer object or list."""
    parts = [text.strip(), *re.findall(r"```(?:json)?\s*(.*?)```", text, flags=re.S | re.I)]
    for a, b in ("{}", "[]"):
        if 0 <= text.find(a) < text.rfind(b):
            parts.append(text[text.find(a) : text.rfind(b) + 1])
    out = []
    for p in parts:
        try:
            out.append(json.loads(p))
        except ValueError:
            continue
    return out


def conforms(template, output, path: str = "$", key: str = "") -> tuple[bool, str]:
    """Whether an output has its template's structure; lists of scalars under
    the key value may have any length, other lists must keep theirs."""
    todo = [(template, output, path, key)]
    while todo:
        t, o, at, k = todo.pop()
        if isinstance(t, dict):
            if not isinstance(o, dict):
                return False, f"{at}: not an object"
            if set(t) != set(o):
                return False, f"{at}: keys differ"
            todo.extend((t[x], o[x], f"{at}.{x}", x) for x in t)
        elif isinstance(t, list):
            if not isinstance(o, list):
                return False, f"{at}: not a list"
            scalar = lambda xs: not any(isinstance(v, (dict, list)) for v in xs)
            if k == "value" and scalar(t) and scalar(o):
                continue
            if len(t) != len(o):
                return False, f"{at}: length differs"
            todo.extend((x, y, f"{at}[{i}]", "") for i, (x, y) in enumerate(zip(t, o, strict=True)))
        elif isinstance(o, (dict, list)):
            return False, f"{at}: not a scalar"
    return True, ""


def flattened(items) -> list:
    out, stack = [], [items]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        else:
            out.append(x)
    return out


def expected_of(meta) -> list[dict]:
    """Expected placeholders of a meta document, in file and offset order."""
    if isinstance(meta, dict):
        meta = meta.get("structured_analysis", [])
    out = []
    for item in flattened(meta):
        if not isinstance(item, dict):
            continue
        key = item.get("key") or item.get("display_key") or item.get("parent_key") or ""
        label = item.get("label_info") or {}
        offsets = item.get("placeholder_offset", item.get("placeholder_offsets"))
        offsets = offsets if isinstance(offsets, list) else [offsets]
        row, col = _int(label.get("row")), _int(label.get("col"))
        if item.get("type") not in ("LI", "GI", "SI", "GO", "SO") or row < 0 or col < 0:
            continue
        for o in offsets:
            if isinstance(o, dict):
                dr, dc = _int(o.get("rows"), 0), _int(o.get("cols"), 0)
                out.append({"key": str(key), "name": str(key), "type": item["type"], "row": row + dr, "col": col + dc, "dr": dr, "dc": dc})
    return out


def _int(x, default: int = -1) -> int:
    try:
        return int(x)
    except (TypeError, ValueError):
        return default
