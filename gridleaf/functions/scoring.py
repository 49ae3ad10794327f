"""Scoring of one document's prediction against its gold; plain Python."""

from __future__ import annotations

import re
import unicodedata

from functools import lru_cache

from . import dom
from .text import PUNCTUATION, infill_value


def plain(text: str | None) -> str:
    """Label text: lower case, no white space, no punctuation."""
    if text and text.isascii():
        return infill_value(text)
    return "".join(c for c in (text or "").lower() if not c.isspace() and c not in PUNCTUATION)


def field(text: str | None) -> str:
    out = plain(text).replace("·", "")
    return re.sub(r"\d+$", "", re.sub(r"^\d+", "", out)).strip()


def alike(a: str, b: str) -> bool:
    x, y = field(a), field(b)
    return bool(x and y) and (x in y or y in x)


# Infill


def legacy(pred: str | None, gold: str | None, blank: str | None) -> list[dict]:
    """First table only; a target for each placeholder slot, the first of a slot kept."""
    golds, preds = dom.shared_cells(gold, "first_table"), dom.shared_cells(pred, "first_table")
    out = []
    for r, c, k in dict.fromkeys(legacy_slots(blank)):
        want, got = (plain(grid[r, c].text(" ", True)) if (r, c) in grid else "" for grid in (golds, preds))
        if not want:
            continue
        kind = "exact" if got == want else "gold_in_prediction" if want in got else "prediction_in_gold" if got and got in want else "mismatch"
        out.append({"row": r, "col": c, "kind": kind, "correct": kind != "mismatch", "idx": k, "want": want, "got": got})
    return out


@lru_cache(maxsize=64)
def legacy_slots(blank: str | None) -> list[tuple[int, int, int]]:
    """(row, column, index among equal names of the cell) of each placeholder of the first table."""
    out = []
    for (r, c), cell in dom.shared_cells(blank, "first_table").items():
        counts: dict[str, int] = {}
        for name in dom.BRACKET.findall(cell.text(" ", True)):
            k = counts.get(plain(name), 0)
            counts[plain(name)] = k + 1
            out.append((r, c, k))
    return out


@lru_cache(maxsize=64)
def _asked(blank: str | None, layout: str) -> list[tuple]:
    """Of each marked cell of a form: place, marks, static text, and the numbers of the controls that count."""
    out = []
    for at, cell in dom.shared_cells(blank, layout).items():
        marks = len(dom.BRACKET.findall(cell.markup()))
        if not marks:
            continue
        text = cell.text(" ", True)
        in_text = bool(dom.BRACKET.search(text))
        count = [i for i, control in enumerate(dom.controls(cell)) if dom.marked(control) or in_text and dom.control_kind(control) in ("checkbox", "radio", "select")]
        out.append((at, marks, infill_value(dom.BRACKET.sub("", text)), count))
    return out


def source_faithful(pred: str | None, gold: str | None, blank: str | None, layout: str) -> list[dict]:
    """One target for each marked cell that the gold document shows a change in:
    its text if that differs from the static text, and its controls."""
    golds, preds = dom.shared_cells(gold, layout), dom.shared_cells(pred, layout)
    out = []
    for at, marks, static, count in _asked(blank, layout):
        if at not in golds:
            continue
        want_raw = golds[at].text(" ", True)
        want = infill_value(want_raw)
        needs_text = bool(want) and want != static
        wanted = {}
        if count:
            gold_controls = dom.controls(golds[at])
            wanted = {i: (dom.control_kind(gold_controls[i]), dom.control_value(gold_controls[i])) for i in count if i < len(gold_controls)}
        if not needs_text and not wanted:
            continue
        got_raw = preds[at].text(" ", True) if at in preds else ""
        got = infill_value(got_raw)
        kind = "not_required" if not needs_text else "exact" if got == want else "empty_prediction" if not got else "mismatch"
        pred_controls = dom.controls(preds[at]) if wanted and at in preds else []
        same = all(i < len(pred_controls) and (dom.control_kind(pred_controls[i]), dom.control_value(pred_controls[i])) == v for i, v in wanted.items())
        correct = kind in ("exact", "not_required") and same
        out.append({"row": at[0], "col": at[1], "kind": kind if same else "control_mismatch", "correct": correct, "markers": marks, "text": needs_text, "controls": len(wanted), "want_raw": want_raw, "got_raw": got_raw})
    return out


def content_words(text: str) -> list[str]:
    return re.findall(r"[\w%$€£¥]+|[\u3400-\u9fff]", unicodedata.normalize("NFKC", text or "").casefold())


def reordered(target: dict) -> bool:
    """Whether a wrong text has the gold text's words in another order."""
    if target["correct"] or not target["text"]:
        return False
    want, got = content_words(target["want_raw"]), content_words(target["got_raw"])
    return len(want) >= 2 and want != got and sorted(want) == sorted(got)


MATCHERS = {
    "legacy_v1": legacy,
    "source_faithful_v2": lambda p, g, b: source_faithful(p, g, b, "first_table"),
    "source_faithful_v3": lambda p, g, b: source_faithful(p, g, b, "all_logical_regions"),
}


def infill(pred: str | None, gold: str | None, blank: str | None, matcher: str = "source_faithful_v3") -> tuple[int, int]:
    found = MATCHERS[matcher](pred, gold, blank)
    return sum(t["correct"] for t in found), len(found)


# Alignment

STRATEGIES = ("analysis", "leaf", "recursive")


@lru_cache(maxsize=64)
def brackets_at(html: str | None, strategy: str) -> dict[tuple[int, int], list[str]]:
    out: dict[tuple[int, int], list[str]] = {}
    for r, c, cell in dom.shared_strategy_cells(html, strategy, "bracket"):
        names = dom.BRACKET.findall(cell.text())
        if names:
            out.setdefault((r, c), []).extend(names)
    return out


def inputs_at(html: str | None, strategy: str) -> tuple[dict[tuple[int, int], list[str]], list[tuple[int, int, str]]]:
    """Named inputs by cell, and each coordinate's first text in cell order."""
    names: dict[tuple[int, int], list[str]] = {}
    texts: dict[tuple[int, int], str] = {}
    for r, c, cell in dom.shared_strategy_cells(html, strategy, "input"):
        found = [n.attrs["name"] for n in cell.all("input") if n.attrs.get("name")]
        if found:
            names.setdefault((r, c), []).extend(found)
        texts.setdefault((r, c), cell.text(" ", True))
    return names, [(r, c, t) for (r, c), t in texts.items()]


def _take(at: tuple[int, int], name: str, have: dict, used: set) -> bool:
    for k, other in enumerate(have.get(at, ())):
        if (at, k) not in used and alike(name, other):
            used.add((at, k))
            return True
    return False


def best_strategy(gold: str | None, expected: list[dict]) -> str:
    """The strategy that places most expected brackets, the first of ties."""
    scores = []
    for s in STRATEGIES:
        have, used = brackets_at(gold, s), set()
        scores.append(sum(_take((e["row"], e["col"]), e["key"], have, used) for e in expected))
        if scores[-1] == len(expected):
            return s
    return STRATEGIES[scores.index(max(scores))]


def gold_names(gold: str | None, expected: list[dict], strategy: str) -> list[dict]:
    """Expected items under the names of their gold brackets."""
    have, used, out = brackets_at(gold, strategy), set(), []
    for e in expected:
        at = (e["row"], e["col"])
        free = [k for k in range(len(have.get(at, ()))) if (at, k) not in used]
        pick = next((k for k in free if alike(e["key"], have[at][k])), free[0] if free else None)
        if pick is not None:
            used.add((at, pick))
        out.append({**e, "name": have[at][pick] if pick is not None else e["name"]})
    return out


def alignment(pred: str | None, gold: str | None, expected: list[dict]) -> tuple[str, list[tuple[str, bool]]]:
    """(strategy, [(field type, correct)]): each expected item takes an unused
    matching input of its cell, else one at its offset from any cell whose text
    holds its key."""
    strategy = best_strategy(gold, expected)
    have, texts = inputs_at(pred, strategy)
    used: set = set()
    out = []
    for e in gold_names(gold, expected, strategy):
        ok = _take((e["row"], e["col"]), e["name"], have, used)
        key = field(e["key"])
        if not ok and key:
            for r, c, text in texts:
                if key in field(text) and _take((r + e["dr"], c + e["dc"]), e["name"], have, used):
                    ok = True
                    break
        out.append((e["type"], ok))
    return strategy, out
