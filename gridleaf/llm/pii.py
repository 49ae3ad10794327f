"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans are the valid matches of fixed patterns. The field adds spans: its
nodes are the base spans, whose labels are given, the document's other words
with digits or an at sign (six characters of value at least), and groups of
digits that together end like a base phone or card number. Neighbouring nodes
share a chain potential. Nodes of equal value, however far apart, share a skip
potential with the next of their kind and with the first one whose label is
given; numbers that share their last seven digits and addresses one edit apart
share a weaker one. Loopy belief propagation in the log domain runs until the
messages rest, so that a document's labels are consistent: a repeated number or
address is found where its form alone does not show it.

All weights are learnt together in numpy, by penalised pseudo-likelihood on a
bounded sample of nodes: those that the base patterns label, and words that are
none (words with letters and digits, and fixed forms of dates, times, versions
and counts). Each labelled node is shown with its form and once without, so
that the potentials must explain it too; what a form may say is bounded. Words that
have a base pattern's form but fail its test are no examples of none, but for
numbers of a card's length with a wrong check digit, most of which are no
cards; a right and a wrong one are features of the form.

Defined results: null texts are empty texts; empty texts have no spans; texts
without candidates have no field; very long texts are read whole; of overlapping
base spans the first is a node, and all are told; a tie of two labels adds no
span; rows are independent, so repeated rows repeat their result; empty tables
give empty results; other columns are ignored, whatever their names. Positions
are code points.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_ordered, map_batches, scratch, written

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_WORD_END = re.compile(r"\s|$")
_DIGITS = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]++")
_JOINT = re.compile(r"[\x20.()-]{0,3}")
#: Digits that similar numbers end in alike, most digits of a number, and characters of an address.
ENDING, MOST_DIGITS, ADDRESS = 7, 19, 254
#: Labelled nodes that the weights are learnt from at most, hash-ordered.
SAMPLE_ROWS = 20_000
#: A belief from which a label is told; messages rest below TOLERANCE, and after MOST_ROUNDS at the latest.
SURE, TOLERANCE, MOST_ROUNDS = 0.9, 1e-4, 400
#: What similar values share: one number ends the other, or else.
ENDS, ALIKE = 0, 1
#: Prior means of the agreement weights (equal, ends, alike), and prior variances of all weights and of those between neighbours.
PRIOR, VARIANCE, NEAR_VARIANCE = (7.0, 6.5, 3.0), 4.0, 0.25
#: What a free node's form may say for or against a label at most, in log-odds: the labels learnt from are those of forms.
FORM_BOUND = 2.5
#: Forms that are none of the kinds.
NONE_FORMS = ("20240131", "2024-01-31", "31.01.2024", "01/31/2024", "12:30:45", "2024-01-31T12:30:45", "1.2.3", "10.15.7", "v2.10.1", "123456", "1234567", "12345678", "123.456", "1,234,567", "99.95%", "3.14159265", "100000", "1_000_000", "R2D2C3P0", "a1b2c3d4", "123456789012345678901234", "0x7fff5694", "@username", "#123456")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from their at signs: a match holds
    one, so its local part is the run of allowed characters before it that no
    earlier match has taken."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > last and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the valid base matches, in the order of start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def value_of(span: str) -> str:
    """What equal values share: an address's letters and digits in lower case, or a number's digits."""
    if "@" in span:
        return re.sub(r"[^a-z0-9@]", "", span.lower())
    return "".join(c for c in span if "0" <= c <= "9")


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words with a digit or at sign that no base span touches, without punctuation at their ends."""
    out, at = [], 0
    taken = sorted((s, e) for s, _, e in base)
    k = 0
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _WORD_END.search(text, m.end()).start()
        at = end
        while start < end and not (text[start].isalnum() or text[start] in "+@("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end > start and not (k < len(taken) and taken[k][0] < end) and (len(value_of(text[start:end])) >= 6):
            out.append((start, end))
    return out


def regrouped(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Groups of digits, joined by spaces, dots, brackets or hyphens, that end
    like a phone or card number of the base and that no base span touches."""
    known = {value_of(text[s:e])[-ENDING:] for s, k, e in base if k >= 2}
    if not known:
        return []
    out, groups, k = [], [m.span() for m in _GROUP.finditer(text)], 0
    taken = sorted((s, e) for s, _, e in base)
    clear = []
    for s, e in groups:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        before = text[s - 1] if s else " "
        after = text[e] if e < len(text) else " "
        clear.append(not (k < len(taken) and taken[k][0] < e) and not (before.isalpha() or after.isalpha() or "@" in (before, after)))
    i = 0
    while i < len(groups):
        digits, best, j = "", None, i
        while j < len(groups) and clear[j] and len(digits) < MOST_DIGITS and (j == i or _JOINT.fullmatch(text, groups[j - 1][1], groups[j][0])):
            digits += text[slice(*groups[j])]
            if j > i and len(digits) <= MOST_DIGITS and digits[-ENDING:] in known:
                best = j
            j += 1
        if best is not None:
            start = groups[i][0]
            while start and text[start - 1] in "+(" and (start < 2 or not text[start - 2].isdigit()):
                start -= 1
            out.append((start, groups[best][1]))
            i = best
        i += 1
    return out


def form(span: str) -> np.ndarray:
    """Features of a node's form, scale-free."""
    n = len(span)
    digits = sum("0" <= c <= "9" for c in span)
    letters = sum(c.isalpha() for c in span)
    card = 12 <= digits <= 19 and bool(_CARD.fullmatch(span))
    right = card and luhn("".join(_DIGITS.findall(span)))
    return np.array([1.0, digits / n, letters / n, "@" in span, span.count(".") == 3, span.count("-") / n * 4, span.startswith("+"), "(" in span, digits in (15, 16), 9 <= digits <= 13, min(n, 40) / 40, digits > 19, right, card and not right])


def nodes_of(text: str) -> tuple[list[tuple[int, int, int | None]], list[tuple[int, int, int]]]:
    """Nodes (start, end, given label or None) in order, and the base spans."""
    base = base_spans(text)
    seen, given = 0, []
    for s, k, e in base:  # of overlapping base spans the first is a node
        if s >= seen:
            given.append((s, e, k + 1))
            seen = e
    joined, k = regrouped(text, base), 0
    free = []
    for s, e in candidates(text, base):
        while k < len(joined) and joined[k][1] <= s:
            k += 1
        if not (k < len(joined) and joined[k][0] < e):
            free.append((s, e))
    return sorted([*given, *((s, e, None) for s, e in [*free, *joined])], key=lambda x: x[:2]), base


def edges_of(text: str, nodes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chain edges (neighbours within 200 characters), skip edges of equal
    values (to the next, and to the first given one), and of similar values
    (numbers of which one ends the other; others of the same last digits and
    addresses one character apart), each as rows of two nodes."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= 200]
    values = [value_of(text[s:e]) for s, e, _ in nodes]
    last: dict[str, int] = {}
    known: dict[str, int] = {}
    for i, v in enumerate(values):
        if nodes[i][2] is not None:
            known.setdefault(v, i)
    equal = set()
    near: dict[str, tuple[int, str]] = {}
    found: dict[tuple[int, int], int] = {}
    for i, v in enumerate(values):
        if v in last:
            equal.add((last[v], i))
        if known.get(v, i) != i:
            equal.add((min(known[v], i), max(known[v], i)))
        last[v] = i
        if "@" in v:
            keys = {v, *(v[:k] + v[k + 1 :] for k in range(len(v)))} if len(v) <= ADDRESS else set()
        else:
            keys = {v[-ENDING:]} if len(v) >= ENDING else set()
        for key in keys:
            if key in near and near[key][1] != v:
                short, long = sorted((v, near[key][1]), key=len)
                found[near[key][0], i] = ENDS if "@" not in v and long.endswith(short) else ALIKE
            near[key] = (i, v)
    rows = lambda x: np.array(sorted(x), np.int64).reshape(-1, 2)
    return rows(chain), rows(equal), rows(k for k, w in found.items() if w == ENDS), rows(k for k, w in found.items() if w == ALIKE)


def lookalike(span: str) -> bool:
    """Whether a word has the form of a base pattern, though it fails its test.
    Numbers of a card's length that fail the card's are none: they are examples."""
    digits = sum("0" <= c <= "9" for c in span)
    return "@" in span or bool(_IP.fullmatch(span)) or (bool(_PHONE.fullmatch(span)) and digits >= 7)


N_FORM = 14
#: A row of an example: form, labels of the neighbours before and after (one-hot), and the numbers of equal, ending and alike nodes by label.
N_ROW = N_FORM + 5 * (2 + 3)


def examples(text: str) -> tuple[list[np.ndarray], list[int]]:
    """Rows of the nodes of a text whose labels are known, and the labels."""
    nodes, _ = nodes_of(text)
    if not nodes:
        return [], []
    edges = edges_of(text, nodes)
    labels = np.array([n[2] or 0 for n in nodes])
    context = np.zeros((len(nodes), 5, 5))
    named = {value_of(text[s:e]) for s, e, label in nodes if label}
    open_ = np.array([not label and (value_of(text[s:e]) in named or lookalike(text[s:e])) for s, e, label in nodes])
    for s_, e_, w in ((edges[2][:, 0], edges[2][:, 1], 3), (edges[3][:, 0], edges[3][:, 1], 4), (edges[1][:, 0], edges[1][:, 1], 2)):
        for a, b in ((s_, e_), (e_, s_)):
            a, b = a[labels[b] > 0], b[labels[b] > 0]
            np.add.at(context, (a, w, labels[b]), 1)
            open_[a[labels[a] == 0]] = True  # an unlabelled copy of a labelled value is no example of none
    for a, b in edges[0]:
        if not open_[a] and not open_[b]:
            context[a, 1, labels[b]] = context[b, 0, labels[a]] = 1
    keep = np.flatnonzero(~open_)
    return [np.concatenate([form(text[nodes[i][0] : nodes[i][1]]), context[i].ravel()]) for i in keep], labels[keep].tolist()


def learnt(rows: np.ndarray, labels: np.ndarray, steps: int = 25) -> dict:
    """Weights of the log-linear model p(label) ~ exp(form . w + near + agreement)
    by Newton's method on the penalised pseudo-likelihood."""
    made = np.array([np.concatenate([form(x), np.zeros(N_ROW - N_FORM)]) for x in NONE_FORMS])
    rows = np.concatenate([np.asarray(rows, float).reshape(-1, N_ROW), made])
    labels = np.concatenate([np.asarray(labels, int), np.zeros(len(made), int)])
    blind = rows[labels > 0].copy()
    blind[:, 1:N_FORM] = 0.0
    rows, labels = np.concatenate([rows, blind]), np.concatenate([labels, labels[labels > 0]])
    n = len(rows)
    seen = rows[:, N_FORM:].reshape(n, 5, 5)
    eye = np.eye(5)
    # phi[i, c]: features of row i under label c; near[x, y] is shared by both directions.
    form_part = np.einsum("if,cd->icfd", rows[:, :N_FORM], eye).reshape(n, 5, -1)
    near_part = np.einsum("ix,cd->icxd", seen[:, 0], eye) + np.einsum("iy,cd->icdy", seen[:, 1], eye)
    phi = np.concatenate([form_part, near_part.reshape(n, 5, -1), seen[:, 2:].transpose(0, 2, 1)], axis=2)
    mean = np.zeros(phi.shape[2])
    mean[-3:] = PRIOR
    theta, variance = mean.copy(), np.full(len(mean), VARIANCE)
    variance[N_FORM * 5 : -3] = NEAR_VARIANCE
    for _ in range(steps):
        z = phi @ theta
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        expected = np.einsum("ic,ick->ik", p, phi)
        slope = (phi[np.arange(n), labels] - expected).sum(axis=0) - (theta - mean) / variance
        flat = phi.reshape(-1, phi.shape[2])
        curve = (flat * p.reshape(-1, 1)).T @ flat - expected.T @ expected + np.diag(1 / variance)
        step = np.linalg.solve(curve, slope)
        theta += step * min(1.0, 5.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    equal, ends, alike = (max(0.0, float(x)) for x in theta[-3:])
    return {"w": theta[: N_FORM * 5].reshape(N_FORM, 5), "near": theta[N_FORM * 5 : -3].reshape(5, 5), "agree": (equal, ends, alike)}


def beliefs(unary: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Marginals by damped loopy belief propagation on edges (rows of two nodes,
    their potential), until the messages rest; exact where the graph has no loop."""
    n, labels = unary.shape
    kinds = []
    for at, pair in edges:
        if len(at):
            kinds.append((at[:, 0], at[:, 1], pair, np.zeros((len(at), labels)), np.zeros((len(at), labels))))
    total = unary.copy()
    for _ in range(MOST_ROUNDS if kinds else 0):
        total, moved, sent = unary.copy(), 0.0, []
        for i, j, _, to_j, to_i in kinds:
            np.add.at(total, j, to_j)
            np.add.at(total, i, to_i)
        for i, j, pair, to_j, to_i in kinds:
            a = _summed((total[i] - to_i)[:, :, None] + pair)
            b = _summed((total[j] - to_j)[:, :, None] + pair.T)
            moved = max(moved, float(np.abs(a - to_j).max()), float(np.abs(b - to_i).max()))
            sent.append((i, j, pair, (to_j + a) / 2, (to_i + b) / 2))
        kinds = sent
        if moved < TOLERANCE:
            break
    total = total - total.max(axis=1, keepdims=True) if n else total
    p = np.exp(total)
    return p / p.sum(axis=1, keepdims=True) if n else p


def _summed(z: np.ndarray) -> np.ndarray:
    """log-sum-exp over the second axis, its greatest value taken off."""
    top = z.max(axis=1, keepdims=True)
    out = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]
    return out - out.max(axis=1, keepdims=True)


def spans_of(text: str, model: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans, as (start, kind, end) in order."""
    nodes, base = nodes_of(text)
    free = [i for i, n in enumerate(nodes) if n[2] is None]
    if not free:
        return base, base
    unary = np.array([form(text[s:e]) for s, e, _ in nodes], float) @ model["w"]
    unary = np.clip(unary - unary[:, :1], -FORM_BOUND, FORM_BOUND)
    for i, (_, _, label) in enumerate(nodes):
        if label is not None:
            unary[i] = np.where(np.arange(5) == label, 0.0, -1e9)
    agree = [w * np.eye(5) for w in model["agree"]]
    p = beliefs(unary, list(zip(edges_of(text, nodes), [model["near"], *agree], strict=True)))
    more = [(nodes[i][0], int(p[i].argmax()) - 1, nodes[i][1]) for i in free if p[i].argmax() > 0 and p[i].max() >= SURE]
    return base, sorted([*base, *more])


def trained(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Weights from a bounded, hash-ordered sample of labelled nodes of all
    whole texts; only the nodes' numbers reach the driver."""
    some = docs.where(F.col("text").rlike("[0-9]{3}|@")).select("text")

    def make():
        def work(x):
            out = {"x": [], "y": []}
            for text in x["text"]:
                rows, labels = examples(text)
                out["x"] += [r.tolist() for r in rows]
                out["y"] += labels
            return out

        return work

    with scratch(docs.sparkSession):
        nodes = written(map_batches(some, "x array<double>, y int", make), "pii-nodes")
        rows = hash_ordered(nodes, sample_rows, "x", "y").toPandas()
    return learnt(np.array(rows["x"].tolist()), rows["y"].to_numpy())


def personal(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each row of docs."""
    given = docs.sparkSession.sparkContext.broadcast(model or trained(docs))

    def told(spans) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def make():
        def work(x):
            out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for text in x["text"]:
                base, found = spans_of(text or "", given.value)
                kinds = [k for _, k, _ in base]
                for k, c in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                    out[c].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
                out["spans"].append(told(found))
                out["n_added"].append(len(found) - len(base))
            return {"doc_id": x["doc_id"], **out}

        return work

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", make)
