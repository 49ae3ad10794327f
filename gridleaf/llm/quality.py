"""Quality classification with hierarchical empirical Bayes.

A logistic classifier on shape features of the whole text gives a document's
evidence. Grouped sums of it give posteriors of each level of its site (host,
then path below path), each shrunk toward the level above and the first toward
the global mean; how much a level shrinks comes from its own spread (moments),
so sparse sites stay near their parent. A document is left out of its own
site's sums, so that its evidence counts once; its posterior adds the log-odds
of its last level against the global ones to its own evidence.

site() takes URLs apart into a host and path levels; tables without URLs name
other columns as levels. Documents are scored once. Where the grouped sums fit
a stated bound of rows and bytes they are broadcast; beyond it they are joined
by key.

Defined results: null and empty texts have the features of no words and are
scored like any other; very long texts are read whole; a null level is a group
of its own; without labels every document's evidence is even and all are kept;
a tie at the threshold is kept; repeated rows each count and repeat their
result; empty tables give empty results; other columns are ignored, or kept by
the filter, whatever their names.
"""

from __future__ import annotations

import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_ordered, map_batches, unused, written

#: Labelled rows that the classifier is fitted on at most (hash-ordered, whole texts).
SAMPLE_ROWS = 6000
#: Groups that are broadcast at most, and characters of their names.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 20_000_000
THRESHOLD = 0.35
_MARKS = [b"!", b"|", b"$%&#*^~", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"<>{}[]=\\/", b".,;:?"]
_KIND = np.zeros((256, len(_MARKS)))
for _i, _m in enumerate(_MARKS):
    _KIND[list(_m), _i] = 1
N_FEATURES = len(_MARKS) + 6


def site(url: Column, depth: int = 2) -> list[Column]:
    """Levels of a URL: its host (lower case, without user, port and a leading
    www.), then the first 1 to depth path segments; a URL with fewer segments
    repeats its last level, and what is no URL has null levels."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(rest, r"^.*@|:[0-9]*$", "")), r"^www\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    known = F.when(host != "", host)
    return [known, *(F.when(known.isNotNull(), F.concat_ws("/", known, F.slice(parts, 1, k))) for k in range(1, depth + 1))]


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.split()
    n, w = max(1, len(raw)), max(1, len(words))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts @ _KIND / n
    repeats = sum(map(operator.eq, words, words[1:])) / w
    unique = len(set(words)) / w**0.8
    lines = raw.split(b"\n")
    again = 1 - len(set(lines)) / len(lines)
    return np.array([*np.log(shares + 1e-3), np.log(repeats + 1e-3), unique, np.log(n / w), np.log(n), np.log(again + 1e-2), n < 64])


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> dict:
    """Ridge logistic regression on standardised features and their squares, by Newton's method."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = _expanded((x - mean) / std)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a.T * (p * (1 - p))) @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "std": std, "w": w}


def _expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def evidence(model: dict | None, x: np.ndarray) -> np.ndarray:
    """Log-odds of good quality, kept inside (-8, 8)."""
    if model is None:
        return np.zeros(len(x))
    return np.clip(_expanded((x - model["mean"]) / model["std"]) @ model["w"], -8, 8)


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """A model from a bounded, hash-ordered sample of labelled rows, or None
    without two classes. Whole texts are read, and only features reach the driver."""
    some = labels.where("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") > 0).cast("double").alias("y"))
    some = hash_ordered(some, sample_rows, "doc_id", "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y")

    def make():
        return lambda x: {"x": [features(t) for t in x["text"]], "y": x["y"]}

    found = map_batches(rows, "x array<double>, y double", make).toPandas()
    if found["y"].nunique() < 2:
        return None
    x = np.array(found["x"].tolist())
    order = np.lexsort((*x.T, found["y"]))  # the fit does not depend on the order of arrival
    return fitted(x[order], found["y"].to_numpy()[order])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _chance(e: Column) -> Column:
    return 1 / (1 + F.exp(-e))


def scored(docs: DataFrame, model: dict | None, columns: list[str], score: str) -> DataFrame:
    """The columns and each row's evidence, under the name score."""
    kinds = dict(docs.dtypes)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(x):
            rows = np.array([features(t) for t in x["text"]]).reshape(-1, N_FEATURES)
            return {**{c: x[c] for c in columns}, score: evidence(given.value, rows)}

        return work

    read = columns if "text" in columns else [*columns, "text"]
    return map_batches(docs.select(*read), ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{score}` double"]), make)


def sums(scores: DataFrame, levels: list[str], score: str) -> DataFrame:
    """One row for each group of the last level: its levels as l0, l1, ..., and
    for each level the rows n0, n1, ... and summed chances s0, s1, ..."""
    keys = [f"l{i}" for i in range(len(levels))]
    named = scores.select(*(F.col(c).alias(k) for c, k in zip(levels, keys, strict=True)), _chance(F.col(score)).alias("p"))
    last = len(levels) - 1
    found = named.groupBy(*keys).agg(F.count("*").alias(f"n{last}"), F.sum("p").alias(f"s{last}"))
    for i in range(last - 1, -1, -1):
        up = found.groupBy(*keys[: i + 1]).agg(F.sum(f"n{last}").alias(f"n{i}"), F.sum(f"s{last}").alias(f"s{i}"))
        up = up.withColumnsRenamed({k: f"up_{k}" for k in keys[: i + 1]})
        met = [found[k].eqNullSafe(up[f"up_{k}"]) for k in keys[: i + 1]]
        found = found.join(up, met).drop(*(f"up_{k}" for k in keys[: i + 1]))
    return found


def weights(found: DataFrame, depth: int) -> tuple[float, list[float]]:
    """The global mean, and for each level the weight of its parent in
    pseudo-counts: within variance over between variance, between 1 and 1000."""
    total = found.agg(F.sum(f"s{depth - 1}") / F.sum(f"n{depth - 1}")).first()[0]
    if total is None:
        return 0.5, [1.0] * depth
    top, out = min(max(total, 1e-9), 1 - 1e-9), []
    for i in range(depth):
        # A group of level i once, with its parent's shrunken mean.
        groups = found.dropDuplicates([f"l{j}" for j in range(i + 1)])
        n, mean = F.col(f"n{i}"), F.col(f"s{i}") / F.col(f"n{i}")
        parent = shrunk(F.lit(top), out, i)
        within = F.avg(parent * (1 - parent))
        between = F.sum(n * (mean - parent) * (mean - parent)) / F.sum(n) - F.count("*") * within / F.sum(n)
        k = groups.agg(within / F.greatest(between, F.lit(1e-6))).first()[0]
        out.append(1.0 if k is None else float(min(1000.0, max(1.0, k))))
    return top, out


def shrunk(top: Column, given: list[float], depth: int, less: Column | None = None) -> Column:
    """The shrunken mean of the level before depth; less, a row's own chance, is left out of all sums."""
    p = top
    for i in range(depth):
        s, n = F.col(f"s{i}"), F.col(f"n{i}")
        if less is not None:
            s, n = F.greatest(s - less, F.lit(0.0)), n - 1
        p = (s + given[i] * p) / (n + given[i])
    return p


def _with_posterior(scores: DataFrame, levels: list[str], score: str, threshold: float) -> tuple[DataFrame, dict[str, Column]]:
    """scores with the sums of their groups, and the output columns."""
    found = written(sums(scores, levels, score), "quality-sums")
    top, given = weights(found, len(levels))
    n, chars = found.agg(F.count("*"), F.sum(sum((F.coalesce(F.char_length(F.col(f"l{i}").cast("string")), F.lit(0)) for i in range(len(levels))), F.lit(0)))).first()
    side = F.broadcast(found) if n <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS else found
    # Input columns may have any names; inside, theirs are numbered.
    inner = scores.select(*(F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(scores.columns)))
    at = {c: f"in{i}" for i, c in enumerate(scores.columns)}
    joined = inner.join(side, [F.col(at[c]).eqNullSafe(F.col(f"l{i}")) for i, c in enumerate(levels)])
    e = F.col(at[score])
    p = _chance(e)
    path = shrunk(F.lit(top), given, len(levels), p)
    posterior = _chance(e + _logit(path) - _logit(F.lit(top)))
    columns = {c: F.col(v).alias(c) for c, v in at.items()}
    out = {"p_doc": p.alias("p_doc"), "p_host": shrunk(F.lit(top), given, 1, p).alias("p_host"), "p_path": path.alias("p_path"), "posterior": posterior.alias("posterior"), "kept": (posterior >= threshold).alias("kept")}
    return joined, columns | {f"/{k}": v for k, v in out.items()}


def _scored_once(docs: DataFrame, labels: DataFrame, levels: list[Column], keep: list[str]) -> tuple[DataFrame, list[str], str]:
    *names, score = unused(docs, *(f"__l{i}" for i in range(len(levels))), "__e")
    sites = docs.select("*", *(x.alias(n) for x, n in zip(levels, names, strict=True)))
    return written(scored(sites, trained(docs, labels), [*keep, *names], score), "quality-scores"), names, score


def judged(docs: DataFrame, labels: DataFrame, levels: list[Column], keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns keep, then p_doc, p_host, p_path (both without the row
    itself), posterior and kept, for each row of docs. levels are the site's
    levels from the host on; a group of one is a group inside those before."""
    scores, names, score = _scored_once(docs, labels, levels, keep)
    joined, columns = _with_posterior(scores, names, score, threshold)
    return joined.select(*(columns[c] for c in keep), *(v for k, v in columns.items() if k.startswith("/")))


def reject(docs: DataFrame, labels: DataFrame, levels: list[Column], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns."""
    scores, names, score = _scored_once(docs, labels, levels, docs.columns)
    joined, columns = _with_posterior(scores, names, score, threshold)
    return joined.where(columns["/kept"]).select(*(columns[c] for c in docs.columns))
