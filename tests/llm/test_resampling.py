"""op12: against a plain computation, and its defined results."""

import hashlib
import math
import re
import zlib
from collections import Counter

import helpers
import oracle
import pytest

from gridleaf.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, target, orders, buckets, share, least):
    def features(text):
        w = WORD.findall(lower(text))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in s}
    out = []
    for i, x in docs:
        n, fs = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * share // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


DOCS = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 50)) + " Ünï straße") for i in range(300)] + [(None, "one two three " * 9), (301, None), (302, ""), (303, "--- ...")]
TARGET = ["w1 w2 w3 w4", "w1 W1 w1 one two", None, ""]


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_against_plain(spark, orders):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = resampling.resampled(docs, target, orders=orders, buckets=97, share=30, least=20)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(DOCS, TARGET, orders, 97, 30, 20)


def test_joined_gains_agree(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    target = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    a = sorted(map(tuple, resampling.resampled(docs, target).collect()), key=repr)
    monkeypatch.setattr(resampling, "BROADCAST_BUCKETS", 1)
    assert sorted(map(tuple, resampling.resampled(docs, target).collect()), key=repr) == a


def test_awkward_rows(spark):
    target = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    got = resampling.resampled(helpers.awkward(spark), target).collect()
    clash = resampling.resampled(helpers.clashing(spark), target)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, clash.collect()), key=repr)
    assert clash.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    by = helpers.rows(resampling.resampled(helpers.awkward(spark), target))
    assert [by[i].n_features for i in (1, 2, 3, 4, 7)] == [0, 0, 0, 30_001, 1] and by[1].weight == 0 and by[1]["rank"] is None
    assert len([r for r in got if r.doc_id == 6]) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(helpers.empty(spark), none).collect() == []
    assert resampling.resampled(helpers.awkward(spark), none).count() == 9


def test_query(spark, data):
    assert oracle.compare(queries.QUERIES["op12_importance_resampling"](spark, data), oracle.connect(data), resampling.ORACLE_SQL) == ""
