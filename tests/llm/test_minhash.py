import random

import pytest
from helpers import awkward, clashing, empty, rows

from gridleaf.llm import minhash as m
from gridleaf.llm.common import WordHashes
from gridleaf.llm.queries import QUERIES


def brute(texts, width, percent=80):
    """component_id of each id, by comparing all pairs."""
    cache = WordHashes()
    sets = {i: set(m.shingles(t, width, cache).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def corpus(seed=1, groups=14):
    """Groups of edited copies, chains of edits, and documents that share a long passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts, n = {}, 0
    for g in range(groups):
        base = [word() for _ in range(rng.randrange(2, 120))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            if g % 3 == 0:
                base = w
            texts[n] = " ".join(w) + (" " + passage if g % 4 == 1 else "")
            n += 1
    for _ in range(40):
        texts[n] = passage + " " + " ".join(word() for _ in range(rng.randrange(10, 60)))
        n += 1
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, width):
    texts = corpus()
    got = rows(m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width))
    want, sizes = brute(texts, width)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == sizes[i] and r["kept"] == (want[i] == i) for i, r in got.items())


def test_prefix_filter_settles_crowds(spark, monkeypatch):
    monkeypatch.setattr(m, "LEADERS", 1)
    texts = corpus(2)
    got = rows(m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2))
    assert {i: r["component_id"] for i, r in got.items()} == brute(texts, 2)[0]


def test_awkward_rows(spark):
    found = m.near_duplicates(clashing(spark), 2).collect()
    assert len(found) == 9
    got = {r["doc_id"]: r for r in found}
    assert [got[i]["n_shingles"] for i in (1, 2, 3)] == [0, 0, 0] and all(got[i]["component_id"] == i and got[i]["kept"] for i in (1, 2, 3))
    assert got[5]["component_id"] == 4 and not got[5]["kept"]
    assert got[7]["n_shingles"] == 1


def test_empty_table(spark):
    assert m.near_duplicates(empty(spark)).count() == 0
    assert m.drop_near_duplicates(awkward(spark)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in m.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_query_against_all_pairs(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = rows(QUERIES["op1_minhash_near_dedup"](spark, data))
    assert {i: r["component_id"] for i, r in got.items()} == brute(texts, 2)[0]


def test_rows_that_repeat_an_id_keep_their_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "q w e r t y u"), (2, "a b c d e f g"), (3, "q w e r t y u"), (4, None), (5, ""), (None, "q w e r t y u"), (None, None), (7, "k l m n"), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in m.near_duplicates(docs, 2).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (None, 1, True), (None, None, True), (7, 7, True), (7, 1, False)], key=repr)
    left = {tuple(r) for r in m.drop_near_duplicates(docs, width=2).collect()}
    assert left == {(1, "a b c d e f"), (1, "q w e r t y u"), (4, None), (5, ""), (None, "q w e r t y u"), (None, None), (7, "k l m n")}
