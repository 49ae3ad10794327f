"""op11: against all pairs, with crowded segments cut again, and its defined results."""

import itertools
import random

import helpers
import oracle
import pytest
from pyspark.sql import functions as F

from gridleaf.llm import queries, spelling


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def made(seed, n, letters="ab", lengths=(1, 9)):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(n)})


@pytest.mark.parametrize(("most", "letters", "lengths"), [(256, "abcé", (1, 6)), (2, "ab", (1, 9)), (1, "aé", (3, 8)), (4, "ab", (7, 10))])
def test_pairs_against_all(spark, most, letters, lengths):
    words = made(most, 250, letters, lengths)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(sorted((r.x, r.y))) for r in spelling.near_words(df, most).collect()]
    want = {(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_crowded_groups_are_cut(spark):
    """4,000 words that share their first half meet in groups of few rows."""
    rng = random.Random(3)
    words = sorted({"prefixes" + "".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(4000)} | {"prefixesabcdefgh", "prefixesabcdefgx", "prefixesabcdfgh"})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {tuple(sorted((r.x, r.y))) for r in spelling.near_words(df).collect()}
    keys = {}
    for w in words:
        for i in range(len(w)):
            keys.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    want = {tuple(sorted(p)) for g in keys.values() for p in itertools.combinations(g, 2)}
    want |= {tuple(sorted((a, w[:i] + w[i + 1 :]))) for w in words for a in [w] for i in range(len(w)) if w[:i] + w[i + 1 :] in set(words)}
    assert got == want and ("prefixesabcdefgh", "prefixesabcdefgx") in got


def test_forms_and_roots(spark):
    text = "spelling " * 200 + "spellings " * 15 + "spellingz " * 2 + "spellingzs " * 2 + "speling " * 2
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    words = spelling.vocabulary(df, damage=2**40)
    found = spelling.forms(words, spelling.near_words(words))
    by = {r.word: r for r in found.join(spelling.roots(found), "word", "left").withColumn("root", F.coalesce("root", "word")).collect()}
    assert {w: (r.form, r.root) for w, r in by.items()} == {
        "spelling": (None, "spelling"), "spellings": ("spelling", "spelling"), "spellingz": ("spelling", "spelling"), "spellingzs": (None, "spellingzs"), "speling": ("spelling", "spelling"),
    }
    assert by["spellingz"].n_near == 3 and by["spellings"].form_n == 200


def test_roots_follow_forms_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("w11", None)]
    df = spark.createDataFrame(chain, "word string, form string")
    assert {r.word: r.root for r in spelling.roots(df).collect()} == {f"w{i}": "w11" for i in range(11)}


def test_awkward_rows(spark):
    a = sorted(map(tuple, spelling.variants(helpers.awkward(spark)).collect()), key=repr)
    assert a == sorted(map(tuple, spelling.variants(helpers.clashing(spark)).collect()), key=repr)
    assert [r[0] for r in a] == ["epsilon"] and a[0][3] == 2
    long = spark.createDataFrame([(1, "x" * 40_000 + " " + "x" * 40_000 + " " + "x" * 40_001 + " " + "x" * 40_001), (None, None)], "doc_id long, text string")
    assert [r.n_near for r in spelling.variants(long).collect()] == [1, 1]
    assert spelling.variants(helpers.empty(spark)).collect() == []


def test_query(spark, data):
    assert oracle.compare(queries.QUERIES["op11_spelling_variants"](spark, data), oracle.connect(data), spelling.ORACLE_SQL) == ""
