"""Distributed orders: numbers, thresholds, greedy shards, all against plain Python."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridleaf.operators import jobs as J
from gridleaf.operators import shards
from gridleaf.operators.ordered import numbered, smallest
from gridleaf.operators.shards import sharded


def plan(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain("formatted")
    return said.getvalue()


def greedy(sizes, budget, shard=0, fill=0):
    out = []
    for n in sizes:
        if fill and fill + n > budget:
            shard, fill = shard + 1, 0
        fill += n
        out.append(shard)
    return out, shard, fill


@pytest.mark.parametrize("seed", range(40))
def test_maps_of_ranges(seed):
    rng = random.Random(seed)
    budget = rng.choice([5, 10, 50])
    draw = lambda n: [rng.choice([0, 0, 1, 2, 3, budget - 1, budget, budget + 4, rng.randint(0, budget)]) for _ in range(n)]
    a, b = draw(rng.randint(1, 30)), draw(rng.randint(1, 30))
    ma, mb = (shards.summary(np.array(x), budget) for x in (a, b))
    both = shards.composed(ma, mb)
    for fill in range(0, 2 * budget + 6):
        assert shards.applied(ma, 7, fill) == greedy(a, budget, 7, fill)[1:], (a, fill)
        assert shards.applied(both, 7, fill) == greedy(a + b, budget, 7, fill)[1:], (a, b, fill)
        assert shards.placed(np.array(a), np.array([0]), budget, 7, fill).tolist() == greedy(a, budget, 7, fill)[0]
    assert len(both[0]) <= len(ma[0]) + len(mb[0])


@pytest.mark.parametrize(("n", "range_rows", "fan"), [(3000, 50, 4), (500, 7, 2), (200, 1000, 32)])
def test_one_group_on_many_tasks(spark, monkeypatch, n, range_rows, fan):
    monkeypatch.setattr(shards, "FAN", fan)
    rng = random.Random(n)
    sizes = [rng.choice([0, 1, 3, 9, 40, 120]) for _ in range(n)]
    df = spark.createDataFrame([(i, s, "x" * (i % 5)) for i, s in enumerate(sizes)], "i int, n int, shard_of string").repartition(5)
    got = sharded(df, [], "i", "n", 100, range_rows).orderBy("i").collect()
    assert [r.shard for r in got] == greedy(sizes, 100)[0] and got[0].shard_of == ""


def test_groups_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(shards, "FAN", 3)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "b", "b", None, "c"]), i, rng.choice([None, 2, 30, 70, 101])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    got = {(r.g, r.i): r.shard for r in sharded(df, ["g"], "i", "n", 100, 40).collect()}
    for g in ("a", "b", "c", None):
        mine = [r for r in rows if r[0] == g]
        assert [got[r[:2]] for r in mine] == greedy([r[2] or 0 for r in mine], 100)[0]
    assert sharded(df.limit(0), ["g"], "i", "n", 100).collect() == []


def test_numbers_of_one_value_are_dealt_evenly(spark):
    df = spark.range(4000).select(F.lit(1).alias("v"), F.col("id"))
    out = numbered(df, [F.col("v")], ranges=8, number="part")
    assert sorted(r.place for r in out.collect()) == list(range(1, 4001))
    sizes = [r["count"] for r in out.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    odd = numbered(df, [F.col("id").desc()]).where("place <= 3").orderBy("place").collect()
    assert [r.id for r in odd] == [3999, 3998, 3997]


def test_smallest(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 5, 2**60 - 1, rng.randrange(2**60)]), rng.randrange(2**60)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    for k in (1, 2, 77, 150, 299, 300):
        assert smallest(df, ["a", "b"], k) == list(sorted(rows)[k - 1])


def test_split_sorts_nothing(spark):
    ids = spark.range(1000).withColumnRenamed("id", "sample_id")
    out = J.split(ids.union(ids))
    assert "TakeOrdered" not in plan(out) and "Sort" not in plan(out)
    assert {r.split: r.n for r in out.groupBy("split").agg(F.count_distinct("sample_id").alias("n")).collect()} == {"test": 200, "train": 800}
    assert {r.split for r in J.split(ids.limit(1)).collect()} == {"test"} and J.split(ids.limit(0)).collect() == []
    assert J.split(spark.createDataFrame([(None,), (1,)], "sample_id long")).where("sample_id IS NULL").first().split == "train"


def test_labels_in_texts_by_both_ways(spark):
    from gridleaf.operators import ordered

    rng = random.Random(8)
    letters = "abé🙂 "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    cells = [(i, f"k{i % 7}", word(rng.randint(0, 40))) for i in range(300)] + [(300, None, None), (301, "k", "")]
    labels = [word(rng.randint(0, 5)) for _ in range(60)] + [None, "", "ab"]
    df = spark.createDataFrame(cells, "i int, k string, text string")
    names = spark.createDataFrame([(x,) for x in labels], "name string")
    want = sorted((i, k, x) for i, k, t in cells for x in {x for x in labels if x} if t and x in t)
    for bound in (1 << 20, 0):
        assert sorted(map(tuple, ordered.containing(df, names, ["i", "k"], "text", "name", bound).collect())) == want
    assert ordered.containing(df, names.limit(0), ["i"], "text", "name").collect() == []
    assert "Exchange" not in plan(ordered.containing(df, names, ["i"], "text", "name"))
