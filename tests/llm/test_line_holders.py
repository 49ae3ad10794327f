"""op7: documents are counted, not rows."""

import pytest

from gridleaf.llm import lines

LINE = "the quick brown fox jumps over the dog"
OWN = "{0}one {0}two {0}three {0}four {0}five {0}six {0}seven"


def left(spark, rows, **options):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in lines.dedup_lines(df, **options).collect())


def kept(rows):
    return sorted((i is not None, i or 0, t) for i, t in rows)


def text(word):
    return f"{OWN.format(word)}\n{LINE}"


@pytest.mark.parametrize("rows", [
    [(1, text("alpha")), (1, text("beta")), (2, text("gamma"))],
    [(1, text("alpha")), (None, text("beta")), (2, text("gamma"))],
    [(None, text("alpha")), (None, text("beta")), (None, text("gamma"))],
    [(1, text("alpha")), (1, text("alpha")), (1, text("alpha")), (2, text("gamma"))],
])
def test_two_holders_are_not_three(spark, rows):
    assert left(spark, rows) == kept(rows)


def test_three_holders_drop_in_every_row_of_later_ids(spark):
    rows = [(1, text("alpha")), (1, text("beta")), (2, text("gamma")), (3, text("delta")), (3, text("epsilon")), (None, text("zeta"))]
    want = [(i, t.split("\n")[0] if i in (2, 3) else t) for i, t in rows]
    assert left(spark, rows) == kept(want)


def test_against_brute_force_with_repeated_and_null_ids(spark):
    import random

    rng = random.Random(6)
    pool = [f"common words of line number {chr(97 + k) * 5} stand right here" for k in range(12)]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), "\n".join(rng.sample(pool, rng.randint(1, 3)))) for _ in range(25)]
    # Lines of the pool differ in one word of ten, so all are one template; a second pool differs in all.
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    pools = [" ".join(f"{w}{chr(97 + k)}" for w in words[:8]) for k in range(9)]
    rows += [(rng.choice([None, 1, 2, 3, 7, 8, 9]), "\n".join(rng.sample(pools, 2))) for _ in range(12)]
    ids = {}
    key = lambda line: "common" if line.startswith("common") else line
    for i, t in rows:
        if i is not None:
            for line in t.split("\n"):
                ids.setdefault(key(line), set()).add(i)
    want = [(i, "\n".join(x for x in t.split("\n") if i is None or len(ids[key(x)]) < 3 or i == min(ids[key(x)]))) for i, t in rows]
    assert left(spark, rows) == kept(want)
