"""The pipeline's stages, each against plain Python on its own input."""

import pytest
from helpers import AWKWARD, clashing, empty

from gridleaf.llm import common, quality, tiling


def test_pipeline(spark, data):
    import corpus_pipeline as p
    from pyspark.sql import functions as F
    from test_minhash import brute

    docs = common.documents(spark, data)
    labels, benchmark = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    for name, stage in p.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = common.written(stage(spark, docs, data), "test")
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "quality classifier":
            kept = quality.judged(docs, labels, [F.col("source"), F.col("lang")], ["doc_id"]).where("kept")
            assert set(after) == {r["doc_id"] for r in kept.collect()}
        elif name == "line dedup":
            assert any(after[i]["text"] != before[i]["text"] for i in after)
            seen = {}
            for i in sorted(after):
                for line in after[i]["text"].split("\n"):
                    if len(line.split()) >= 5:
                        seen.setdefault(line.lower(), set()).add(i)
            assert max(map(len, seen.values())) <= 2
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "minhash near-dedup":
            roots, _ = brute({i: r["text"] for i, r in before.items()}, 5)
            assert set(after) == {i for i in roots if roots[i] == i}
        elif name == "benchmark decontamination":
            gone = {r["doc_id"] for r in tiling.contamination(docs, benchmark).where("contaminated").collect()}
            assert set(after) == set(before) - gone
        else:
            assert set(after) == set(before) and all(r["exact"] for r in after.values())
        docs = out


@pytest.mark.parametrize("make", [clashing, empty])
def test_stages_on_awkward_rows(spark, data, make):
    import corpus_pipeline as p

    docs = make(spark)
    for name, stage in p.STAGES:
        before = docs.columns
        docs = common.written(stage(spark, docs, data), "test")
        if name != p.STAGES[-1][0]:
            assert docs.columns == before
    left = {r["doc_id"] for r in docs.collect()}
    assert left <= {r[0] for r in AWKWARD} and (make is empty) == (not left)


def test_line_stage_keeps_what_is_left(spark):
    import corpus_pipeline as p

    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(250))
    own = "a line of its own here"
    docs = [(1, passage, "en", "s", len(passage)), (2, f"{passage}\n{own}", "en", "s", 0), (3, passage, "en", "s", 0), (4, None, "en", "s", 7), (5, "", "en", "s", 0)]
    got = {r["doc_id"]: r for r in p.line_stage(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert set(got) == {1, 2, 4, 5} and got[2]["text"] == own and got[2]["n_chars"] == len(own)
    assert got[1]["n_chars"] == len(passage) and got[4]["n_chars"] == 7
