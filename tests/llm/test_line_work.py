"""Line dedup reads no text for what its bytes tell, and sorts no texts to join them."""

from pyspark.sql import functions as F

from gridleaf.llm import lines


def test_lines_are_counted_without_being_cut(spark):
    texts = [None, "", "a", "a\n", "\n", "\n\n", "é\nb\r\nc", "x" * 3000 + "\n" * 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = lines.dedup_lines(docs)
    assert {r["doc_id"]: (r["n_lines"], r["chars_before"], r["chars_after"]) for r in out.collect()} == {i: (0 if t is None else t.count("\n") + 1, len(t or ""), len(t or "")) for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "shuffle_hash" in plan


def test_keys_tell_kind_and_first_in_one_column(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight\n" * 2)], "doc_id long, text string")
    rows = lines._keyed(docs, 5)
    assert rows.columns == ["doc_id", "kind", "key", "mark"]
    assert rows.groupBy("key").agg(F.sum("kind").alias("n")).where("n <> 1").count() == 0
