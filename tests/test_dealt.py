"""Rows of a table of one row group are dealt over tasks before Python reads what is made of them."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import functions as F

from gridleaf.operators import evaluate as E
from gridleaf.operators.clustered import dealt
from gridleaf.plans import audits, forms, workflow


@pytest.mark.parametrize("make", [forms._forms, workflow._sources, forms._json_pair])
def test_documents_are_dealt(spark, data, make):
    rows = make(lambda name: spark.read.parquet(f"{data}/{name}.parquet"))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4


def test_dealing_keeps_all_rows(spark):
    rows = spark.range(1000).coalesce(1).union(spark.range(10).coalesce(1))
    assert sorted(r[0] for r in dealt(rows, "id").collect()) == sorted([*range(1000), *range(10)])


def test_audited_predictions_are_dealt(spark, data):
    from gridleaf.operators import audit as U

    rows = U.audited(*audits._audit_frames(lambda name: spark.read.parquet(f"{data}/{name}.parquet")))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < sum(sizes) / 4


def test_a_prediction_is_parsed_once(spark, data):
    src = workflow._sources(lambda name: spark.read.parquet(f"{data}/{name}.parquet"))
    jobs = E.prepared(src, "m")
    documents = jobs.select(*E.KEYS, F.lit("{}").alias("document"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = E.states(jobs, documents, src)._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json(document") == 1, plan.count("try_parse_json(document")
