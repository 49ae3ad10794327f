"""Grey values of many images as one array, rows in one row group dealt over tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridleaf.functions import png
from gridleaf.operators import images
from gridleaf.plans import jsondocs


def test_counts_stay_arrays():
    grey = np.full((16, 17), 250, np.uint8)
    grey[0, :3] = 9
    out = images._grey(pa.array([png.encoded(grey), b"no", None])).to_pylist()
    assert (out[0]["width"], out[0]["height"], out[0]["error"]) == (17, 16, None)
    assert out[0]["histogram"] == [3 if i == 9 else 16 * 17 - 3 if i == 250 else 0 for i in range(256)]
    assert all((o["width"], o["height"], o["histogram"]) == (0, 0, None) and o["error"].startswith("invalid PNG: ") for o in out[1:])
    assert images._grey(pa.array([], pa.binary())).to_pylist() == []


def test_json_documents_are_dealt(spark, data):
    rows = jsondocs._pairs(lambda name: spark.read.parquet(f"{data}/{name}.parquet"))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < sum(sizes) / 4
