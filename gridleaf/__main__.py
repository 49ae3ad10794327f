"""python -m gridleaf QUERY SF_DIR OUT: runs one registered query and writes its rows as Parquet.
Without arguments it lists the queries."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.queries import QUERIES


def main(argv: list[str]) -> int:
    if not argv:
        print("\n".join(sorted(QUERIES)))
        return 0
    if len(argv) != 3 or argv[0] not in QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    name, sf_dir, out = argv
    spark = SparkSession.builder.getOrCreate()
    QUERIES[name](spark, sf_dir).write.mode("errorifexists").parquet(out)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
