"""Tables by path, and the registry of this subpackage's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Rows of an Arrow batch: texts may be long, and a worker holds a batch and its results.
ARROW_ROWS = "1000"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
