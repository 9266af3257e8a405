"""Running many small Spark jobs from the driver and keeping one row about each."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import batched
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from frameops.session import scratch_path

Item = TypeVar("Item")

# What a query can fail with: anything. One failure is one outcome and never ends the others.
QUERY_ERRORS = (Exception,)

# Rows written to the shared folder together.
ROWS_PER_WRITE = 1_000


def error_text(error: Exception) -> str:
    """Type and whole text of an error."""
    return f"{type(error).__name__}: {str(error).strip()}"


def rows_of_jobs(
    spark: SparkSession,
    items: Iterable[Item],
    work: Callable[[Item], tuple],
    schema: str,
    at_once: int,
    into: str | None = None,
    rows_per_write: int = ROWS_PER_WRITE,
) -> DataFrame:
    """``work(item)`` for every item, a few at a time, as a table.

    The rows go to the shared folder in batches: the driver holds one batch of them,
    however many items there are. With ``into``, they are appended to that folder, and
    the table holds what was there before too.
    """
    path = into or scratch_path(spark, "rows")
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for some in batched(items, rows_per_write):
            rows = list(pool.map(work, some))
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
