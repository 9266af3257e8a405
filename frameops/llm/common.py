"""What the operators share: reading a table, batches of texts, ids as text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameops.session import tune

# Rows per Arrow batch. Texts can be long; this bounds what a Python worker holds at once.
ROWS_PER_BATCH = "512"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder, in a session set up for batches of texts."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column with nulls as empty texts."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text: other columns, whatever their names, stay out of the way."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))


def per_text(
    df: DataFrame, schema: str, keep: list[str], work: Callable[[], Callable[[list[str]], list[list]]]
) -> DataFrame:
    """Run ``work()(texts)`` on batches of ``df.text``; its columns follow the kept ones.

    ``work`` is called once per task, so that it can load what it needs there. It returns
    one list per column of ``schema`` after the kept columns.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    types = _arrow(fields)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for part in parts:
            made = each(part.column("text").to_pylist())
            columns = [part.column(name) for name in keep]
            columns += [pa.array(x, type=types.field(len(keep) + i).type) for i, x in enumerate(made)]
            yield pa.RecordBatch.from_arrays(columns, names=types.names)

    return df.mapInArrow(batches, fields)


def _arrow(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def digest_of(parts: Column, separator: str = ",") -> Column:
    """Lower-case hex SHA-256 of an array of texts joined by a separator."""
    return F.sha2(F.concat_ws(separator, parts).cast("binary"), 256)
