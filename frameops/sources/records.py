"""JSON-lines records and the question corpus."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.scalar import named
from frameops.operators.joins import join
from frameops.operators.ranking import MAX_ROWS_PER_TASK, number_rows

_TABLES = "map<string, struct<columns: map<string, string>, n_rows: bigint>>"

# Fields of a reference record and of a question record.
RECORD_SCHEMA = (
    f"id string, tables {_TABLES}, question string, reference_code string, tags array<string>,"
    " difficulty int, expected_output_hash string, expected_n_rows bigint, expected_columns array<string>"
)
QUESTION_SCHEMA = (
    f"id string, db_id string, question string, sql string, tables {_TABLES}, polars_code string,"
    " expected_output_hash string, expected_n_rows bigint, expected_columns array<string>"
)


def read_records(
    spark: SparkSession, path: str, schema: str | T.StructType = RECORD_SCHEMA, limit: int | None = None
) -> DataFrame:
    """Records of JSON-lines files; blank lines are skipped.

    ``limit`` keeps the first records in file order (0 or None keeps all). Only as many
    files as hold that many records are read, in the order of their names; each task finds
    its own first records, and only those are compared.
    """
    records = spark.read.schema(schema).json(path)
    if not limit:
        return records
    file = F.col("_metadata.file_path")
    # The metadata column writes a path without a host as scheme:/path.
    files = sorted(re.sub(r"^(\w+):///", r"\1:/", name) for name in records.inputFiles())
    taken = 1
    while taken < len(files) and records.where(file.isin(*files[:taken])).limit(limit).count() < limit:
        taken *= 2
    placed = records.where(file.isin(*files[:taken])).select(
        "*",
        file.alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    )
    return placed.orderBy("__file", "__block", "__line").limit(limit).drop("__file", "__block", "__line")


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, null fields included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def load_questions(
    questions: DataFrame,
    available: Sequence[str] | DataFrame,
    whitelist: Sequence[str] | None = None,
    limit: int | None = None,
    order: str = "seq",
    prefix: str = "spider",
    max_rows_per_task: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Questions of the available databases, with an id that counts per database.

    ``questions`` has ``db_id`` and ``order``, a unique position in the corpus; ``available``
    is a list of databases or a frame with their ``db_id``. Ids
    read ``<prefix>_<db_id>_<0000>``. Cutting to the first ``limit`` questions before
    counting gives the same ids, because a count only looks at earlier questions.
    """
    if not isinstance(available, DataFrame):
        available = questions.sparkSession.createDataFrame([(name,) for name in sorted(set(available))], "db_id string")
    databases = available.select("db_id")
    if whitelist is not None:
        databases = databases.where(F.col("db_id").isin(*whitelist))
    if databases.isEmpty():
        raise ValueError("none of the chosen databases is available")
    kept = join(questions, databases, on="db_id", how="semi")
    if limit:
        kept = kept.orderBy(order).limit(limit)
    # Only the two key columns are numbered; the texts join them on the unique position.
    places = number_rows(
        kept.select("db_id", order), order, over="db_id", name="__number", max_rows_per_task=max_rows_per_task
    )
    new_id = F.format_string(f"{prefix}_%s_%04d", F.col("db_id"), F.col("__number") - 1)
    return kept.join(places.select(order, "__number"), order).select(
        new_id.alias("id"), *[named(c) for c in questions.columns if c != "id"]
    )
