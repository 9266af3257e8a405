"""Folders of parquet tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameops.functions.types import declared_name


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted stems of the ``*.parquet`` files or directories in a folder.

    Spark lists the files, on any file system it can read; only paths are read and
    only the distinct stems come back.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(folder)
    )
    inside = F.substring_index("path", f"{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    top = F.substring_index(inside, "/", 1)
    stems = files.select(top.alias("top")).where(F.col("top").endswith(".parquet")).distinct()
    return sorted(r["top"].removesuffix(".parquet") for r in stems.collect())


def load_tables(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """``{stem: frame}`` for every parquet table of a folder, sorted by name."""
    chosen = table_names(spark, folder) if names is None else list(names)
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in chosen}


def load_expected(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """:func:`load_tables`, empty when the folder does not exist."""
    try:
        return load_tables(spark, folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise


def load_database(
    spark: SparkSession, root: str, db_id: str
) -> tuple[dict[str, DataFrame], dict[str, dict[str, str]]]:
    """Tables of one database below ``root`` and their declared column types."""
    tables = load_expected(spark, f"{root.rstrip('/')}/{db_id}")
    if not tables:
        raise FileNotFoundError(f"no parquet tables for database {db_id!r} in {root}")
    return tables, {name: declared_schema(df) for name, df in tables.items()}


def declared_schema(df: DataFrame) -> dict[str, str]:
    return {f.name: declared_name(f.dataType) for f in df.schema}


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row ``(table, n_rows)`` per table; each count is a partial aggregate."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionAll(one)
    return out


def write_frame(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
