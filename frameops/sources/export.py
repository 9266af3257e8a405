"""Copy a database into a folder of parquet tables, with a manifest of row counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "db_id string, table string, n_rows bigint"


def export_tables(
    names: Iterable[str], read_table: Callable[[str], DataFrame], out: str, at_once: int = 4
) -> dict[str, int]:
    """Write each table to ``<out>/<table>.parquet``, a few at a time; returns rows per table.

    Rows are counted while they are written, in the same pass.
    """

    def write(name: str) -> int:
        seen = Observation(f"rows of {name}")
        read_table(name).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{out.rstrip('/')}/{name}.parquet")
        return seen.get["n"]

    names = list(names)
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return dict(zip(names, pool.map(write, names)))


def export_databases(
    spark: SparkSession,
    databases: Mapping[str, tuple[Iterable[str], Callable[[str], DataFrame]] | None],
    out: str,
) -> DataFrame:
    """Export several databases and write ``<out>/manifest.json``.

    ``databases`` maps an id to its table names and reader; an id without a database
    (None) is skipped. Returns the manifest, one row per table.
    """
    rows = []
    for db_id, source in databases.items():
        if source is None:
            print(f"skipping {db_id}: no such database")
            continue
        names, read_table = source
        counts = export_tables(names, read_table, f"{out.rstrip('/')}/{db_id}")
        rows += [(db_id, table, n) for table, n in counts.items()]
    manifest = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    manifest.coalesce(1).write.json(f"{out.rstrip('/')}/manifest.json")
    return manifest


def jdbc_source(
    spark: SparkSession,
    url: str,
    list_sql: str,
    options: Mapping[str, str] | None = None,
    partitioning: Mapping[str, Mapping[str, str]] | None = None,
) -> tuple[list[str], Callable[[str], DataFrame]]:
    """Table names and reader of a database behind JDBC.

    ``list_sql`` returns the names of the user tables. ``partitioning`` gives a table's
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``; a table
    without them is read over one connection.
    """

    def reader(dbtable: str, extra: Mapping[str, str]) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **(options or {}), **extra).load()

    names = [row[0] for row in reader(f"({list_sql}) names", {}).collect()]
    return names, lambda table: reader(table, (partitioning or {}).get(table, {}))
