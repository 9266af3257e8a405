"""SQL over named frames, with errors as values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from frameops.jobs import QUERY_ERRORS, error_text
from frameops.session import RUNTIME_SETTINGS, stage
from frameops.sources.audit import RefusedError, refused


@dataclass
class SqlOutcome:
    success: bool
    result: DataFrame | None
    error: str | None


def private_session(spark: SparkSession) -> SparkSession:
    """A session with its own views over the same Spark application."""
    session = spark.newSession()
    for key in (*RUNTIME_SETTINGS, "spark.sql.shuffle.partitions"):
        value = spark.conf.get(key, None)
        if value is not None:
            session.conf.set(key, value)
    return session


def query_frame(
    session: SparkSession, sql: str, tables: Iterable[str] | None = None, functions: Iterable[str] = ()
) -> DataFrame:
    """The frame of a SQL text that must be a plain query over ``tables`` (any, if not given). Commands are a parse
    error; whatever else :func:`refused` finds is an error too, and nothing of the text runs."""
    if found := refused(session, sql, tables, functions):
        raise RefusedError("; ".join(found))
    return session.sql(sql)


def execute_sql(
    spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None, run: bool = False
) -> SqlOutcome:
    """Plan a SQL text over frames registered by name.

    Errors found while analysing are returned at once; ``run`` also executes the
    query, into a staged table, and returns the errors of that. Views of the same
    name are put back afterwards.
    """
    hidden = {}
    for name, df in (tables or {}).items():
        if spark.catalog.tableExists(name):
            hidden[name] = spark.table(name)
        df.createOrReplaceTempView(name)
    try:
        result = spark.sql(sql)
        return SqlOutcome(True, stage(result, "sql") if run else result, None)
    except QUERY_ERRORS as error:
        return SqlOutcome(False, None, error_text(error))
    finally:
        for name in tables or {}:
            spark.catalog.dropTempView(name)
            if name in hidden:
                hidden[name].createOrReplaceTempView(name)
