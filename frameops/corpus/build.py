"""Build corpora: run every query, keep its output, and record what it returned.

Each query is a Spark job that writes its own output; the driver handles one
outcome row per query and never any data. Queries run a few at a time, so that
small ones do not leave the cluster idle. With a log, queries that have an outcome
there, for their tables as they are, do not run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from frameops.evaluation.fingerprint import content_hash
from frameops.evaluation.outcomes import OutcomeLog, file_state, table_states, with_keys
from frameops.jobs import QUERY_ERRORS, error_text, rows_of_jobs
from frameops.session import stage
from frameops.sources.sqltext import private_session
from frameops.sources.tables import declared_schema, row_counts

OUTCOME_SCHEMA = (
    "id string, status string, error string, output string, content_hash string, n_rows bigint, columns array<string>"
)
STATUSES = ("ok", "empty", "failed")


@dataclass(frozen=True)
class Job:
    """A query to run: its id and a callable that returns its frame."""

    id: str
    frame: Callable[[], DataFrame]


def _run(job: Job, out: str, keep_empty: bool) -> tuple:
    path = f"{out.rstrip('/')}/{job.id}.parquet"
    try:
        df = job.frame()
        df.write.mode("overwrite").parquet(path)
        written = df.sparkSession.read.schema(df.schema).parquet(path)
        found = content_hash(written).first()
    except QUERY_ERRORS as error:
        return job.id, "failed", error_text(error), None, None, None, None
    if found["n_rows"] == 0 and not keep_empty:
        return job.id, "empty", None, None, None, 0, df.columns
    return job.id, "ok", None, path, found["content_hash"], found["n_rows"], df.columns


def record_outputs(
    spark: SparkSession, jobs: Iterable[Job], out: str, keep_empty: bool = False, at_once: int = 4
) -> DataFrame:
    """Run the jobs, write each output to ``<out>/<id>.parquet``, return the outcomes.

    An outcome has the status (ok, empty or failed), the error, and the content hash,
    row count and columns of the written output.
    """
    return rows_of_jobs(spark, jobs, lambda job: _run(job, out, keep_empty), OUTCOME_SCHEMA, at_once)


def _resumed(
    queries: DataFrame, job: Callable[[Row], Job], out: str, log: str, keep_empty: bool = False, at_once: int = 4
) -> DataFrame:
    """:func:`record_outputs` of the rows of ``queries`` (key, ...) that have no outcome in the log yet."""
    kept = OutcomeLog(queries.sparkSession, log, OUTCOME_SCHEMA)
    return kept.run(queries, lambda row: _run(job(row), out, keep_empty), at_once).drop("key", "call")


def build_question_corpus(
    questions: DataFrame,
    load: Callable[[SparkSession, str], Mapping[str, DataFrame]],
    out: str,
    at_once: int = 4,
    log: str | None = None,
    state: Callable[[DataFrame], str] = file_state,
) -> tuple[DataFrame, DataFrame]:
    """Run the SQL of every question; returns (records to keep, outcomes of all).

    ``questions`` has ``id, db_id, question, sql``; ``load(session, db_id)`` reads the
    tables of a database once, in a session of its own so that equal table names of
    two databases do not clash. Only questions with a non-empty result are kept; a
    record carries the declared schema and row count of its tables. ``log`` goes with
    ``out``, where the outputs of resumed questions are; a question runs again when the
    ``state`` of a table of its database has changed.
    """
    spark = questions.sparkSession
    sessions: dict[str, SparkSession] = {}
    states: dict[str, str] = {}
    schemas: list[tuple] = []

    def session_for(db_id: str) -> SparkSession:
        if db_id not in sessions:
            sessions[db_id] = private_session(spark)
            tables = load(sessions[db_id], db_id)
            for name, df in tables.items():
                df.createOrReplaceTempView(name)
            counts = {r["table"]: r["n_rows"] for r in row_counts(tables).collect()}
            if log is not None:
                states[db_id] = repr(sorted(table_states(tables, tables.get, state, at_once).items()))
            schemas.append((db_id, {n: (declared_schema(df), counts[n]) for n, df in tables.items()}))
        return sessions[db_id]

    def jobs() -> Iterator[Job]:
        for row in questions.select("id", "db_id", "sql").orderBy("id").toLocalIterator():
            session = session_for(row["db_id"])
            yield Job(row["id"], lambda session=session, sql=row["sql"]: session.sql(sql))

    if log is None:
        outcomes = record_outputs(spark, jobs(), out, at_once=at_once)
    else:
        for row in questions.select("db_id").distinct().collect():
            session_for(row["db_id"])
        asked = questions.select("id", "db_id", "sql", F.array("db_id").alias("tables"))
        keyed = with_keys(asked, ["id", "sql"], states, version=out)
        job = lambda row: Job(row["id"], lambda: sessions[row["db_id"]].sql(row["sql"]))
        outcomes = _resumed(keyed, job, out, log, at_once=at_once)
    schema_type = "db_id string, tables map<string, struct<columns: map<string, string>, n_rows: bigint>>"
    # Staged, so that the planner knows how small it is.
    tables = stage(spark.createDataFrame(schemas, schema_type), "schemas")
    kept = outcomes.where(F.col("status") == "ok")
    records = (
        questions.select("id", "db_id", "question", "sql")
        .join(kept, "id")
        .join(tables, "db_id")
        .select(
            "id", "db_id", "question", "sql", "tables",
            F.lit(None).cast("string").alias("polars_code"),
            F.col("content_hash").alias("expected_output_hash"),
            F.col("n_rows").alias("expected_n_rows"),
            F.col("columns").alias("expected_columns"),
        )
    )
    return records, outcomes


def status_totals(outcomes: DataFrame) -> DataFrame:
    """Number of queries per status."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def build_references(
    spark: SparkSession,
    catalog: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]],
    tables: Mapping[str, DataFrame],
    used: Mapping[str, Iterable[str]],
    out: str,
    at_once: int = 4,
    log: str | None = None,
    version: str = "",
    state: Callable[[DataFrame], str] = file_state,
) -> tuple[DataFrame, DataFrame]:
    """Run every query of a catalog; returns (records with the tables used, outcomes).

    An empty result is a valid reference, so only failures are left out. ``log`` goes with
    ``out``; a query runs again when a table it uses, or the ``version`` of the catalog, has
    changed.
    """
    if log is None:
        jobs = (Job(name, lambda q=query: q(tables)) for name, query in catalog.items())
        outcomes = record_outputs(spark, jobs, out, keep_empty=True, at_once=at_once)
    else:
        names = spark.createDataFrame([(name, sorted(used[name])) for name in catalog], "id string, tables array<string>")
        states = table_states({t for name in catalog for t in used[name]}, tables.get, state, at_once)
        keyed = with_keys(names, ["id"], states, version=f"{version}:{out}")
        job = lambda row: Job(row["id"], lambda: catalog[row["id"]](tables))
        outcomes = _resumed(keyed, job, out, log, keep_empty=True, at_once=at_once)
    counts = {r["table"]: r["n_rows"] for r in row_counts(tables).collect()}
    described = [
        (name, {t: (declared_schema(tables[t]), counts[t]) for t in used[name]}) for name in catalog
    ]
    schema_type = "id string, tables map<string, struct<columns: map<string, string>, n_rows: bigint>>"
    tables_used = stage(spark.createDataFrame(described, schema_type), "schemas")
    records = (
        outcomes.where(F.col("status") == "ok")
        .join(tables_used, "id")
        .select(
            "id", "tables",
            F.col("content_hash").alias("expected_output_hash"),
            F.col("n_rows").alias("expected_n_rows"),
            F.col("columns").alias("expected_columns"),
        )
    )
    return records, outcomes
