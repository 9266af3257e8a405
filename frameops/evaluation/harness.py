"""Judge a table of answers: run each one, compare it with its expected output.

An answer is a SQL text or a declarative plan. Each is planned by Spark over the
record's tables and compared in one job; only its verdict comes back. A log of
outcomes lets a later call go on where an earlier one ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from frameops.evaluation.compare import judge
from frameops.evaluation.outcomes import OutcomeLog, file_state, table_states, with_keys
from frameops.evaluation.report import tier_flags
from frameops.jobs import QUERY_ERRORS, error_text, rows_of_jobs
from frameops.plans.batch import extract_block, plan_valid
from frameops.plans.run import run_plan
from frameops.sources.sqltext import private_session, query_frame


@dataclass(frozen=True)
class Resume:
    """Where outcomes are kept. ``state`` tells whether a table has changed; ``version`` is to change with the expected
    outputs; answers whose run failed are run again if asked for."""

    folder: str
    version: str = ""
    state: Callable[[DataFrame], str] = file_state
    run_failed_again: bool = False


ANSWER_SCHEMA = (
    "id string, tags array<string>, difficulty int, tables array<string>, answer string,"
    " generation_error string, latency_sec double"
)
# Rows of each frame that are shown beside a verdict.
PREVIEW_ROWS = 5

_OUTCOME_SCHEMA = (
    "id string, syntax_error string, run_error string, comparison struct<match: boolean, reason: string,"
    " actual_n_rows: bigint, expected_n_rows: bigint, actual_columns: array<string>,"
    " expected_columns: array<string>, missing_columns: array<string>, extra_columns: array<string>,"
    " summary: string, actual_preview: string, expected_preview: string, detail: string>"
)


def evaluate_sql(
    answers: DataFrame,
    load: Callable[[SparkSession, str], DataFrame],
    expected: Mapping[str, DataFrame],
    at_once: int = 4,
    outputs: str | None = None,
    resume: Resume | None = None,
) -> DataFrame:
    """Results of SQL answers, ready for the reports.

    ``answers`` has the columns of ``ANSWER_SCHEMA``; ``load(session, table)`` reads a
    table. An answer must be a plain query over the tables its record names: one that asks
    for programs, files by path or unlisted functions (see ``sources.audit``) does not run. With ``outputs``, the rows of each answer that runs are kept as
    ``<outputs>/<id>.parquet``. With ``resume``, outcomes are kept in a log, and answers
    that have one there, for the tables as they are, do not run again.
    """
    spark = answers.sparkSession

    def frame(row: Row) -> DataFrame:
        session = private_session(spark)
        session.conf.set("spark.sql.runSQLOnFiles", "false")
        for name in row["tables"]:
            load(session, name).createOrReplaceTempView(name)
        return query_frame(session, row["answer"], row["tables"])

    chosen = answers.select("id", "tables", "answer", "generation_error")
    outcomes = _run(chosen, frame, expected, at_once, outputs, resume, "sql", load)
    return tier_flags(_joined(answers.withColumnRenamed("answer", "generated_code"), outcomes))


def evaluate_plans(
    answers: DataFrame,
    load: Callable[[SparkSession, str], DataFrame],
    expected: Mapping[str, DataFrame],
    at_once: int = 4,
    outputs: str | None = None,
    resume: Resume | None = None,
) -> DataFrame:
    """Results of plan answers, ready for the reports on plans.

    The plan is the first ``{...}`` block of the answer. Validation runs over the whole
    table of answers; only valid plans are run. ``outputs`` and ``resume`` as in :func:`evaluate_sql`.
    """
    spark = answers.sparkSession
    found = answers.withColumn("block", extract_block(F.col("answer")))
    checked = found.withColumn("json_plan", F.when(plan_valid(F.col("block")), F.col("block"))).drop("block")

    def frame(row: Row) -> DataFrame:
        return run_plan(json.loads(row["answer"]), {name: load(spark, name) for name in row["tables"]})

    runnable = checked.where(F.col("json_plan").isNotNull())
    outcomes = _run(
        runnable.select("id", "tables", F.col("json_plan").alias("answer"), "generation_error"), frame, expected,
        at_once, outputs, resume, "plan", load,
    )
    coded = checked.withColumn("generated_code", F.coalesce("json_plan", F.lit(""))).drop("answer")
    return tier_flags(_joined(coded, outcomes), from_plans=True)


def _run(
    answers: DataFrame,
    frame: Callable[[Row], DataFrame],
    expected: Mapping[str, DataFrame],
    at_once: int,
    outputs: str | None,
    resume: Resume | None,
    kind: str,
    load: Callable[[SparkSession, str], DataFrame],
) -> DataFrame:
    def work(row: Row) -> tuple:
        if row["generation_error"] is not None or not (row["answer"] or "").strip():
            return row["id"], None, None, None
        try:
            actual = frame(row)
            if outputs is not None:
                path = f"{outputs.rstrip('/')}/{row['id']}.parquet"
                actual.write.mode("overwrite").parquet(path)
                actual = spark.read.schema(actual.schema).parquet(path)
            if row["id"] not in expected:
                if outputs is None:
                    actual.write.format("noop").mode("overwrite").save()
                return row["id"], None, None, None
            return row["id"], None, None, judge(actual, expected[row["id"]], PREVIEW_ROWS)
        except ParseException as error:
            return row["id"], error_text(error).partition(": ")[2], None, None
        except QUERY_ERRORS as error:
            return row["id"], None, error_text(error), None

    spark = answers.sparkSession
    if resume is None:
        return rows_of_jobs(spark, answers.orderBy("id").toLocalIterator(), work, _OUTCOME_SCHEMA, at_once)
    names = [r["t"] for r in answers.select(F.explode("tables").alias("t")).distinct().collect()]
    states = table_states(names, lambda name: load(spark, name), resume.state, at_once)
    # Answers are judged against the output of their id, so the id is part of what an outcome depends on.
    version = f"{kind}:{resume.version}:{outputs or ''}"
    keyed = with_keys(answers, ["id", "answer", "generation_error"], states, version)
    log = OutcomeLog(spark, resume.folder, _OUTCOME_SCHEMA)
    again = F.col("run_error").isNotNull() if resume.run_failed_again else None
    return log.run(keyed, work, at_once, again).drop("key").withColumnRenamed("call", "judged_by_call")


def _joined(answers: DataFrame, outcomes: DataFrame) -> DataFrame:
    return answers.join(outcomes, "id", "left")
