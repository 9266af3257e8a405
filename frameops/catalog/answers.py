"""Queries that judge whole sets of answers over the given tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from frameops.catalog import plans, relational  # noqa: F401  (registers the queries judged here)
from frameops.catalog.registry import QUERIES, query
from frameops.evaluation import report
from frameops.evaluation.harness import ANSWER_SCHEMA, Resume, evaluate_plans, evaluate_sql
from frameops.session import scratch_path
from frameops.sources.tables import load_expected, row_counts

# SQL answers: question, tables, answer, and the stage it reaches.
_SQL_ANSWERS = (
    ("turns_by_role", ["conversations"], "SELECT count(1) AS n_turns, role FROM conversations GROUP BY 2", "match"),
    ("german_documents", ["documents"], "SELECT doc_id, n_chars FROM documents WHERE lang = 'de'", "column_set"),
    ("documents_by_lang_and_source", ["documents"],
     "SELECT lang, source, count(*) AS n_documents, sum(n_chars) + 1 AS chars FROM documents GROUP BY ALL", "content"),
    ("small_parts_by_supplier_region", ["part", "lineitem", "supplier", "nation", "region"],
     QUERIES["small_parts_by_supplier_region"].sql, "match"),
    ("chained_filter", ["orders"], "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000", "row_count"),
    ("users_and_kinds", ["events"], "SELECT count(DISTINCT user) AS users, 5 AS kinds FROM events WHERE no_such > 10", "crash"),
    ("events_per_day", ["events"], "SELECT day(ts) AS day, event_type, count(*) n_events events", "syntax"),
    ("values_by_event_type", ["events"], "SELECT event_type, 1 AS total, 1 AS mean, 1 AS least, max(ts) AS latest,"
     " 1 AS n_values FROM events WHERE value < -1 GROUP BY event_type", "empty_actual"),
)

# Plan answers: question, text around the plan, the plan's name, and the stage it reaches.
_PLAN_ANSWERS = (
    ("german_documents", "{}", "german_documents", "match"),
    ("largest_events", "The plan is {} as asked.", "largest_events", "match"),
    ("rank_dense", "{}", "rank_dense", "match"),
    ("turns_by_role", "{}", "documents_by_lang_and_source", "column_set"),
    ("chained_filter", "no plan", "filter_any", "invalid-plan"),
    ("documents_by_lang_and_source", "{}", "turns_by_role", "column_set"),
)
_PLAN_TABLES = ["orders", "documents", "events", "conversations"]


def _counts_sql(answers):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS id, '{stage}' AS stage, (SELECT count(*) FROM ({QUERIES[name].sql})) AS n_expected, "
        + ("NULL" if found is None else f"(SELECT count(*) FROM ({found}))")
        + " AS n_actual"
        for name, stage, found in answers
    )


def _shown(results, from_plans=False):
    return results.select(
        "id", report.stage(from_plans).alias("stage"), F.col("comparison.actual_n_rows").alias("n_actual"),
        F.col("comparison.expected_n_rows").alias("n_expected"), "comparison.detail",
    )


_DETAIL = "CASE WHEN stage = 'content' THEN 'columns with differing values: [''chars'']' END AS detail"


_FAILED = ("crash", "syntax", "invalid-plan")


@query(
    "SELECT id, stage, n_actual, CASE WHEN n_actual IS NOT NULL THEN n_expected END AS n_expected,"
    f" {_DETAIL} FROM ("
    + _counts_sql([(n, s, None if s in _FAILED else a) for n, _, a, s in _SQL_ANSWERS]) + ")"
)
def judged_sql_answers(t):
    rows = [(n, ["sql"], 1, tables, answer, None, 0.0) for n, tables, answer, _ in _SQL_ANSWERS]
    expected = {n: QUERIES[n].run(t) for n, *_ in _SQL_ANSWERS}
    answers = t.spark.createDataFrame(rows, ANSWER_SCHEMA)
    results = evaluate_sql(answers, lambda session, name: session.read.parquet(f"{t.folder}/{name}.parquet"), expected)
    return _shown(results)


@query(
    "SELECT id, stage, n_actual, CASE WHEN n_actual IS NOT NULL THEN n_expected END AS n_expected,"
    f" {_DETAIL} FROM ("
    + _counts_sql([(n, s, None if s in _FAILED else QUERIES[p].sql) for n, _, p, s in _PLAN_ANSWERS]) + ")"
)
def judged_plan_answers(t):
    rows = [
        (n, ["plan"], 1, _PLAN_TABLES, text.replace("{}", json.dumps(plans.PLANS[p])), None, 0.0)
        for n, text, p, _ in _PLAN_ANSWERS
    ]
    expected = {n: QUERIES[n].run(t) for n, *_ in _PLAN_ANSWERS}
    answers = t.spark.createDataFrame(rows, ANSWER_SCHEMA)
    return _shown(evaluate_plans(answers, lambda _, name: t[name], expected), from_plans=True)


@query(
    "SELECT id, count(*) AS n_rows FROM (SELECT 'german_documents' AS id FROM documents WHERE lang = 'de'"
    f" UNION ALL SELECT 'turns_by_role' FROM ({QUERIES['turns_by_role'].sql}) UNION ALL SELECT 'chained_filter' FROM orders"
    " WHERE o_totalprice > 1000) GROUP BY id"
)
def outputs_of_answers(t):
    """The rows that three judged answers gave, read back from where they are kept."""
    chosen = [a for a in _SQL_ANSWERS if a[0] in ("german_documents", "turns_by_role", "chained_filter")]
    rows = [(n, ["sql"], 1, tables, answer, None, 0.0) for n, tables, answer, _ in chosen]
    folder = scratch_path(t.spark, "outputs")
    evaluate_sql(
        t.spark.createDataFrame(rows, ANSWER_SCHEMA),
        lambda session, name: session.read.parquet(f"{t.folder}/{name}.parquet"),
        {n: QUERIES[n].run(t) for n, *_ in chosen},
        outputs=folder,
    )
    return row_counts(load_expected(t.spark, folder)).withColumnRenamed("table", "id")


@query(
    "SELECT 'part_' || i AS id, CASE WHEN i % 10 = 3 THEN 'crash' WHEN n = 0 THEN 'empty_actual' ELSE 'match' END AS stage,"
    " CASE WHEN i % 10 <> 3 THEN n END AS n_actual, CASE WHEN i < 40 THEN 'first' ELSE 'second' END AS judged_by"
    " FROM (SELECT i, (SELECT count(*) FROM part WHERE p_partkey % 100 = i) AS n FROM range(100) t(i))"
)
def judged_resumed(t):
    """A hundred answers in a second call, forty of which an earlier call has judged."""
    broken = lambda i: "no_such" if i % 10 == 3 else "p_name"
    rows = [
        (f"part_{i}", ["sql"], 1, ["part"], f"SELECT p_partkey, {broken(i)} FROM part WHERE p_partkey % 100 = {i}", None, 0.0)
        for i in range(100)
    ]
    expected = {f"part_{i}": t.part.where(f"p_partkey % 100 = {i}").select("p_partkey", "p_name") for i in range(100)}
    load = lambda session, name: session.read.parquet(f"{t.folder}/{name}.parquet")
    resume = Resume(scratch_path(t.spark, "outcomes"))
    first = evaluate_sql(t.spark.createDataFrame(rows[:40], ANSWER_SCHEMA), load, expected, 8, resume=resume)
    call = F.lit(first.select("judged_by_call").first()[0])
    both = evaluate_sql(t.spark.createDataFrame(rows, ANSWER_SCHEMA), load, expected, 8, resume=resume)
    return both.select(
        "id", report.stage().alias("stage"), F.col("comparison.actual_n_rows").alias("n_actual"),
        F.when(F.col("judged_by_call") == call, "first").otherwise("second").alias("judged_by"),
    )
