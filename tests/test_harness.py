"""Answers are run, compared and reported."""

import json

from frameops.evaluation import report
from frameops.evaluation.harness import ANSWER_SCHEMA, evaluate_plans, evaluate_sql


def expected_of(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    return t, {"sum": t.groupBy("k").agg({"v": "sum"}).toDF("k", "total"), "top": t.where("v = 3")}


def test_sql_answers(spark):
    t, expected = expected_of(spark)
    rows = [
        ("sum", ["agg"], 1, ["t"], "SELECT k, sum(v) AS total FROM t GROUP BY k", None, 1.0),
        ("top", ["filter"], 2, ["t"], "SELECT * FROM t WHERE v > 1", None, 2.0),
        ("free", ["filter"], 2, ["t"], "SELECT 1 AS one", None, None),
        ("typo", ["agg"], 3, ["t"], "SELEC k FROM t", None, 3.0),
        ("gone", ["agg"], 3, ["t"], "SELECT nope FROM t", None, 3.0),
        ("blank", ["agg"], 3, ["t"], " \u3000\u00a0\n", None, 3.0),
        ("slow", ["agg"], 3, ["t"], None, "timeout", 3.0),
        ("other", ["join"], 3, [], "SELECT * FROM t", None, 3.0),
    ]
    names = spark.createDataFrame(rows, ANSWER_SCHEMA)
    results = evaluate_sql(names, lambda s, name: s.createDataFrame(t.collect(), t.schema), expected)
    found = {r.id: r for r in results.withColumn("stage", report.stage()).collect()}
    assert {i: r.stage for i, r in found.items()} == {
        "sum": "match", "top": "row_count", "free": "wrong-output", "typo": "syntax", "gone": "crash",
        "blank": "syntax", "slow": "syntax", "other": "crash",
    }
    assert found["top"].error == "row_count: actual=2 expected=1"
    assert found["free"].error == "no expected parquet for this record"
    assert found["typo"].error.startswith("SyntaxError: ")
    assert found["slow"].error == "generation failed: timeout" and found["blank"].error == "empty generation"
    totals = report.overall(results).first()
    assert (totals.n, totals.parses, totals.runs, totals.matches) == (8, 5, 3, 1)


def test_plan_answers(spark):
    t, expected = expected_of(spark)

    def plan(*operations):
        return json.dumps({"source_table": "t", "operations": list(operations)})

    total = {"type": "group_by", "columns": ["k"], "aggregations": [{"agg": "sum", "column": "v", "alias": "total"}]}
    rows = [
        ("sum", [], 1, ["t"], "Here you are: " + plan(total) + " {done}", None, 1.0),
        ("top", [], 1, ["t"], plan({"type": "filter", "conditions": [{"column": "v", "op": "==", "value": 2}]}), None, 1.0),
        ("gone", [], 1, ["t"], plan({"type": "select", "columns": ["nope"]}), None, 1.0),
        ("bad", [], 1, ["t"], plan({"type": "pivot"}), None, 1.0),
        ("text", [], 1, ["t"], "I do not know", None, 1.0),
    ]
    results = evaluate_plans(spark.createDataFrame(rows, ANSWER_SCHEMA), lambda s, name: t, expected)
    found = {r.id: r for r in results.withColumn("stage", report.stage(from_plans=True)).collect()}
    assert {i: r.stage for i, r in found.items()} == {
        "sum": "match", "top": "content", "gone": "crash", "bad": "invalid-plan", "text": "invalid-plan",
    }
    assert found["text"].error == "empty conversion" and not found["bad"].plan_valid
    counts = {r.stage: r.n for r in report.by_stage(results, from_plans=True).collect()}
    assert counts == {"invalid-plan": 2, "crash": 1, "content": 1}


def test_answers_are_queries_over_their_own_tables(spark, tmp_path):
    t, expected = expected_of(spark)
    t.write.parquet(str(tmp_path / "hidden"))
    texts = {
        "path": f"SELECT * FROM parquet.`{tmp_path}/hidden`",
        "write": f"INSERT OVERWRITE DIRECTORY '{tmp_path}/made' USING parquet SELECT * FROM t",
        "multi": f"FROM t INSERT OVERWRITE DIRECTORY '{tmp_path}/made' USING parquet SELECT *",
        "with": f"WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{tmp_path}/made' USING parquet SELECT * FROM a",
        "set": "SET spark.sql.runSQLOnFiles=true",
        "view": "CREATE TEMPORARY VIEW w AS SELECT 1 AS one",
        "fine": "WITH a AS (SELECT * FROM t) SELECT k FROM a UNION ALL VALUES ('x')",
    }
    answers = spark.createDataFrame([(i, [], 1, ["t"], a, None, None) for i, a in texts.items()], ANSWER_SCHEMA)
    results = evaluate_sql(answers, lambda s, name: s.createDataFrame(t.collect(), t.schema), expected)
    found = {r.id: r.stage for r in results.withColumn("stage", report.stage()).collect()}
    assert found.pop("fine") == "wrong-output" and found.pop("path") == "crash"
    assert set(found.values()) == {"syntax"} and len(found) == 5
    assert not (tmp_path / "made").exists()


def test_outputs_are_kept_with_detail_and_previews(spark, tmp_path):
    t, expected = expected_of(spark)
    texts = {
        "sum": "SELECT k, sum(v) + 1 AS total FROM t GROUP BY k", "top": "SELECT * FROM t WHERE v = 3",
        "free": "SELECT max(v) AS m FROM t", "gone": "SELECT nope FROM t",
    }
    answers = spark.createDataFrame([(i, [], 1, ["t"], a, None, None) for i, a in texts.items()], ANSWER_SCHEMA)
    out = str(tmp_path / "outputs")
    results = evaluate_sql(
        answers, lambda s, name: s.createDataFrame(t.collect(), t.schema), expected, outputs=out
    )
    found = {r.id: r.comparison for r in results.collect()}
    assert found["sum"].reason == "content" and found["sum"].detail == "columns with differing values: ['total']"
    assert sorted(found["sum"].expected_preview.split()) == ['{"k":"a","total":1}', '{"k":"b","total":5}']
    assert found["top"].match and found["top"].detail is None and found["top"].actual_preview == '{"k":"b","v":3}'
    kept = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "outputs").iterdir()}
    assert kept == {"sum.parquet": 2, "top.parquet": 1, "free.parquet": 1}
