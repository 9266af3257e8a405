"""Declarative plans: equality with the DataFrame form, validation, repair, extraction."""

import json

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from frameops.catalog import QUERIES
from frameops.catalog.plans import PLANS
from frameops.evaluation.compare import compare
from frameops.plans import batch
from frameops.plans.run import join_keys, repair_names, run_plan


@pytest.mark.parametrize(
    "name", ["german_documents", "filter_any", "largest_events", "turns_by_role", "documents_by_lang_and_source", "rank_dense", "first_last"]
)
def test_plan_equals_the_dataframe_form(tables, name):
    plan = PLANS[name]
    found = run_plan(plan, {plan["source_table"]: tables[plan["source_table"]]})
    assert compare(found, QUERIES[name].run(tables)).first().reason == "match"


@pytest.fixture
def small(spark):
    return {
        "t": spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 3, 7.0)], "g string, k int, x_y double"),
        "u": spark.createDataFrame([(1, "p"), (4, "q")], "k int, name string"),
    }


def run(small, *operations, **more):
    return rows_of(run_plan({"source_table": "t", "operations": list(operations)}, small, **more))


def test_names_are_repaired_where_that_helps(small):
    op = {"type": "select", "columns": ["x y"]}
    assert run(small, op) == sorted([("5.0",), ("None",), ("7.0",)])
    plan = {"source_table": "t", "operations": [op, {"type": "join", "table": "u", "on": "x y"}]}
    fixed = repair_names(plan, ["x_y", "k"])["operations"]
    assert fixed[0]["columns"] == ["x_y"] and fixed[1]["on"] == "x y"
    assert repair_names({"operations": [{"type": "select", "columns": ["no way"]}]}, ["x"])["operations"][0]["columns"] == ["no way"]


def test_head_keeps_at_least_one_row(small):
    assert run(small, {"type": "sort", "columns": [{"name": "k", "descending": True}]}, {"type": "head", "n": 0}) == [
        ("'b'", "3", "7.0")
    ]
    assert len(run(small, {"type": "head", "n": -3})) == 1


def test_join_key_forms(small):
    assert join_keys("a == b") == {"left_on": "a", "right_on": "b"}
    assert join_keys(" k ") == {"on": "k"}
    assert join_keys("", "a", "b") == {"left_on": "a", "right_on": "b"}
    joined = run(small, {"type": "join", "table": "u", "on": "k==k", "how": "left"}, {"type": "select", "columns": ["k", "name"]})
    assert joined == sorted([("1", "'p'"), ("2", "None"), ("3", "None")])
    outer = run(small, {"type": "join", "table": "u", "on": "k", "how": "outer"}, {"type": "select", "columns": ["k", "k_right"]})
    assert outer == sorted([("1", "1"), ("2", "None"), ("3", "None"), ("None", "4")])


def test_first_and_last_follow_the_sort(small):
    aggs = [{"agg": a, "column": "x_y", "alias": a} for a in ("first", "last")]
    grouped = {"type": "group_by", "columns": ["g"], "aggregations": aggs}
    up = {"type": "sort", "columns": [{"name": "x_y"}]}
    down = {"type": "sort", "columns": [{"name": "x_y", "descending": True}]}
    assert run(small, up, grouped)[0] == ("'a'", "None", "5.0")
    assert run(small, down, grouped)[0] == ("'a'", "None", "5.0")
    with pytest.raises(ValueError):
        run(small, grouped)


def test_ranks_do_not_see_each_other(small):
    ranks = {
        "type": "with_columns",
        "expressions": [
            {"column": "k", "expr": "rank", "alias": "x_y"},
            {"column": "x_y", "expr": "rank", "method": "min", "descending": False, "over": "g", "alias": "r"},
        ],
    }
    assert run(small, ranks) == sorted([("'a'", "1", "3", "1"), ("'a'", "2", "2", "None"), ("'b'", "3", "1", "1")])


def test_unknown_parts_are_errors(small):
    for op in ({"type": "pivot"}, {"type": "with_columns", "expressions": [{"column": "k", "expr": "lag", "alias": "l"}]}):
        with pytest.raises(ValueError):
            run(small, op)
    with pytest.raises(KeyError):
        run_plan({"source_table": "nope", "operations": []}, small)


# --- validation ----------------------------------------------------------------


def problems(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.p for r in df.select("i", batch.plan_problem(F.col("text")).alias("p")).orderBy("i").collect()]


def plan(*operations):
    return json.dumps({"source_table": "t", "operations": list(operations)})


def test_valid_plans(spark):
    valid = [
        plan(),
        plan({"type": "filter", "conditions": [{"column": "a", "op": "==", "value": v} for v in ("x", 1, 1.5, True)]}),
        plan({"type": "filter", "conditions": [], "combine": "or"}),
        plan({"type": "group_by", "columns": ["a"], "aggregations": [{"agg": "n_unique", "column": "b", "alias": "c"}]}),
        plan({"type": "sort", "columns": [{"name": "a"}, {"name": "b", "descending": "yes"}, {"name": "c", "descending": 0}]}),
        plan({"type": "select", "columns": ["a"], "extra": None}),
        plan({"type": "join", "table": "u"}),
        plan({"type": "join", "table": "u", "on": "k", "left_on": "", "right_on": "", "how": "outer"}),
        plan({"type": "with_columns", "expressions": [{"column": "a", "expr": "rank", "alias": "r", "over": "g"}]}),
        plan({"type": "head", "n": 5}, {"type": "head", "n": "7"}, {"type": "head", "n": 3.0}),
    ]
    assert problems(spark, *valid) == [None] * len(valid)


def test_plans_match_their_texts(spark):
    assert problems(spark, *[json.dumps(p) for p in PLANS.values()]) == [None] * len(PLANS)


def test_invalid_plans(spark):
    cases = {
        "": "malformed",
        "not json": "malformed",
        "[1]": "source_table",
        '{"source_table":"t","operations":[': "malformed",
        '{"operations":[]}': "source_table",
        '{"source_table":5,"operations":[]}': "source_table",
        '{"source_table":"t"}': "operations",
        '{"source_table":"t","operations":{}}': "operations",
        plan({"type": "pivot"}): "operation 1",
        plan({"n": 1}): "operation 1",
        plan({"type": "head"}): "operation 1",
        plan({"type": "head", "n": 1.5}): "operation 1",
        plan({"type": "head", "n": "many"}): "operation 1",
        plan({"type": "select", "columns": ["a"]}, {"type": "select", "columns": [1]}): "operation 2",
        plan({"type": "select", "columns": "a"}): "operation 1",
        plan({"type": "filter", "conditions": [{"column": "a", "op": "~", "value": 1}]}): "operation 1",
        plan({"type": "filter", "conditions": [{"column": "a", "op": "==", "value": None}]}): "operation 1",
        plan({"type": "filter", "conditions": [{"column": "a", "op": "==", "value": [1]}]}): "operation 1",
        plan({"type": "filter", "conditions": [{"column": "a", "op": "=="}]}): "operation 1",
        plan({"type": "filter", "conditions": [], "combine": "xor"}): "operation 1",
        plan({"type": "filter", "conditions": [], "combine": None}): "operation 1",
        plan({"type": "group_by", "columns": ["a"], "aggregations": [{"agg": "median", "column": "b", "alias": "c"}]}): "operation 1",
        plan({"type": "sort", "columns": ["a"]}): "operation 1",
        plan({"type": "sort", "columns": [{"name": "a", "descending": "maybe"}]}): "operation 1",
        plan({"type": "join", "table": "u", "how": "cross"}): "operation 1",
        plan({"type": "join", "table": "u", "on": None}): "operation 1",
        plan({"type": "with_columns", "expressions": [{"column": "a", "expr": "lag", "alias": "r"}]}): "operation 1",
    }
    assert dict(zip(cases, problems(spark, *cases))) == cases


def test_batch_repair_agrees_with_the_driver(spark):
    valid = ["o_orderkey", "o_totalprice", "x"]
    plans = [
        {
            "source_table": "t",
            "operations": [
                {"type": "filter", "conditions": [{"column": "o totalprice", "op": ">", "value": v}], "combine": "and"}
                for v in (5, "5", 1.5, True)
            ]
            + [
                {"type": "group_by", "columns": ["o orderkey", "no \"such"],
                 "aggregations": [{"agg": "sum", "column": "o totalprice", "alias": "o totalprice"}]},
                {"type": "sort", "columns": [{"name": "o totalprice", "descending": True}, {"name": "x", "descending": False}]},
                {"type": "select", "columns": ["o orderkey", "x"]},
                {"type": "join", "table": "u", "on": "o orderkey", "left_on": "", "right_on": "", "how": "left"},
                {"type": "with_columns", "expressions": [
                    {"column": "o totalprice", "expr": "rank", "method": "dense", "descending": True, "over": "o orderkey", "alias": "r"}]},
                {"type": "head", "n": 3},
            ],
        }
    ]
    df = spark.createDataFrame([(json.dumps(p),) for p in plans], "text string")
    known = F.array(*[F.lit(v) for v in valid])
    repaired = df.select(F.to_json(batch.repair_plan(batch.parse_plan(F.col("text")), known)).alias("j")).first().j
    assert json.loads(repaired) == repair_names(plans[0], valid)


def test_extract_block(spark):
    cases = {
        "": "",
        "none": "none",
        "{}": "{}",
        "a {b} c": "{b}",
        "a {b {c} d} e } f": "{b {c} d}",
        "open {a {b}": "{a {b}",
        "} first {x}": "{x}",
        '{"a": "}"} tail': '{"a": "}',
        "é😀 {ü{}} z": "{ü{}}",
        "{" * 500 + "}" * 500 + "x": "{" * 500 + "}" * 500,
    }
    df = spark.createDataFrame(list(enumerate(cases)) + [(99, None)], "i int, t string")
    found = [r.b for r in df.select("i", batch.extract_block(F.col("t")).alias("b")).orderBy("i").collect()]
    assert found == [*cases.values(), None]


@pytest.mark.parametrize(
    ("flag", "n", "first"),
    [("false", "3", 0), ("NO", 3.0, 0), (0, " 3 ", 0), ("true", 3, 19), (True, "3.", 19), (1, 3, 19)],
)
def test_flags_and_counts_as_written(spark, flag, n, first):
    plan = {
        "source_table": "t",
        "operations": [{"type": "sort", "columns": [{"name": "id", "descending": flag}]}, {"type": "head", "n": n}],
    }
    found = [r.id for r in run_plan(plan, {"t": spark.range(20)}).collect()]
    assert found == ([0, 1, 2] if first == 0 else [19, 18, 17])


def test_head_needs_the_columns_it_is_sorted_by(spark):
    plan = {
        "source_table": "t",
        "operations": [
            {"type": "sort", "columns": [{"name": "id", "descending": True}]},
            {"type": "select", "columns": ["x"]},
            {"type": "head", "n": 1},
        ],
    }
    with pytest.raises(ValueError, match="sorted by"):
        run_plan(plan, {"t": spark.range(3).selectExpr("id", "id AS x")})


def test_first_does_not_skip_a_null_order_value(spark):
    from frameops.functions.aggregates import agg_first

    rows = spark.createDataFrame([("one", 1), ("nullkey", None)], "s string, k int")
    assert rows.agg(agg_first("s", "k")).first()[0] == "nullkey"


def test_parsed_flags_and_counts_are_read_as_validated(spark):
    texts = [
        plan({"type": "head", "n": "3"}), plan({"type": "head", "n": 3.0}), plan({"type": "head", "n": " 4. "}),
        plan({"type": "with_columns", "expressions": [{"column": "a", "expr": "rank", "alias": "r", "descending": "no"}]}),
        plan({"type": "with_columns", "expressions": [{"column": "a", "expr": "rank", "alias": "r", "descending": 1}]}),
        plan({"type": "with_columns", "expressions": [{"column": "a", "expr": "rank", "alias": "r"}]}),
        plan({"type": "sort", "columns": [{"name": "a", "descending": "Off"}, {"name": "b c", "descending": True}]}),
        "no plan", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    parsed = df.withColumn("p", batch.parse_plan(F.col("text")))
    repaired = parsed.withColumn("p", batch.repair_plan(F.col("p"), F.array(F.lit("b_c"))))
    rows = repaired.orderBy("i").selectExpr(
        "p.operations[0].n AS n", "p.operations[0].expressions[0].descending AS d", "to_json(p.operations[0].columns) AS c"
    ).collect()
    assert [r.n for r in rows] == [3, 3, 4, *[None] * 6]
    assert [r.d for r in rows] == [None, None, None, False, True, None, None, None, None]
    assert json.loads(rows[6].c) == [{"name": "a", "descending": False}, {"name": "b_c", "descending": True}]


def test_first_and_last_after_a_sort_in_mixed_directions(spark):
    rows = [("g", 1, None, "a"), ("g", 2, 5, "b"), ("g", 2, 4, "c"), (None, None, 1, "d"), (None, 3, 1, "e")]
    df = spark.createDataFrame(rows, "k string, x int, y int, v string")
    made = {
        "source_table": "t",
        "operations": [
            {"type": "sort", "columns": [{"name": "x", "descending": True}, {"name": "y", "descending": "no"}]},
            {"type": "group_by", "columns": ["k"], "aggregations": [
                {"agg": "last", "column": "v", "alias": "z"}, {"agg": "first", "column": "v", "alias": "a"}]},
        ],
    }
    found = run_plan(made, {"t": df})
    assert found.columns == ["k", "z", "a"]
    # Nulls first in both directions.
    assert {tuple(r) for r in found.collect()} == {("g", "a", "c"), (None, "e", "d")}
    made["operations"][1]["columns"] = []
    assert [tuple(r) for r in run_plan(made, {"t": df}).collect()] == [("a", "d")]
    del made["operations"][0]
    with pytest.raises(ValueError, match="preceding sort"):
        run_plan(made, {"t": df})
