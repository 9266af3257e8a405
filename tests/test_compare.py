"""Comparison and fingerprints: reasons, edge values and invariance."""

import math
import random
from itertools import zip_longest

import pytest
from helpers import physical_plan, rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from frameops.evaluation.compare import (
    POSITIONS_PER_BLOCK,
    _differing_by_position,
    compare,
    compare_by,
    detail_text,
    difference,
    differing_columns,
)
from frameops.evaluation.fingerprint import content_hash, content_hash_by


@pytest.fixture
def base(spark):
    return spark.createDataFrame(
        [(1, "a", 0.1), (1, "a", 0.1), (2, None, math.nan), (None, "b", -0.0), (3, "c", math.inf)],
        "k int, s string, x double",
    )


def reason(actual, expected, **more):
    return compare(actual, expected, **more).first()


def test_same_rows_in_any_order(base):
    verdict = reason(base.repartition(3, "s").select("x", "k", "s"), base)
    assert verdict.match and verdict.reason == verdict.summary == "match"
    assert verdict.actual_n_rows == verdict.expected_n_rows == 5
    assert verdict.actual_columns == ["x", "k", "s"]


def test_small_differences_are_rounded_away(base):
    assert reason(base.withColumn("x", F.col("x") + 1e-9), base).match
    changed = reason(base.withColumn("x", F.col("x") + 1e-3), base)
    assert changed.reason == "content"
    assert changed.summary == "content: 5 rows match in count but values/order differ"
    assert reason(base.withColumn("x", F.col("x") + 1e-3), base, float_digits=1).match


def test_reasons_have_an_order(base):
    missing = reason(base.drop("s").withColumn("z", F.lit(1)), base)
    assert missing.reason == "column_set"
    assert missing.summary == "column_set: missing=['s']  extra=['z']"
    assert (missing.missing_columns, missing.extra_columns) == (["s"], ["z"])
    none = base.where("k > 99")
    assert reason(none.drop("s"), base).reason == "column_set"
    assert reason(none, base).reason == "empty_actual"
    assert reason(none, none).reason == "empty_actual"
    fewer = reason(base.where("k = 1"), base)
    assert (fewer.reason, fewer.summary) == ("row_count", "row_count: actual=2 expected=5")


def test_long_texts_are_compared_whole(spark):
    long = "x" * 5000
    schema = "k int, s string, b binary"
    a = spark.createDataFrame([(1, long + "a", b"12"), (2, "short", None)], schema)
    b = spark.createDataFrame([(2, "short", None), (1, long + "a", b"12")], schema)
    assert reason(a, b).match
    assert reason(a, b.withColumn("s", F.when(F.col("k") == 1, long + "b").otherwise(F.col("s")))).reason == "content"
    digest = a.where("k = 1").select(F.concat(F.lit("#"), F.sha2("s", 256)).alias("s"))
    assert reason(a.where("k = 1").select("s"), digest).reason == "content"
    assert rows_of(difference(a, b.where("k = 2")))[0][1] == repr(long + "a")


def test_previews(base):
    verdict = compare(base.orderBy("k", "s").select("k", "s"), base.where("k > 99").select("k", "s"), previews=2).first()
    assert verdict.actual_preview == '{"k":null,"s":"b"}\n{"k":1,"s":"a"}'
    assert verdict.expected_preview == "<empty>"


def test_copies_count(spark):
    one = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    two = spark.createDataFrame([(1,), (2,), (2,)], "a int")
    assert reason(one, two).reason == "content"
    assert rows_of(difference(one, two)) == [("1", "2", "1"), ("2", "1", "2")]


def test_types(spark):
    whole = spark.createDataFrame([(1,), (2,)], "a int")
    assert reason(whole, spark.createDataFrame([(1.0,), (2.0,)], "a double")).match
    assert reason(whole, spark.createDataFrame([("1",), ("2",)], "a string")).reason == "content"


def test_nested_values(spark):
    schema = "k int, l array<int>, s struct<a:int,b:string>, m map<string,int>"
    rows = [(1, [1, None], (1, "x"), {"p": 1, "q": 2}), (2, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    swapped = spark.createDataFrame([(2, None, None, None), (1, [1, None], (1, "x"), {"q": 2, "p": 1})], schema)
    assert reason(df, swapped).match
    assert content_hash(df).first() == content_hash(swapped).first()
    other = spark.createDataFrame([(1, [None, 1], (1, "x"), {"p": 1, "q": 2}), (2, None, None, None)], schema)
    assert reason(df, other).reason == "content"
    assert content_hash(df).first() != content_hash(other).first()


def test_comparison_needs_no_join_and_no_sort(base):
    plan = physical_plan(compare(base, base.select("*")))
    assert "Join" not in plan
    assert "rangepartitioning" not in plan


def test_compare_many_runs_agrees_with_compare(spark):
    actual = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "run string, x int")
    expected = spark.createDataFrame([("a", 2), ("a", 1), ("b", 2), ("c", 1), ("c", 1), ("d", 1)], "run string, x int")
    found = {r.run: (r.match, r.reason) for r in compare_by(actual, expected, ["run"]).collect()}
    for run in "abcd":
        alone = reason(actual.where(F.col("run") == run), expected.where(F.col("run") == run))
        assert found[run] == (alone.match, alone.reason)
    with pytest.raises(ValueError):
        compare_by(actual, expected.withColumn("y", F.lit(1)), ["run"])


def test_differing_columns_by_position(spark):
    actual = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (2, "b", 2.0)], "k int, s string, x double")
    expected = spark.createDataFrame([(2, "b", 2.0), (1, "a", 1.5), (2, "c", 2.0)], "k int, s string, x double")
    found = differing_columns(actual, expected)
    assert rows_of(found) == [("1", "'k'", "0"), ("2", "'s'", "1"), ("3", "'x'", "1")]
    assert detail_text(found).first().detail == "columns with differing values: ['s', 'x']"
    assert detail_text(differing_columns(actual, actual)).first().detail == ""


def test_differing_columns_by_key(spark):
    actual = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, s string")
    expected = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k int, s string")
    found = {r.column: r.n_different for r in differing_columns(actual, expected, key="k").collect()}
    assert found == {"k": 2, "s": 3}
    with pytest.raises(PySparkException):
        differing_columns(actual.union(actual), expected, key="k").collect()


# --- fingerprints --------------------------------------------------------------


def fingerprint(df):
    return content_hash(df).first().content_hash


def test_fingerprint_ignores_order_but_not_copies(base):
    assert fingerprint(base.repartition(4)) == fingerprint(base.orderBy("x")) == fingerprint(base)
    assert fingerprint(base.distinct()) != fingerprint(base)
    assert fingerprint(base.select("s", "k", "x")) != fingerprint(base)


def test_fingerprint_tells_nulls_apart(spark):
    def one(*rows):
        return fingerprint(spark.createDataFrame(list(rows), "a string, b string"))

    prints = [one((None, "1")), one(("1", None)), one(("N", "1")), one(("", "1")), one(("1,1:1", "")), one(("1", "1:1"))]
    assert len(set(prints)) == len(prints)


def test_fingerprint_rounds_and_normalises(spark):
    def one(x):
        return fingerprint(spark.createDataFrame([(x,)], "x double"))

    assert one(0.0) == one(-0.0) == one(1e-9)
    assert one(0.1 + 0.2) == one(0.3)
    assert len({one(math.nan), one(math.inf), one(-math.inf), one(1e300), one(None)}) == 5


def test_fingerprint_of_empty_frames(spark):
    def none(schema):
        return content_hash(spark.createDataFrame([], schema)).first()

    assert none("a int").content_hash != none("b int").content_hash
    assert none("a int").n_rows == 0


def test_fingerprint_shuffles_only_partial_sums(tables):
    plan = physical_plan(content_hash(tables.lineitem))
    assert "hashpartitioning" not in plan and "SinglePartition" in plan


def test_fingerprint_by_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 1)], "g string, x int")
    found = {r.g: r.content_hash for r in content_hash_by(df, ["g"]).collect()}
    assert found["a"] == found["b"] != found["c"]
    assert found["a"] == fingerprint(df.where("g = 'a'").select("x"))


@pytest.mark.parametrize("other", ["named_struct('x', 'a')", "named_struct('y', 1)", "named_struct('x', 1, 'y', 2)"])
def test_unequal_structs_differ_in_content(spark, other):
    left, right = spark.sql("SELECT named_struct('x', 1) AS s"), spark.sql(f"SELECT {other} AS s")
    assert compare(left, right).first().reason == "content"


@pytest.mark.parametrize("seed", range(2))
def test_positions_against_sorted_lists(spark, seed):
    rnd = random.Random(seed)
    row = lambda: (rnd.choice([None, 1, 2, 3]), rnd.choice(["a", "b", None]), rnd.choice([0.5, -0.0, 0.0]))
    rows = [row() for _ in range(rnd.randint(0, 60))] + [(1, "a", 0.5)] * 30 * (seed % 2)
    other = [r for r in rows if rnd.random() < 0.9] + [row() for _ in range(rnd.randint(0, 5))]
    schema = "x int, y string, z double"
    frames = [spark.createDataFrame(side, schema).repartition(3) for side in (rows, other)]
    as_sorted = [sorted(side, key=lambda r: [(v is not None, 0 if v is None else v) for v in r]) for side in (rows, other)]
    pairs = list(zip_longest(*as_sorted, fillvalue=None))
    want = [sum(a is None or e is None or a[i] != e[i] for a, e in pairs) for i in range(3)]
    for block in (POSITIONS_PER_BLOCK, 4):
        found = _differing_by_position(*frames, ["x", "y", "z"], 6, block)
        assert [r.n_different for r in found.orderBy("position").collect()] == want


def test_positions_in_one_range_pass(spark):
    df = spark.range(50).selectExpr("id", "cast(id as string) as s")
    other = df.where("id <> 7").unionAll(df.where("id = 7").withColumn("s", F.lit("x")))
    found = differing_columns(df, other)
    assert [tuple(r) for r in found.orderBy("position").collect()] == [(1, "id", 0), (2, "s", 1)]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "rangepartitioning" not in text  # the slices have been written


def test_many_runs_with_previews_and_details(spark):
    schema = "run string, x int, y string"
    expected = [("a", i, "u") for i in range(5)] + [("b", i, "v") for i in range(4)] + [(None, 1, None), ("d", 1, "w"), ("e", 1, "w")]
    actual = [("a", i, "u") for i in range(5)] + [("b", i if i != 2 else 9, "v") for i in range(4)]
    actual += [(None, 1, "z"), ("d", 1, "w"), ("d", 1, "w"), ("f", 2, "w")]
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows in (actual, expected)]
    found = {r.run: r for r in compare_by(*frames, ["run"], previews=2, details=True).collect()}
    assert {k: r.reason for k, r in found.items()} == {
        "a": "match", "b": "content", None: "content", "d": "row_count", "e": "empty_actual", "f": "row_count",
    }
    assert {k: r.detail for k, r in found.items() if r.detail} == {
        "b": "columns with differing values: ['x']", None: "columns with differing values: ['y']",
    }
    assert found["e"].actual_preview == found["f"].expected_preview == "<empty>"
    assert found["b"].actual_preview == '{"x":0,"y":"v"}\n{"x":1,"y":"v"}'
    assert found[None].expected_preview == '{"x":1,"y":null}'


def test_details_of_a_run_with_most_rows(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, id % 7, 100) AS run", "id AS x", "id % 5 AS y")
    other = rows.withColumn("y", F.expr("if(x = 7, 9, y)"))
    judged = compare_by(other, rows, ["run"], previews=2, details=True)
    assert {r.run: r.detail for r in judged.collect() if r.detail} == {100: "columns with differing values: ['y']"}
