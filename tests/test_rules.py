"""Pinned rules for nulls, ties, division, names and order, on small frames."""

import datetime as dt
import math

import pytest
from helpers import physical_plan, rows_of
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from frameops.functions import aggregates as agg
from frameops.functions import scalar as fn
from frameops.functions.types import CAST_TARGETS, declared_name, normalise_tables, spark_type, struct_type
from frameops.operators import frame as op
from frameops.operators.joins import join


def test_sort_puts_nulls_first_in_both_directions(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in op.sort(df, "x").collect()] == [None, 1, 2]
    assert [r.x for r in op.sort(df, "x", descending=True).collect()] == [None, 2, 1]


def test_one_direction_covers_all_sort_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    assert [tuple(r) for r in op.sort(df, ["a", "b"], descending=True).collect()] == [(2, 1), (1, 2), (1, 1)]
    with pytest.raises(ValueError):
        op.sort(df, ["a", "b"], descending=[True])


def test_sort_of_a_map_column_still_works(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (0, {"b": 2})], "k int, m map<string,int>")
    assert [r.k for r in op.sort(df, "k").collect()] == [0, 1]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "k string, x double")
    assert rows_of(op.group_agg(df, "k", s=agg.agg_sum("x"))) == [("'a'", "0.0"), ("'b'", "1.5")]
    assert op.aggregate(df.where("k = 'z'"), s=agg.agg_sum("x")).first()["s"] == 0.0


def test_n_unique_counts_null_once(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (2,)], "x int")
    row = op.aggregate(df, u=agg.agg_n_unique("x"), c=agg.agg_count("x"), n=agg.agg_len()).first()
    assert (row.u, row.c, row.n) == (3, 2, 4)
    assert op.aggregate(df, u=agg.agg_n_unique("x", approximate=True)).first().u == 3
    assert op.aggregate(df.where("x > 9"), u=agg.agg_n_unique("x")).first().u == 0


def test_division_by_zero_is_infinite_or_nan(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0), (math.nan, 0.0)], "a double, b double"
    )
    found = [r.q for r in df.select(fn.true_divide("a", "b").alias("q")).collect()]
    assert found[0] == math.inf and found[1] == -math.inf and math.isnan(found[2])
    assert found[3] is None and found[4] is None and found[5] == 1.5 and math.isnan(found[6])


def test_whole_numbers_divide_truly(spark):
    df = spark.createDataFrame([(7, 2)], "a int, b int")
    assert df.select(fn.true_divide("a", "b").alias("q")).first().q == 3.5


def test_between_dates_keeps_the_last_day(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 31, 23, 59),), (dt.datetime(2024, 2, 1),), (dt.datetime(2023, 12, 31, 23),)],
        "ts timestamp_ntz",
    )
    kept = df.where(fn.is_between("ts", dt.date(2024, 1, 1), dt.date(2024, 1, 31)))
    assert kept.count() == 1
    days = df.select(F.to_date("ts").alias("d"))
    assert days.where(fn.is_between("d", dt.date(2024, 1, 31), dt.date(2024, 2, 1))).count() == 2


def test_contains_is_a_pattern_unless_literal(spark):
    df = spark.createDataFrame([("a.c",), ("abc",)], "s string")
    assert df.where(fn.str_contains("s", "a.c")).count() == 2
    assert df.where(fn.str_contains("s", "a.c", literal=True)).count() == 1
    assert df.where(fn.str_contains("s", "^ab")).count() == 1


def test_cast_is_strict_and_closed(spark):
    df = spark.createDataFrame([("x",)], "s string")
    with pytest.raises(PySparkException):
        df.select(fn.cast("s", "Int64")).collect()
    with pytest.raises(ValueError):
        fn.cast("s", "Decimal")
    assert len(CAST_TARGETS) == 9


def test_length_counts_characters(spark):
    df = spark.createDataFrame([("é😀",)], "s string")
    assert df.select(fn.str_len_chars("s").alias("n")).first().n == 2


def test_columns_do_not_see_their_siblings(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(AnalysisException):
        op.with_columns(df, {"b": F.col("a") + 1, "c": F.col("b") + 1})
    both = op.with_columns(df, {"a": F.col("a") * 10, "b": F.col("a") + 1})
    assert rows_of(both) == [("10", "2")]


def test_rename_checks_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert op.rename(df, {"a": "x"}).columns == ["x", "b"]
    assert op.rename(df, {"a": "b", "b": "a"}).columns == ["b", "a"]
    with pytest.raises(ValueError):
        op.rename(df, {"z": "x"})
    with pytest.raises(ValueError):
        op.rename(df, {"a": "b"})


def test_aggregates_join_every_row_without_a_window(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    wider = op.with_aggregates(df, total=agg.agg_sum("x"), n=agg.agg_len())
    assert rows_of(wider) == sorted([("1", "4", "3"), ("None", "4", "3"), ("3", "4", "3")])
    plan = physical_plan(wider)
    assert "Window" not in plan and "Join" not in plan


def test_first_and_last_need_an_order(spark):
    df = spark.createDataFrame([("a", 2, 20), ("a", 1, None), ("a", 3, 30)], "k string, o int, x int")
    row = op.group_agg(df, "k", f=agg.agg_first("x", "o"), l=agg.agg_last("x", ["o", "k"])).first()
    assert (row.f, row.l) == (None, 30)


def test_filter_combines_conditions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, s string")
    assert op.filter_all(df, [("x", ">", 1), ("s", "==", "b")]).count() == 1
    assert op.filter_all(df, [("x", ">", 1), ("s", "==", "a")], "or").count() == 3
    with pytest.raises(KeyError):
        op.filter_all(df, [("x", "=~", 1)])


def test_unique_keeps_the_first_by_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), (None, 1, "z"), (None, 0, "w")], "k string, o int, v string")
    kept = op.unique(df, "k", keep_first_by="o")
    assert kept.columns == ["k", "o", "v"]
    assert rows_of(kept) == sorted([("'a'", "1", "'y'"), ("'b'", "5", "None"), ("None", "0", "'w'")])
    assert op.unique(df, "k").count() == 3
    assert op.unique(df.select("k")).count() == 3
    assert op.unique(df.select("k"), "k", keep_first_by="k").count() == 3


def test_topk_is_taken_per_task(spark, tables):
    assert "TakeOrderedAndProject" in physical_plan(op.top_k(tables.orders, "o_totalprice", 3))


# --- joins ---------------------------------------------------------------------


@pytest.fixture
def pair(spark):
    a = spark.createDataFrame([(1, "a1"), (2, "a2"), (None, "a0"), (2, "a3")], "id int, name string")
    b = spark.createDataFrame([(2, "b2"), (3, "b3"), (None, "b0"), (2, "b4")], "id int, name string")
    return a, b


def test_inner_join_suffixes_clashes(pair):
    joined = join(*pair, on="id")
    assert joined.columns == ["id", "name", "name_right"]
    assert rows_of(joined) == sorted(("2", l, r) for l in ("'a2'", "'a3'") for r in ("'b2'", "'b4'"))
    assert join(*pair, on="id", suffix="_other").columns == ["id", "name", "name_other"]


def test_left_join_drops_the_right_key(pair):
    a, b = pair
    joined = join(a, b.withColumnRenamed("id", "key"), left_on="id", right_on="key", how="left")
    assert joined.columns == ["id", "name", "name_right"]
    assert joined.count() == 6
    assert joined.where("name_right is null").count() == 2


def test_full_join_keeps_both_keys_and_all_rows(pair):
    joined = join(*pair, on="id", how="full")
    assert joined.columns == ["id", "name", "id_right", "name_right"]
    a, b = pair
    native = a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id"), "full").toDF(*joined.columns)
    assert rows_of(joined) == rows_of(native)
    assert "FullOuter" not in physical_plan(joined)


@pytest.mark.parametrize("how", ["left", "right", "full"])
@pytest.mark.parametrize("hot", ["left", "right", "both"])
def test_outer_joins_in_parts_give_the_same_rows(pair, how, hot):
    assert rows_of(join(*pair, on="id", how=how, hot=hot)) == rows_of(join(*pair, on="id", how=how))
    assert join(*pair, on="id", how=how, hot=hot).columns == join(*pair, on="id", how=how).columns


def test_hot_names_a_side(pair):
    with pytest.raises(ValueError):
        join(*pair, on="id", how="left", hot="top")


def test_right_join_keeps_the_right_key(pair):
    joined = join(*pair, on="id", how="right")
    assert joined.columns == ["name", "id", "name_right"]
    assert joined.count() == 6
    assert joined.where("name is null").count() == 2


def test_semi_and_anti_ignore_null_keys(pair):
    assert rows_of(join(*pair, on="id", how="semi")) == [("2", "'a2'"), ("2", "'a3'")]
    assert rows_of(join(*pair, on="id", how="anti")) == sorted([("1", "'a1'"), ("None", "'a0'")])


def test_join_of_a_frame_with_itself(pair):
    a, _ = pair
    assert join(a, a.where("id > 1"), on="id").count() == 4
    assert join(a, a, on=["id", "name"]).count() == 3


def test_join_rejects_bad_keys_and_names(pair):
    a, b = pair
    with pytest.raises(ValueError):
        join(a, b)
    with pytest.raises(ValueError):
        join(a, b, on="id", left_on="id", right_on="id")
    with pytest.raises(ValueError):
        join(a, b, how="cross", on="id")
    with pytest.raises(ValueError):
        join(a.withColumnRenamed("name", "name_right").withColumn("name", F.lit("x")), b, on="id")
    with pytest.raises(KeyError):
        join(a, b, on="id", how="asof")


# --- types ---------------------------------------------------------------------


def test_declared_types():
    assert spark_type("Datetime[μs]").simpleString() == "timestamp_ntz"
    assert spark_type("List[Int64]").simpleString() == "array<bigint>"
    assert spark_type("List(List(Float32))").simpleString() == "array<array<float>>"
    assert spark_type("NotARealType").simpleString() == "string"
    assert spark_type("UInt64").simpleString() == "decimal(20,0)"
    with pytest.raises(TypeError):
        spark_type("Object")
    assert struct_type({"a": "Int8", "b": "Bool"}).simpleString() == "struct<a:tinyint,b:boolean>"
    for name in ("Int8", "Int64", "Float32", "Boolean", "Date", "Datetime", "List(Utf8)"):
        assert declared_name(spark_type(name)) == name


def test_schema_shapes_are_brought_to_one():
    wanted = [{"table": "t", "n_rows": None, "columns": [{"name": "x", "dtype": "Int64"}]}]
    assert normalise_tables({"t": {"x": "Int64"}}) == wanted
    assert normalise_tables({"t": {"columns": {"x": "Int64"}, "n_rows": 3}})[0]["n_rows"] == 3
    assert normalise_tables({"t": ["x"]})[0]["columns"] == [{"name": "x", "dtype": "Utf8"}]


def test_sketches_of_distinct_values_merge(spark):
    rows = [("a", None), ("a", 1), ("a", 1), ("b", None), ("b", None), ("c", 1), ("c", 2)]
    df = spark.createDataFrame(rows, "k string, v int")
    daily = df.groupBy("k").agg(agg.agg_distinct_sketch("v").alias("s"))
    assert {r.k: r.n for r in daily.select("k", agg.distinct_estimate("s").alias("n")).collect()} == {"a": 2, "b": 1, "c": 2}
    assert daily.agg(agg.distinct_estimate(agg.agg_merged_sketch("s")).alias("n")).first().n == 3
    assert daily.limit(0).agg(agg.distinct_estimate(agg.agg_merged_sketch("s")).alias("n")).first().n == 0
    many = spark.range(200_000).selectExpr("id % 10 AS k", "cast(id % 90000 AS string) AS v").groupBy("k")
    total = many.agg(agg.agg_distinct_sketch("v").alias("s")).agg(agg.distinct_estimate(agg.agg_merged_sketch("s")).alias("n"))
    assert abs(total.first().n - 90_000) <= agg.SKETCH_ERROR * 90_000
