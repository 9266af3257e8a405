"""Hot keys are split: joins at small thresholds, checked in the plan that ran."""

from contextlib import contextmanager

import pytest
from helpers import physical_plan, rows_of
from pyspark.sql import functions as F

from frameops.functions import aggregates as agg
from frameops.operators.frame import group_agg
from frameops.operators.joins import join
from frameops.operators.ranking import aggregate_over, rank

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows has one key."""
    return spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"),
        F.col("id").alias("v"),
        F.md5(F.col("id").cast("string")).alias("pad"),
    )


@pytest.fixture(scope="module")
def dim(spark):
    return spark.range(-1, 4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))


def ran_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


JOBS = {
    "inner": lambda hot, dim: join(hot, dim, on="k").select("v", "w"),
    "inner, hot right": lambda hot, dim: join(dim, hot, on="k").select("v", "w"),
    "left": lambda hot, dim: join(hot, dim, on="k", how="left").select("v", "w"),
    "left, hot right": lambda hot, dim: join(dim, hot, on="k", how="left").select("v", "w"),
    "right, hot left": lambda hot, dim: join(hot, dim, on="k", how="right").select("v", "w"),
    "right": lambda hot, dim: join(dim, hot, on="k", how="right").select("v", "w"),
    "full": lambda hot, dim: join(hot, dim, on="k", how="full").select("v", "w"),
    "full, hot right": lambda hot, dim: join(dim, hot, on="k", how="full").select("v", "w"),
    "semi": lambda hot, dim: join(hot, dim, on="k", how="semi").select("v"),
    "anti": lambda hot, dim: join(hot, dim.where("k >= 0"), on="k", how="anti").select("v"),
    "grouped by the join key": lambda hot, dim: group_agg(join(hot, dim, on="k"), "k", n=agg.agg_len(), w=agg.agg_sum("w")),
    "aggregate over": lambda hot, dim: aggregate_over(hot, "k", n=agg.agg_len()).select("v", "n"),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_hot_partition_is_split(spark, hot, dim, name):
    wanted = rows_of(JOBS[name](hot, dim))
    with settings(spark, SMALL):
        df = JOBS[name](hot, dim)
        assert rows_of(df) == wanted
        plan = ran_plan(df)
    assert "skew=true" in plan or "skewed" in plan


def test_rows_of_a_hot_value_are_ranked_where_they_are_split(spark, hot):
    with settings(spark, SMALL):
        df = rank(hot, "k", "dense", name="r").select("v", "r")
        assert "skew" in ran_plan(df)
    assert df.where("r = 1").count() == 100_000


def test_sort_splits_rows_that_are_equal(spark):
    from frameops.operators.frame import sort

    rows = spark.range(0, 90_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    sizes = sort(rows, "k").where("k = 5").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 30_001 and max(r["count"] for r in sizes) < 25_000
    assert [r.k for r in sort(rows, "k").limit(3).collect()] == [1, 2, 4]


def test_small_sides_are_read_once(tables):
    joined = join(tables.nation, tables.region, left_on="n_regionkey", right_on="r_regionkey", how="full")
    assert physical_plan(joined).count("FileScan") == 2
