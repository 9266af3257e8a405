"""Ranks and row numbers against brute force, through both ways of computing them."""

import random
from collections import defaultdict

import pytest
from helpers import physical_plan, rows_of

from frameops.operators import ranking
from frameops.operators.frame import sort
from frameops.operators.ranking import aggregate_over, number_rows, rank, top_per_group
from frameops.functions import aggregates as agg


def sample(n=400, seed=3):
    """Rows with a hot group, hot values, copies and nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = rng.choice([None, "a", "b", "hot", "hot", "hot"])
        value = rng.choice([None, 1.5, 1.5, 1.5, -0.0, 0.0, round(rng.uniform(-9, 9), 1)])
        rows.append((group, value, rng.choice(["x", "y"])))
    return rows


def brute(rows, method, descending, grouped=True):
    """Expected (group, value, tag, rank) rows."""
    groups = defaultdict(list)
    for g, v, _ in rows:
        if v is not None:
            groups[g if grouped else None].append(v)
    out = []
    for g, v, tag in rows:
        if v is None:
            out.append((g, v, tag, None))
            continue
        values = groups[g if grouped else None]
        better = [x for x in values if (x > v if descending else x < v)]
        ties = sum(x == v for x in values)
        out.append((g, v, tag, {
            "dense": len(set(better)) + 1,
            "min": len(better) + 1,
            "max": len(better) + ties,
            "average": len(better) + (ties + 1) / 2,
        }[method]))
    return out


SCHEMA = "g string, v double, tag string"


def texts(rows):
    return sorted(
        tuple(repr(x + 0.0) if isinstance(x, float) else str(x) if isinstance(x, int) else repr(x) for x in r) for r in rows
    )


@pytest.mark.parametrize("method", ["dense", "min", "max", "average"])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("bound", [0, 10**6])
def test_rank_in_groups(spark, method, descending, bound):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = rank(df, "v", method, descending, over="g", max_rows_per_task=bound)
    assert found.columns == ["g", "v", "tag", "rank"]
    assert rows_of(found) == texts(brute(rows, method, descending))


@pytest.mark.parametrize("method", ["dense", "average"])
def test_rank_over_the_whole_frame(spark, method):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    found = rank(df, "v", method, True)
    assert rows_of(found) == texts(brute(rows, method, True, grouped=False))


@pytest.mark.parametrize("bound", [0, 10**6])
def test_ordinal_rank_numbers_ties(spark, bound):
    rows = [("a", 1, i % 7, i) for i in range(40)] + [("b", None, 0, 50), ("b", 2, 0, 51), ("b", 2, 0, 49)]
    df = spark.createDataFrame(rows, "g string, v int, w int, id int")
    found = rank(df, "v", "ordinal", True, over="g", tie_break=["w", "id"], name="n", max_rows_per_task=bound)
    got = {(r.g, r.id): r.n for r in found.collect()}
    order = sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[2], r[3]))
    assert [got["a", r[3]] for r in order] == list(range(1, 41))
    assert (got["b", 50], got["b", 49], got["b", 51]) == (None, 1, 2)


@pytest.mark.parametrize("bound", [0, 10**6])
def test_copies_of_one_row_get_distinct_numbers(spark, bound):
    rows = [("hot", 1)] * 50 + [("hot", 0)] + [("cold", 3)] * 2 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "g string, v int").repartition(4)
    found = number_rows(df, "v", over="g", name="n", max_rows_per_task=bound).collect()
    assert sorted(r.n for r in found if r.g == "hot" and r.v == 1) == list(range(2, 52))
    assert [r.n for r in found if r.v == 0] == [1]
    assert sorted(r.n for r in found if r.g == "cold") == [1, 2]
    assert sorted(r.n for r in found if r.g is None) == [1, 2, 3]


ODD_ROWS = """
    SELECT g, v, m, parse_json(j) AS j FROM VALUES
      ('a', double('-0.0'), map('k', 1), '{"x": 1}'), ('a', 0.0, map('k', 2), '[1]'), ('a', double('NaN'), NULL, '2'),
      ('a', NULL, map(), NULL), ('a', double('-0.0'), map('k', 1), '{"x": 1}'), ('b', NULL, NULL, 'null')
    AS t(g, v, m, j)
"""


@pytest.mark.parametrize("bound", [0, 10**6])
@pytest.mark.parametrize("method", ["dense", "average", "ordinal"])
def test_both_ways_hand_out_rows_as_they_came(spark, bound, method):
    """Zeros keep their sign; maps and variants pass through, ties between them in any order."""
    df = spark.sql(ODD_ROWS)
    shown = ["g", "cast(v as string)", "cast(m as string)", "to_json(j)"]
    wanted = sorted(map(repr, df.selectExpr(*shown).collect()))
    ranked = rank(df, "v", method, over="g", max_rows_per_task=bound)
    assert sorted(map(repr, ranked.selectExpr(*shown).collect())) == wanted
    places = sorted((r.g, str(r.v + 0.0 if r.v is not None else None), r["rank"]) for r in ranked.where("v is not null").collect())
    zeros = {"dense": (1, 1, 1), "average": (2.0, 2.0, 2.0), "ordinal": (1, 2, 3)}[method]
    last = {"dense": 2, "average": 4.0, "ordinal": 4}[method]
    assert places == [("a", "0.0", z) for z in zeros] + [("a", "nan", last)]
    numbered = number_rows(df, "v", over="g", name="n", max_rows_per_task=bound)
    assert sorted(map(repr, numbered.selectExpr(*shown).collect())) == wanted
    assert sorted((r.g, r.n) for r in numbered.collect()) == [("a", i) for i in range(1, 6)] + [("b", 1)]


def test_numbers_over_the_whole_frame(spark):
    df = spark.range(1000).selectExpr("id % 10 as k", "id").repartition(6)
    found = number_rows(df, ["k", "id"], [True, False], name="n").collect()
    wanted = sorted(((i % 10, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert [(r.k, r.id) for r in sorted(found, key=lambda r: r.n)] == wanted
    assert sorted(r.n for r in found) == list(range(1, 1001))


def test_empty_frames(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rank(df, "v", "dense", over="g").count() == 0
    assert rank(df, "v").count() == 0
    assert number_rows(df, "v").count() == 0
    assert top_per_group(df, "v", 2, over="g").count() == 0


@pytest.mark.parametrize("method", ["dense", "min"])
@pytest.mark.parametrize("grouped", [True, False])
@pytest.mark.parametrize("descending", [True, False])
def test_top_per_group(spark, method, grouped, descending):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    found = top_per_group(df, "v", 4, over="g" if grouped else None, method=method, descending=descending)
    wanted = [r for r in brute(rows, method, descending, grouped) if r[3] is not None and r[3] <= 4]
    assert rows_of(found) == texts(wanted)


def test_top_per_group_matches_rows_where_they_are(tables):
    found = top_per_group(tables.customer, "c_acctbal", 3, over="c_nationkey")
    plan = physical_plan(found)
    assert "BroadcastHashJoin" in plan and "Window" not in plan


def test_aggregate_over_equals_a_window_without_one(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    found = aggregate_over(df, "g", total=agg.agg_sum("v"), n=agg.agg_len())
    wanted = df.selectExpr("*", "coalesce(sum(v) over (partition by g), 0) as total", "count(1) over (partition by g) as n")
    assert rows_of(found) == rows_of(wanted)
    assert "Window" not in physical_plan(found)


def test_hot_group_is_spread_over_the_slices(spark, monkeypatch):
    staged = []

    def keep(df, label="stage", original=ranking.stage):
        staged.append(original(df, label))
        return staged[-1]

    monkeypatch.setattr(ranking, "stage", keep)
    df = spark.range(40_000).selectExpr("if(id % 3 < 2, 'hot', cast(id as string)) as g", "id % 20000 as v")
    rank(df, "v", "dense", over="g", max_rows_per_task=0).count()
    sizes = [r["count"] for r in staged[0].groupBy("__slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_sort_spreads_a_hot_value(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 < 2, 0, id) as k", "id")
    parts = [len(p) for p in sort(df, "k").rdd.glom().collect()]
    assert max(parts) < 2 * sum(parts) / len(parts)


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 2)], "`a.b c` string, `v.1` int")
    for bound in (0, 10):
        assert rank(df, "v.1", "dense", over="a.b c", max_rows_per_task=bound).count() == 3
        assert number_rows(df, "v.1", over="a.b c", max_rows_per_task=bound).count() == 3
    assert top_per_group(df, "v.1", 1, over="a.b c").count() == 2
    assert aggregate_over(df, "a.b c", n=agg.agg_len()).columns == ["a.b c", "v.1", "n"]
    assert sort(df, ["a.b c", "v.1"]).first()[1] == 2


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        rank(spark.range(1), "id", "first")
    with pytest.raises(ValueError):
        top_per_group(spark.range(1), "id", 1, method="average")
