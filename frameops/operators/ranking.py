"""Ranks, top rows per group and row numbers without one task per group.

A plain window sends every row of a group to one task. That is kept for groups
whose largest size has been checked; beyond that bound, and always for a rank
over the whole frame, positions come from a range-partitioned running total:
distinct sort values with counts (for row numbers, the rows themselves) are cut
into sorted slices, and each slice adds the totals of the slices before it. Both
ways hand out the rows as they came in and give the same positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameops.functions.scalar import named
from frameops.operators.frame import hashable, order_keys
from frameops.session import stage

# Largest group a single task may sort.
MAX_ROWS_PER_TASK = 1_000_000

METHODS = ("average", "min", "max", "dense", "ordinal")


def group_key(over: Sequence[str]) -> Column:
    """Group columns as one struct: equal when all fields are, nulls included."""
    return F.struct(*[named(c) for c in over]) if over else F.struct(F.lit(0).alias("all"))


def _as_list(names: Sequence[str] | str | None) -> list[str]:
    if not names:
        return []
    return [names] if isinstance(names, str) else list(names)


def groups_are_small(df: DataFrame, over: Sequence[str], bound: int) -> bool:
    """Whether no group has more than ``bound`` rows (counts only the group columns)."""
    if not over:
        return False
    sizes = df.groupBy(*map(named, over)).agg(F.count(F.lit(1)).alias("__n"))
    biggest = sizes.agg(F.max("__n")).first()[0]
    return (biggest or 0) <= bound


def cut_slices(df: DataFrame, over: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows in sorted slices, staged, with the number of their slice in ``__slice``.

    ``order`` must tell the rows of a group apart, so that slices are of even size.
    Staging fixes the slice of a row wherever it is read. Adaptive execution may merge
    small neighbouring slices, which keeps them in order.
    """
    group_order = [named(c).asc_nulls_first() for c in over]
    ranged = df.repartitionByRange(*group_order, *order)
    return stage(ranged.withColumn("__slice", F.spark_partition_id()), "slices")


def running_before(
    sliced: DataFrame, over: Sequence[str], order: Sequence[Column], measures: Mapping[str, Column]
) -> DataFrame:
    """Per measure, its sum over the rows sorted before this one in its group.

    ``sliced`` comes from :func:`cut_slices` with the same group and order. A window adds
    up the rows of one slice; the totals of earlier slices, at most one row per slice and
    group, are added to that.
    """
    keyed = sliced.withColumns({"__group": group_key(over), **measures})
    inside = Window.partitionBy("__group", "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("__group").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("__group", "__slice")
        .agg(*[F.sum(m).alias(f"__total_{m}") for m in measures])
        .select(
            "__group", "__slice",
            *[F.coalesce(F.sum(f"__total_{m}").over(earlier), F.lit(0)).alias(f"__offset_{m}") for m in measures],
        )
    )
    local = keyed.withColumns({f"__local_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    return local.join(offsets, ["__group", "__slice"]).select(
        *[named(c) for c in sliced.columns if c != "__slice"],
        *[(F.col(f"__local_{m}") + F.col(f"__offset_{m}")).alias(f"{m}_before") for m in measures],
    )


def rank(
    df: DataFrame,
    column: str,
    method: str = "average",
    descending: bool = False,
    over: Sequence[str] | str | None = None,
    name: str = "rank",
    tie_break: Sequence[str] | str | None = None,
    max_rows_per_task: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Add the rank of ``column`` within its group; a null value has a null rank.

    ``ordinal`` numbers ties by ``tie_break`` and then by the other columns.
    """
    if method not in METHODS:
        raise ValueError(f"unknown rank method {method!r}")
    groups = _as_list(over)
    if method == "ordinal":
        return _ordinal(df, column, descending, groups, name, _as_list(tie_break), max_rows_per_task)
    if groups_are_small(df, groups, max_rows_per_task):
        return _window_rank(df, column, method, descending, groups, name)

    value = named(column)
    key_columns = list(dict.fromkeys([*groups, column]))
    pairs = df.where(value.isNotNull()).groupBy(*map(named, key_columns)).agg(F.count(F.lit(1)).alias("__n"))
    order = [value.desc_nulls_last() if descending else value.asc_nulls_last()]
    measures = {"__rows": F.col("__n"), "__values": F.lit(1)}
    placed = running_before(cut_slices(pairs, groups, order), groups, order, measures)
    position = {
        "dense": F.col("__values_before") + 1,
        "min": F.col("__rows_before") + 1,
        "max": F.col("__rows_before") + F.col("__n"),
        "average": F.col("__rows_before") + (F.col("__n") + 1) / 2,
    }[method]
    ranks = placed.select(group_key(key_columns).alias("__key"), position.alias("__rank"))
    return (
        df.withColumn("__key", group_key(key_columns))
        .join(ranks, "__key", "left")
        .select(*[named(c) for c in df.columns if c != name], F.col("__rank").alias(name))
    )


def _window_rank(df, column, method, descending, groups, name) -> DataFrame:
    value = named(column)
    key = value.desc_nulls_last() if descending else value.asc_nulls_last()
    ordered = Window.partitionBy(*map(named, groups)).orderBy(key)
    # Rows that sort equal are the current range, so ranks and ties share one sort.
    ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    position = {
        "dense": lambda: F.dense_rank().over(ordered).cast("long"),
        "min": lambda: F.rank().over(ordered).cast("long"),
        "max": lambda: F.rank().over(ordered) + ties - 1,
        "average": lambda: F.rank().over(ordered) + (ties - 1) / 2,
    }[method]()
    return df.withColumn(name, F.when(value.isNotNull(), position))


def _ordinal(df, column, descending, groups, name, tie_break, bound) -> DataFrame:
    value = named(column)
    ranked = number_rows(
        df.where(value.isNotNull()), [column, *tie_break], [descending] + [False] * len(tie_break),
        groups, name, max_rows_per_task=bound,
    )
    unranked = df.where(value.isNull()).withColumn(name, F.lit(None).cast("long"))
    return ranked.unionByName(unranked)


def number_rows(
    df: DataFrame,
    by: Sequence[str] | str,
    descending: bool | Sequence[bool] = False,
    over: Sequence[str] | str | None = None,
    name: str = "row_number",
    max_rows_per_task: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Number the rows of each group from 1 in sort order, nulls first.

    Ties on ``by`` are ordered by the remaining columns. Rows equal in all columns that
    can be sorted (-0.0 equals 0.0) are numbered in any order; in a group too large for
    one task they are told apart by their place in a staged copy, so that a group of
    copies is cut into slices like any other.
    """
    groups = _as_list(over)
    names = _as_list(by)
    rest = [f.name for f in df.schema if f.name not in (*names, *groups) and hashable(f.dataType)]
    order = order_keys(names, descending) + order_keys(rest)
    if groups_are_small(df, groups, max_rows_per_task):
        ordered = Window.partitionBy(*map(named, groups)).orderBy(*order)
        return df.withColumn(name, F.row_number().over(ordered).cast("long"))
    # The place is written, not computed again, so a repeated task deals out the same rows.
    placed = stage(df.withColumn("__place", F.monotonically_increasing_id()), "rows")
    order = [*order, F.col("__place").asc()]
    numbered = running_before(cut_slices(placed, groups, order), groups, order, {"__rows": F.lit(1)})
    return numbered.select(
        *[named(c) for c in df.columns if c != name], (F.col("__rows_before") + 1).alias(name)
    )


def top_per_group(
    df: DataFrame,
    column: str,
    n: int,
    over: Sequence[str] | str | None = None,
    method: str = "dense",
    descending: bool = True,
    name: str = "rank",
) -> DataFrame:
    """Rows whose dense (or min) rank within their group is at most ``n``.

    Only distinct (group, value) pairs are ranked, and each task forwards at most
    ``n`` of them per group, so neither a hot group nor a hot value gathers in one
    task. The winners are staged; the rows are then matched against them where
    they are if the winners are small enough to broadcast.
    """
    if method not in ("dense", "min"):
        raise ValueError("top_per_group ranks by 'dense' or 'min'")
    groups = _as_list(over)
    keys = list(dict.fromkeys([*groups, column]))
    value = named(column)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    pairs = df.where(value.isNotNull()).groupBy(*map(named, keys)).agg(F.count(F.lit(1)).alias("__n"))
    if groups:
        ordered = Window.partitionBy(*map(named, groups)).orderBy(order)
        best = pairs.withColumn("__place", F.row_number().over(ordered)).where(F.col("__place") <= n)
    else:
        # At most n rows are left to number.
        best = pairs.orderBy(order).limit(n).withColumn(
            "__place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order))
        )
    if method == "min":
        within = map(named, groups) if groups else [F.lit(0)]
        before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        best = best.withColumn("__place", F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1).where(
            F.col("__place") <= n
        )
    winners = stage(best.select(*map(named, keys), F.col("__place").cast("long").alias("__place")), "winners")
    winners = winners.select(group_key(keys).alias("__key"), "__place")
    return (
        df.withColumn("__key", group_key(keys))
        .join(winners, "__key")
        .select(*[named(c) for c in df.columns if c != name], F.col("__place").alias(name))
    )


def aggregate_over(
    df: DataFrame, over: Sequence[str] | str, **aggregates: Column
) -> DataFrame:
    """Add group aggregates to every row.

    The groups are aggregated with map-side partials and joined back, where a hot
    group can be split; a window would gather its rows in one task.
    """
    groups = _as_list(over)
    totals = df.groupBy(*map(named, groups)).agg(*[v.alias(k) for k, v in aggregates.items()])
    totals = totals.select(group_key(groups).alias("__key"), *aggregates)
    return (
        df.withColumn("__key", group_key(groups))
        .join(totals, "__key")
        .select(*[named(c) for c in df.columns if c not in aggregates], *[F.col(k) for k in aggregates])
    )
