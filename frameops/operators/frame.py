"""Filter, projection, grouping, ordering and distinct."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.scalar import named

COMPARISONS = {"==": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}


def condition(column: str, op: str, value) -> Column:
    """``column op value`` for one of the six comparison signs."""
    return COMPARISONS[op](named(column), F.lit(value))


def filter_all(
    df: DataFrame, conditions: Sequence[tuple[str, str, object]], combine: str = "and"
) -> DataFrame:
    """Keep rows for which all (or, with ``combine="or"``, any) conditions hold."""
    joiner = {"and": and_, "or": or_}[combine]
    return df.filter(reduce(joiner, [condition(*c) for c in conditions]))


def with_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns. Each expression sees the input columns only: using
    the name of a sibling fails instead of silently picking up the new value."""
    for expression in columns.values():
        df.select(expression)
    return df.withColumns(dict(columns))


def aggregate(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row of aggregates over the whole frame."""
    return df.agg(*[value.alias(name) for name, value in aggregates.items()])


def with_aggregates(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Add whole-frame aggregates to every row.

    The aggregates are one scalar subquery: one row, computed with partial
    aggregation and handed to the tasks as constants. No row is moved.
    """
    packed = df.agg(F.struct(*[v.alias(k) for k, v in aggregates.items()]).alias("packed"))
    value = packed.scalar()
    return df.select("*", *[value[name].alias(name) for name in aggregates])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; a missing old name or a clash is an error."""
    missing = [old for old in names if old not in df.columns]
    if missing:
        raise ValueError(f"cannot rename missing columns: {missing}")
    renamed = [names.get(c, c) for c in df.columns]
    clashes = sorted({c for c in renamed if renamed.count(c) > 1})
    if clashes:
        raise ValueError(f"rename would duplicate columns: {clashes}")
    return df.toDF(*renamed)


def group_agg(df: DataFrame, by: Sequence[str | Column] | str | Column, **aggregates: Column) -> DataFrame:
    """Group by columns or aliased expressions and aggregate."""
    keys = [named(k) if isinstance(k, str) else k for k in ([by] if isinstance(by, (str, Column)) else by)]
    return df.groupBy(*keys).agg(*[v.alias(n) for n, v in aggregates.items()])


def order_keys(by: Sequence[str] | str, descending: bool | Sequence[bool] = False) -> list[Column]:
    """Sort keys with nulls first in both directions; one flag covers all keys."""
    names = [by] if isinstance(by, str) else list(by)
    flags = [descending] * len(names) if isinstance(descending, bool) else list(descending)
    if len(flags) != len(names):
        raise ValueError(f"{len(names)} sort keys but {len(flags)} directions")
    return [
        F.desc_nulls_first(named(n)) if d else F.asc_nulls_first(named(n))
        for n, d in zip(names, flags)
    ]


def hashable(dtype: T.DataType) -> bool:
    """Whether values can be hashed, grouped and ordered by Spark."""
    if isinstance(dtype, T.ArrayType):
        return hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(hashable(f.dataType) for f in dtype)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def sort(
    df: DataFrame,
    by: Sequence[str] | str,
    descending: bool | Sequence[bool] = False,
    spread_ties: bool = True,
) -> DataFrame:
    """Total order, nulls first.

    Rows that tie on every key would all fall into one range partition. With
    ``spread_ties`` a hash of the row is the next key, which splits a hot value
    over many tasks and makes the order of ties repeatable, and the row's place in
    the input the last, which splits rows that are equal altogether.
    """
    keys = order_keys(by, descending)
    if not spread_ties:
        return df.orderBy(*keys)
    names = [named(f.name) for f in df.schema if hashable(f.dataType)]
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    return placed.orderBy(*keys, F.xxhash64(*names), "__place").drop("__place")


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top_k(
    df: DataFrame, by: Sequence[str] | str, n: int, descending: bool | Sequence[bool] = True
) -> DataFrame:
    """First ``n`` rows in sort order; each task keeps only its own best ``n``."""
    return sort(df, by, descending, spread_ties=False).limit(n)


def unique(
    df: DataFrame, subset: Sequence[str] | str | None = None, keep_first_by: Sequence[str] | str | None = None
) -> DataFrame:
    """Distinct rows, or one row per ``subset``.

    Which row is kept is arbitrary unless ``keep_first_by`` names an order. Both
    forms are aggregates with map-side partials, so copies of a hot key are
    dropped before the shuffle.
    """
    if subset is None:
        return df.distinct()
    keys = [subset] if isinstance(subset, str) else list(subset)
    if keep_first_by is None:
        return df.dropDuplicates(keys)
    order = [keep_first_by] if isinstance(keep_first_by, str) else list(keep_first_by)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = F.min_by(F.struct(*map(named, rest)), F.struct(*map(named, order))).alias("__kept")
    kept = df.groupBy(*map(named, keys)).agg(first)
    return kept.select(*[named(c) if c in keys else F.col("__kept")[c].alias(c) for c in df.columns])
