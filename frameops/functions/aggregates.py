"""Aggregates with pinned rules for nulls and order. All of them pre-aggregate
before the shuffle, so a hot group costs one small partial result per task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameops.functions.scalar import _column


def agg_sum(column) -> Column:
    """Sum; 0 for an empty or all-null group."""
    return F.coalesce(F.sum(_column(column)), F.lit(0))


def agg_mean(column) -> Column:
    return F.avg(_column(column))


def agg_min(column) -> Column:
    return F.min(_column(column))


def agg_max(column) -> Column:
    return F.max(_column(column))


def agg_count(column) -> Column:
    """Number of non-null values."""
    return F.count(_column(column))


def agg_len() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))


def agg_n_unique(column, approximate: bool = False) -> Column:
    """Number of distinct values, null counting as one of them."""
    col = _column(column)
    distinct = F.approx_count_distinct(col) if approximate else F.count_distinct(col)
    return distinct + F.coalesce(F.max(col.isNull().cast("long")), F.lit(0))


def agg_first(column, order) -> Column:
    """Value of the row that comes first by ``order``."""
    return F.min_by(_column(column), _order_key(order))


def agg_last(column, order) -> Column:
    """Value of the row that comes last by ``order``."""
    return F.max_by(_column(column), _order_key(order))


def _order_key(order) -> Column:
    """A struct even of one column: nulls then come first instead of being skipped."""
    columns = order if isinstance(order, (list, tuple)) else [order]
    return F.struct(*[_column(o) for o in columns])


# Aggregate names of the declarative plan.
AGGREGATES = {
    "sum": agg_sum,
    "mean": agg_mean,
    "min": agg_min,
    "max": agg_max,
    "count": agg_count,
    "n_unique": agg_n_unique,
}


# Registers of a distinct sketch, as a power of two, and the relative error that an estimate stays within
# 997 times in 1000: three standard errors of 0.84 / sqrt(registers).
SKETCH_REGISTERS = 14
SKETCH_ERROR = 3 * 0.84 / 2 ** (SKETCH_REGISTERS / 2)


def agg_distinct_sketch(column) -> Column:
    """A sketch of the distinct values of a group, null as one of them. Sketches are kept in a column, some kilobytes
    each at the most, and merged by :func:`agg_merged_sketch`, so that groups can be rolled up without their rows."""
    value = _column(column)
    # Values by their hash, with a bit that tells null from the rest.
    return F.hll_sketch_agg(F.concat(value.isNull().cast("string"), F.xxhash64(value).cast("string")), SKETCH_REGISTERS)


def agg_merged_sketch(sketch) -> Column:
    """The sketch of all values that the sketches of a group stand for; values in several of them count once."""
    return F.hll_union_agg(_column(sketch))


def distinct_estimate(sketch) -> Column:
    """The number of distinct values of a sketch, exact for few, within ``SKETCH_ERROR`` for many; 0 for no sketch."""
    return F.coalesce(F.hll_sketch_estimate(_column(sketch)), F.lit(0))
