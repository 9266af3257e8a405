"""Scalar expressions with pinned rules for division, ranges, patterns and casts."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameops.functions.types import CAST_TARGETS, spark_type


def _column(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def true_divide(numerator, denominator) -> Column:
    """Floating division; by zero it gives +-infinity or NaN, never an error."""
    num = _column(numerator).cast("double")
    den = _column(denominator).cast("double")
    by_zero = (
        F.when(num.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(num) | (num == 0), F.lit(float("nan")))
        .when(num > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(den == 0, by_zero).otherwise(num / den)


def is_between(column, lower, upper) -> Column:
    """Closed range. Plain dates cover whole days, so the last day of a timestamp
    column is kept; both bounds stay comparisons on the bare column and reach the scan."""
    col = _column(column)
    if type(lower) is dt.date and type(upper) is dt.date:
        return (col >= F.lit(lower)) & (col < F.lit(upper + dt.timedelta(days=1)))
    return col.between(lower, upper)


def date(year: int, month: int, day: int) -> Column:
    return F.make_date(F.lit(year), F.lit(month), F.lit(day))


def cast(column, target: str) -> Column:
    """Strict cast to one of the nine target names."""
    if target not in CAST_TARGETS:
        raise ValueError(f"cannot cast to {target!r}; choose one of {', '.join(CAST_TARGETS)}")
    return _column(column).cast(spark_type(target))


_PLAIN = re.compile(r"[^\\^$.|?*+()\[\]{}]*")


def str_contains(column, pattern: str, literal: bool = False) -> Column:
    """Regular-expression search by default. A pattern without metacharacters is
    the same as a literal one, and literal search can be pushed to the scan."""
    col = _column(column)
    if literal or _PLAIN.fullmatch(pattern):
        return col.contains(F.lit(pattern))
    return col.rlike(pattern)


def str_starts_with(column, prefix: str) -> Column:
    return _column(column).startswith(F.lit(prefix))


def str_ends_with(column, suffix: str) -> Column:
    return _column(column).endswith(F.lit(suffix))


def str_to_lowercase(column) -> Column:
    return F.lower(_column(column))


def str_to_uppercase(column) -> Column:
    return F.upper(_column(column))


def str_len_chars(column) -> Column:
    return F.char_length(_column(column))


def dt_year(column) -> Column:
    return F.year(_column(column))


def dt_month(column) -> Column:
    return F.month(_column(column))


def dt_day(column) -> Column:
    return F.dayofmonth(_column(column))


def round_digits(column, digits: int = 6) -> Column:
    return F.round(_column(column), digits)
