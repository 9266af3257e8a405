"""Equi-joins with pinned rules for key columns and clashing names.

No side is hinted: the planner broadcasts a side only when its known size is
below ``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution splits
hot partitions of the others (:func:`frameops.session.tune`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.functions.scalar import named

# Accepted join names -> kind of join.
KINDS = {
    "inner": "inner",
    "left": "left",
    "right": "right",
    "outer": "full",
    "full": "full",
    "semi": "left_semi",
    "anti": "left_anti",
    "cross": "cross",
}


def _names(keys: str | Sequence[str] | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | None = None,
    left_on: str | Sequence[str] | None = None,
    right_on: str | Sequence[str] | None = None,
    how: str = "inner",
    suffix: str = "_right",
    hot: str | None = None,
) -> DataFrame:
    """Join two frames on equal keys; null keys match nothing.

    inner / left keep the left key columns, right keeps the right ones, full
    keeps both. A right column whose name is taken gets ``suffix``.

    An outer join can be split at a hot key of the side it keeps whole. Where the other
    side is large enough for a partition to count as skewed, by the planner's estimate,
    the join is made of parts that can be split at either side; ``hot`` ("left", "right"
    or "both") asks for that at any size. The rows are the same either way.
    """
    if hot not in (None, "left", "right", "both"):
        raise ValueError(f"unknown side {hot!r}")
    kind = KINDS[how]
    if kind == "cross":
        if on or left_on or right_on:
            raise ValueError("a cross join takes no keys")
    elif bool(on) == bool(left_on or right_on):
        raise ValueError("give either on= or left_on= and right_on=")
    left_keys = _names(on) or _names(left_on)
    right_keys = _names(on) or _names(right_on)
    if len(left_keys) != len(right_keys):
        raise ValueError("left_on and right_on differ in length")

    # Private names on the right side keep self-joins and clashes unambiguous.
    private = {c: f"__right_{i}" for i, c in enumerate(right.columns)}
    renamed = right.select(*[named(c).alias(p) for c, p in private.items()])

    if kind in ("left_semi", "left_anti"):
        # Distinct keys are reduced before the shuffle, so a hot right key is one row.
        keys = renamed.select(*[private[k] for k in right_keys]).distinct()
        return left.join(keys, _equal(left_keys, [private[k] for k in right_keys]), kind)

    kept_left = [c for c in left.columns if not (kind == "right" and c in left_keys)]
    kept_right = [c for c in right.columns if not (kind in ("inner", "left") and c in right_keys)]
    taken = set(kept_left)
    output = {}
    for c in kept_right:
        name = c + suffix if c in taken else c
        if name in taken or name in output.values():
            raise ValueError(f"duplicate column {name!r} after join; choose another suffix")
        output[c] = name

    if kind == "cross":
        joined = left.crossJoin(renamed)
    elif kind in ("left", "right", "full") and _in_danger(left, renamed, kind, hot):
        joined = _in_parts(left, renamed, left_keys, [private[k] for k in right_keys], kind)
    else:
        joined = left.join(renamed, _equal(left_keys, [private[k] for k in right_keys]), kind)
    return joined.select(
        *[named(c) for c in kept_left],
        *[F.col(private[c]).alias(output[c]) for c in kept_right],
    )


def _equal(left_keys: Sequence[str], right_keys: Sequence[str]) -> Column:
    return reduce(and_, [named(l) == named(r) for l, r in zip(left_keys, right_keys)])


def _alone(df: DataFrame, keys: list[str], other: DataFrame, other_keys: list[str]) -> DataFrame:
    """Rows of ``df`` without a partner, found by the distinct keys of the other frame."""
    probe = [f"__probe_{i}" for i in range(len(keys))]
    known = other.select(*[named(k).alias(p) for k, p in zip(other_keys, probe)]).distinct()
    return df.join(known, _equal(keys, probe), "left_anti")


def _in_danger(left: DataFrame, right: DataFrame, kind: str, hot: str | None) -> bool:
    """Whether a side that an outer join cannot split may fill a skewed partition."""
    unsplit = {"left": [("right", right)], "right": [("left", left)], "full": [("left", left), ("right", right)]}[kind]
    return any(hot in (side, "both") or _may_be_skewed(df) for side, df in unsplit)


def _may_be_skewed(df: DataFrame) -> bool:
    """Whether the planner's size of a frame reaches the size from which a partition is split."""
    state = df.sparkSession._jsparkSession.sessionState()
    threshold = state.conf().getConfString("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "256MB")
    bound = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(threshold)
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= bound


def _in_parts(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], kind: str) -> DataFrame:
    """An outer join as the union of its matches and the rows without a partner.

    Adaptive execution splits hot partitions on both sides of an inner join, on the
    left of a left or anti join, and not at all in a full outer join. In parts, a hot
    key on any side can be split, and a small side can still be broadcast.
    """
    parts = [left.join(right, _equal(left_keys, right_keys), "inner")]
    if kind in ("left", "full"):
        parts.append(_alone(left, left_keys, right, right_keys))
    if kind in ("right", "full"):
        parts.append(_alone(right, right_keys, left, left_keys))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
