"""Content fingerprints that do not depend on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.scalar import named

FLOAT_DIGITS = 6

# Two pieces of the row hash, of this many hexadecimal digits (60 bits) each, are
# summed. Each is summed in three limbs of 20 bits: plain long sums that hold 2**43
# rows, put together as decimals at the end.
_PIECE = 15
_PIECES = 2
_LIMB = 20
_LIMBS = 3


def value_text(column: Column, dtype: T.DataType, digits: int = FLOAT_DIGITS) -> Column:
    """Text of a value; null stays null. Floats are rounded and written as decimals,
    so 0.0 and -0.0 read the same; those too large for that keep their own text."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        number = column.cast("double")
        return (
            F.when(F.isnan(number), "nan")
            .when(F.abs(number) < 1e15, F.round(number, digits).cast(f"decimal(38,{digits})").cast("string"))
            .otherwise(number.cast("string"))
        )
    if isinstance(dtype, T.MapType):
        return F.to_json(F.struct(F.array_sort(F.map_entries(column)).alias("v")), {"ignoreNullFields": "false"})
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.FloatType, T.DoubleType)):
        parts = F.transform(column, lambda x: F.coalesce(value_text(x, dtype.elementType, digits), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.VariantType)):
        whole = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
        return F.when(column.isNotNull(), whole)
    if isinstance(dtype, T.BinaryType):
        return F.hex(column)
    return column.cast("string")


def row_text(df: DataFrame, digits: int = FLOAT_DIGITS) -> Column:
    """Every value with its length in front, so that rows of different values never
    share a text; null is told apart from every string."""
    parts = []
    for field in df.schema:
        text = value_text(named(field.name), field.dataType, digits)
        parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("N")))
    return F.concat_ws(",", *parts)


def _hashed(df: DataFrame, by: Sequence[str], digits: int) -> DataFrame:
    """The ``by`` columns and the pieces of every row's hash as longs."""
    rest = df.select(*[named(c) for c in df.columns if c not in by])
    hashed = df.select(*[named(c) for c in by], F.sha2(row_text(rest, digits), 256).alias("__hash"))
    return hashed.select(
        *[named(c) for c in by],
        *[
            F.conv(F.substring("__hash", 1 + i * _PIECE, _PIECE), 16, 10).cast("bigint").alias(f"__piece_{i}")
            for i in range(_PIECES)
        ],
    )


def _totals() -> list[Column]:
    limbs = [
        F.sum(F.shiftright(f"__piece_{i}", j * _LIMB).bitwiseAND(F.lit(2**_LIMB - 1))).alias(f"__limb_{i}_{j}")
        for i in range(_PIECES)
        for j in range(_LIMBS)
    ]
    return [F.count(F.lit(1)).alias("n_rows"), *limbs]


def _sum_text(piece: int) -> Column:
    total = F.lit(0).cast("decimal(38,0)")
    for j in range(_LIMBS):
        weight = F.lit(2 ** (j * _LIMB)).cast("decimal(18,0)")
        total = total + F.col(f"__limb_{piece}_{j}").cast("decimal(19,0)") * weight
    return total.cast("decimal(38,0)").cast("string")


def _fingerprint(columns: Sequence[str]) -> Column:
    names = ",".join(columns)
    filled = F.concat_ws(
        "|", F.lit(names), F.col("n_rows").cast("string"), *[_sum_text(i) for i in range(_PIECES)]
    )
    return F.sha2(F.when(F.col("n_rows") == 0, F.lit("<empty>:" + names)).otherwise(filled), 256)


def content_hash(df: DataFrame, float_digits: int = FLOAT_DIGITS) -> DataFrame:
    """One row ``(content_hash, n_rows)`` for the frame.

    Row hashes are added up, so copies count and order does not. Each task sends
    one partial row; nothing else is shuffled. Column order is significant, and an
    empty frame is known by its column names.
    """
    totals = _hashed(df, [], float_digits).agg(*_totals())
    return totals.select(_fingerprint(df.columns).alias("content_hash"), "n_rows")


def content_hash_by(df: DataFrame, by: Sequence[str], float_digits: int = FLOAT_DIGITS) -> DataFrame:
    """:func:`content_hash` of the other columns, one row per value of ``by``."""
    totals = _hashed(df, by, float_digits).groupBy(*map(named, by)).agg(*_totals())
    return totals.select(*map(named, by), _fingerprint([c for c in df.columns if c not in by]).alias("content_hash"), "n_rows")
