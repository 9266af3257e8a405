"""Sort keys as bytes: one binary value that compares as some columns sort, each in its own direction.

A struct of columns compares in one direction with nulls at one end. Bytes have no such limits, so ``min_by`` and
``max_by`` over such a key give the first and last row of any sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.scalar import let

_DIGITS, _COMPLEMENT = "0123456789ABCDEF", "FEDCBA9876543210"
_DECIMALS, _NINES = "0123456789", "9876543210"


def order_key(columns: Sequence[tuple[Column, T.DataType, bool]], nulls_first: bool = True) -> Column:
    """A binary value that compares, byte by byte, as rows sort by the columns (value, type, descending).

    Nulls are first, or last, whatever the direction. -0.0 equals 0.0, NaN is the largest number, texts compare by
    their UTF-8 bytes. Maps and other values without an order raise.
    """
    parts = []
    for column, dtype, descending in columns:
        digits = _hex(column, dtype)
        key = F.translate(digits, _DIGITS, _COMPLEMENT) if descending else digits
        parts.append(F.coalesce(F.concat(F.lit("01"), key), F.lit("00" if nulls_first else "02")))
    return F.unhex(F.concat(*parts)) if parts else F.lit(b"")


def _hex(column: Column, dtype: T.DataType) -> Column:
    """Hexadecimal digits that compare as the values do, none of them the beginning of another; null for null."""
    if isinstance(dtype, T.BooleanType):
        return F.when(column, "01").when(~column, "00")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _signed(column.cast("long"))
    if isinstance(dtype, T.DateType):
        return _signed(F.unix_date(column).cast("long"))
    if isinstance(dtype, T.TimestampType):
        return _signed(F.unix_micros(column))
    if isinstance(dtype, T.TimestampNTZType):
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return _signed(F.timestamp_diff("MICROSECOND", start, column))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return let(column.cast("double") + F.lit(0.0), _double)
    if isinstance(dtype, T.DecimalType):
        return let(column, lambda x: _decimal(x, dtype))
    if isinstance(dtype, T.StringType):
        return _text(column)
    if isinstance(dtype, T.BinaryType):
        return _text(F.hex(column))
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(dtype, T.StructType):
        fields = [_flagged(column[f.name], f.dataType) for f in dtype]
        return F.when(column.isNotNull(), F.concat(F.lit(""), *fields))
    if isinstance(dtype, T.ArrayType):
        each = F.transform(column, lambda x: F.concat(F.lit("01"), _flagged(x, dtype.elementType)))
        return F.concat(F.array_join(each, ""), F.lit("00"))
    raise TypeError(f"values of type {dtype.simpleString()} have no order")


def _flagged(column: Column, dtype: T.DataType) -> Column:
    """As part of a value, where a null is smaller than everything else."""
    return F.coalesce(F.concat(F.lit("01"), _hex(column, dtype)), F.lit("00"))


def _signed(column: Column) -> Column:
    """A long with its sign bit turned, so that negative numbers come first."""
    return F.lpad(F.hex(column.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")


def _double(x: Column) -> Column:
    """The bits of a number, read from its exact hexadecimal form; those of negative numbers turned, of others the sign."""

    def bits(size: Column) -> Column:
        def digits(form: Column) -> Column:  # 0x1.921fb54442d18p1, or 0x0.…p-1022 below the normal numbers
            fraction = F.regexp_extract(form, r"\.([0-9a-f]+)p", 1)
            power = F.regexp_extract(form, r"p(-?\d+)$", 1).cast("int")
            exponent = F.when(form.startswith("0x0"), 0).otherwise(power + 1023)
            zero = fraction == "0"
            return F.concat(
                F.lpad(F.hex(exponent.cast("long")), 3, "0"),
                F.when(zero, "0" * 13).otherwise(F.upper(F.rpad(fraction, 13, "0"))),
            )

        return let(F.format_string("%a", size), digits)

    size = F.abs(x)
    digits = (
        F.when(F.isnan(x), "7FF8000000000000")
        .when(size == float("inf"), "7FF0000000000000")
        .otherwise(bits(F.when(F.isnan(x) | (size == float("inf")), 0.0).otherwise(size)))
    )
    up = F.concat(F.translate(F.substring(digits, 1, 1), "01234567", "89ABCDEF"), F.substring(digits, 2, 15))
    negative = ~F.isnan(x) & (x < 0)
    turned = F.concat(F.translate(F.substring(digits, 1, 1), "01234567", "76543210"), F.translate(F.substring(digits, 2, 15), _DIGITS, _COMPLEMENT))
    return F.when(x.isNotNull(), F.when(negative, turned).otherwise(up))


def _decimal(x: Column, dtype: T.DecimalType) -> Column:
    """All digits of a decimal after a sign, for a negative one the nines' complement."""
    whole, places = dtype.precision - dtype.scale, dtype.scale
    if places > 18:
        raise TypeError(f"decimals with {places} places have no order key")
    size = F.abs(x)
    floor = F.floor(size) if places else size
    digits = F.lpad(floor.cast("string"), whole + 1, "0")
    if places:
        rest = (size - floor).cast(f"decimal({places + 1},{places})") * F.lit(10**places).cast("decimal(19,0)")
        digits = F.concat(digits, F.lpad(rest.cast("long").cast("string"), places, "0"))
    # Pairs of digits make bytes; a text of digits of fixed length compares as they do.
    signed = F.when(x < 0, F.concat(F.lit("0"), F.translate(digits, _DECIMALS, _NINES))).otherwise(F.concat(F.lit("1"), digits))
    return F.when(x.isNotNull(), F.rpad(signed, 2 * ((whole + places + 3) // 2), "0"))


def _text(column: Column) -> Column:
    """UTF-8 with an end that is smaller than any sign: two zero bytes, so a zero byte of the text is followed by a one."""
    return F.concat(F.hex(F.encode(F.replace(column, F.lit("\0"), F.lit("\0\1")), "UTF-8")), F.lit("0000"))
