"""Declared type names and table schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import types as T

# Declared type name -> Spark type.
DECLARED_TYPES: dict[str, T.DataType] = {
    "Int8": T.ByteType(),
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "UInt8": T.ShortType(),
    "UInt16": T.IntegerType(),
    "UInt32": T.LongType(),
    "UInt64": T.DecimalType(20, 0),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Boolean": T.BooleanType(),
    "Bool": T.BooleanType(),
    "Utf8": T.StringType(),
    "String": T.StringType(),
    "Categorical": T.StringType(),
    "Date": T.DateType(),
    "Datetime": T.TimestampNTZType(),
    "Time": T.LongType(),
    "Duration": T.DayTimeIntervalType(),
    "Null": T.NullType(),
}

# The closed list of cast targets.
CAST_TARGETS = (
    "Int64", "Int32", "Float64", "Float32", "Utf8", "String", "Date", "Datetime", "Boolean",
)

_NESTED = re.compile(r"^\s*List\s*[\[(](.*)[\])]\s*$")


def spark_type(name: str) -> T.DataType:
    """Spark type of a declared name; parameters are ignored, unknown names are strings."""
    nested = _NESTED.match(name)
    if nested:
        return T.ArrayType(spark_type(nested.group(1)))
    base = re.split(r"[\[(]", name, maxsplit=1)[0].strip()
    if base == "Object":
        raise TypeError("Object columns have no Spark type")
    if base == "List":
        return T.ArrayType(T.StringType())
    return DECLARED_TYPES.get(base, T.StringType())


def declared_name(dtype: T.DataType) -> str:
    """Declared name of a Spark type, the inverse of :func:`spark_type`."""
    if isinstance(dtype, T.ArrayType):
        return f"List({declared_name(dtype.elementType)})"
    if isinstance(dtype, T.StructType):
        return "Struct"
    if isinstance(dtype, T.TimestampType):
        return "Datetime"
    if isinstance(dtype, T.DecimalType):
        return f"Decimal({dtype.precision}, {dtype.scale})"
    names = {
        T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64",
        T.FloatType: "Float32", T.DoubleType: "Float64", T.BooleanType: "Boolean",
        T.DateType: "Date", T.TimestampNTZType: "Datetime", T.DayTimeIntervalType: "Duration",
        T.NullType: "Null",
    }
    return names.get(type(dtype), "Utf8")


def struct_type(columns: Mapping[str, str]) -> T.StructType:
    """Spark schema of a declared ``{column: type name}`` mapping."""
    return T.StructType([T.StructField(c, spark_type(t)) for c, t in columns.items()])


# One record's tables, in order: the nested form every text job works on.
TABLES_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("table", T.StringType()),
            T.StructField("n_rows", T.LongType()),
            T.StructField(
                "columns",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("name", T.StringType()), T.StructField("dtype", T.StringType())]
                    )
                ),
            ),
        ]
    )
)


def normalise_tables(tables: Mapping[str, object]) -> list[dict]:
    """Bring any accepted schema shape into the nested form of ``TABLES_TYPE``.

    Shapes: ``{t: {"columns": {c: type}, "n_rows": n}}``, ``{t: {c: type}}`` and
    ``{t: [c, ...]}``; columns given by name only are strings.
    """
    out = []
    for table, meta in tables.items():
        n_rows = None
        columns = meta
        if isinstance(meta, Mapping) and "columns" in meta:
            columns, n_rows = meta["columns"], meta.get("n_rows")
        if isinstance(columns, Mapping):
            pairs = [(c, str(t)) for c, t in columns.items()]
        else:
            pairs = [(c, "Utf8") for c in columns]
        out.append(
            {
                "table": table,
                "n_rows": n_rows,
                "columns": [{"name": c, "dtype": t} for c, t in pairs],
            }
        )
    return out
