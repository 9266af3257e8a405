"""Sort keys as bytes against Spark's own sort."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.ordering import order_key

D = decimal.Decimal
INF = float("inf")
VALUES = {
    "boolean": [True, False],
    "tinyint": [-128, -1, 0, 1, 127],
    "int": [-(2**31), -256, -255, -1, 0, 1, 255, 256, 2**31 - 1],
    "bigint": [-(2**63), -(2**40), -1, 0, 1, 2**40, 2**63 - 1],
    "float": [-INF, -1.5, -1e-45, -0.0, 0.0, 1e-45, 1.1754942e-38, 0.1, 1.0, 3.4e38, INF, float("nan")],
    "double": [-INF, -1.7e308, -2.0, -1.9999999999999998, -5e-324, -0.0, 0.0, 5e-324, 2.2250738585072014e-308,
               2.225073858507201e-308, 0.1, 0.2, 1.0, 1.0000000000000002, 255.0, 256.0, 1.7e308, INF, float("nan")],
    "decimal(9,2)": [D("-9999999.99"), D("-10.01"), D("-10.00"), D("-0.01"), D("0.00"), D("0.10"), D("9.99"), D("10.00")],
    "decimal(38,0)": [D(-(10**27)), D(-1), D(0), D(7), D(10**20), D(10**27)],
    "decimal(20,18)": [D("-1.000000000000000001"), D("0"), D("0.000000000000000001"), D("99.999999999999999999")],
    "string": ["", "\0", "\0\0", "\0\1", "\1", "a", "a\0", "a\0b", "a\1", "aa", "b", "é", "z", "￿", "𐀀"],
    "binary": [b"", b"\0", b"\0\0", b"\1", b"a", b"\xff", b"\xff\0"],
    "date": [dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(9999, 12, 31)],
    "timestamp": [dt.datetime(1960, 1, 1, tzinfo=dt.UTC), dt.datetime(1970, 1, 1, 0, 0, 0, 1, tzinfo=dt.UTC)],
    "timestamp_ntz": [dt.datetime(1900, 1, 1), dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 31, 2, 30, 0, 5)],
    "array<string>": [[], [None], [""], ["", ""], ["\0"], ["a"], ["a", None], ["a", "a"], ["b"]],
    "struct<a:int,b:string>": [(None, None), (None, "a"), (1, None), (1, ""), (1, "b"), (2, "a"), (-1, "z")],
    "array<struct<a:double>>": [[], [(None,)], [(-1.0,)], [(1.0,), (2.0,)], [(1.0,)]],
    "void": [None],
}


def schema_of(kinds):
    return T.StructType([T.StructField(f"c{i}", T._parse_datatype_string(k)) for i, k in enumerate(kinds)])


def keys(spark, kinds, rows, descending, nulls_first=True):
    df = spark.createDataFrame(rows, schema_of(kinds))
    parts = [(F.col(f.name), f.dataType, d) for f, d in zip(df.schema, descending)]
    return df.withColumn("key", order_key(parts, nulls_first))


def groups(df, order):
    """Rows in order, with those that the order does not tell apart in one group."""
    rank = df.selectExpr("*", f"dense_rank() OVER (ORDER BY {order}) AS r").collect()
    out = {}
    for row in rank:
        out.setdefault(row.r, []).append(repr(row[:-2]))
    return [sorted(out[r]) for r in sorted(out)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", sorted(VALUES))
def test_one_column(spark, kind, descending):
    df = keys(spark, [kind], [(v,) for v in [*VALUES[kind], None]], [descending])
    assert groups(df, "key") == groups(df, f"c0 {'DESC' if descending else 'ASC'} NULLS FIRST")


@pytest.mark.parametrize("seed", range(8))
def test_several_columns_in_mixed_directions(spark, seed):
    rnd = random.Random(seed)
    kinds = rnd.choices(sorted(VALUES), k=rnd.randint(2, 4))
    descending = [rnd.random() < 0.5 for _ in kinds]
    rows = [tuple(rnd.choice([*rnd.sample(VALUES[k], min(3, len(VALUES[k]))), None]) for k in kinds) for _ in range(60)]
    nulls = rnd.random() < 0.5
    df = keys(spark, kinds, rows, descending, nulls)
    order = [f"c{i} {'DESC' if d else 'ASC'} NULLS {'FIRST' if nulls else 'LAST'}" for i, d in enumerate(descending)]
    assert groups(df, "key") == groups(df, ", ".join(order))


def test_values_without_an_order(spark):
    with pytest.raises(TypeError, match="map"):
        order_key([(F.col("m"), T.MapType(T.StringType(), T.StringType()), False)])
