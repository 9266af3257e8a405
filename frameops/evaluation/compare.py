"""Order-insensitive comparison of two frames with a reason for any mismatch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.scalar import named
from frameops.operators.frame import hashable
from frameops.operators.ranking import group_key
from frameops.session import stage

FLOAT_DIGITS = 6

# Reasons in order of precedence.
REASONS = ("column_set", "empty_actual", "row_count", "content", "match")


def column_difference(actual: Sequence[str], expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """Sorted missing and extra column names; order is ignored."""
    return sorted(set(expected) - set(actual)), sorted(set(actual) - set(expected))


def normalise(df: DataFrame, float_digits: int = FLOAT_DIGITS) -> DataFrame:
    """Round floating columns; a map becomes its sorted entries so that it can be
    grouped. No sorting of rows is needed to compare frames as multisets."""
    return df.select(*[_normal(named(f.name), f.dataType, float_digits).alias(f.name) for f in df.schema])


def _normal(column: Column, dtype: T.DataType, digits: int) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.round(column, digits)
    if isinstance(dtype, T.NullType):
        return column.cast("string")
    if isinstance(dtype, T.MapType) and hashable(dtype.valueType):
        return F.array_sort(F.map_entries(column))
    if not hashable(dtype):
        return F.to_json(F.struct(column.alias("v")))
    return column


def comparable(left: T.DataType, right: T.DataType) -> bool:
    """Whether values of two types can be equal: same type or both numeric, for structs field by field."""
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        return True
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return comparable(left.elementType, right.elementType)
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        return [f.name for f in left] == [f.name for f in right] and all(
            comparable(a.dataType, b.dataType) for a, b in zip(left, right)
        )
    if isinstance(left, T.MapType) and isinstance(right, T.MapType):
        return comparable(left.keyType, right.keyType) and comparable(left.valueType, right.valueType)
    moments = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(left, moments) and isinstance(right, moments):
        return True
    return T.NullType() in (left, right) or type(left) is type(right)


def _digest(column: Column, dtype: T.DataType) -> Column:
    """A long text replaced by a SHA-256 of all of it, so that comparing wide rows moves
    digests only. A digest is longer than any text that is kept."""
    if isinstance(dtype, T.StringType):
        return F.when(F.octet_length(column) > 64, F.concat(F.lit("#"), F.sha2(column, 256))).otherwise(column)
    return F.sha2(column, 256) if isinstance(dtype, T.BinaryType) else column


def _counted(
    actual: DataFrame, expected: DataFrame, columns: Sequence[str], digits: int, digest: Sequence[str] = ()
) -> DataFrame:
    """Every distinct row with its number of copies on either side.

    One union and one aggregation: copies are merged before the shuffle and no
    join is needed. Columns of types that cannot be equal never share a row. Long
    texts in the ``digest`` columns stand for themselves by digest.
    """
    sides = []
    clash = any(not comparable(actual.schema[c].dataType, expected.schema[c].dataType) for c in columns)
    for frame, side in ((actual, "a"), (expected, "e")):
        rows = normalise(frame.select(*[named(c) for c in columns]), digits)
        if clash:
            rows = rows.select(
                *[
                    named(c)
                    if comparable(actual.schema[c].dataType, expected.schema[c].dataType)
                    else F.to_json(F.struct(named(c).alias(side))).alias(c)
                    for c in columns
                ]
            ).withColumn("__side", F.lit(side))
        rows = rows.withColumns({c: _digest(named(c), rows.schema[c].dataType) for c in digest})
        sides.append(
            rows.withColumns(
                {"__a": F.lit(int(side == "a")).cast("long"), "__e": F.lit(int(side == "e")).cast("long")}
            )
        )
    both = sides[0].unionByName(sides[1])
    keys = [named(c) for c in both.columns if c not in ("__a", "__e")]
    return both.groupBy(*keys).agg(F.sum("__a").alias("__a"), F.sum("__e").alias("__e"))


def difference(actual: DataFrame, expected: DataFrame, float_digits: int = FLOAT_DIGITS) -> DataFrame:
    """Rows with a different number of copies: ``n_actual`` against ``n_expected``."""
    rows = _counted(actual, expected, expected.columns, float_digits).where(F.col("__a") != F.col("__e"))
    return rows.select(
        *[named(c) for c in expected.columns], F.col("__a").alias("n_actual"), F.col("__e").alias("n_expected")
    )


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _list_text(values: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def summary_text(reason: Column, n_actual: Column, n_expected: Column, missing: str = "[]", extra: str = "[]") -> Column:
    """One line per verdict."""
    # Text of each reason.
    return (
        F.when(reason == "column_set", F.lit(f"column_set: missing={missing}  extra={extra}"))
        .when(reason == "empty_actual", F.lit("empty_actual: generated code produced an empty DataFrame"))
        .when(reason == "row_count", F.format_string("row_count: actual=%d expected=%d", n_actual, n_expected))
        .when(reason == "content", F.format_string("content: %d rows match in count but values/order differ", n_actual))
        .otherwise(reason)
    )


def _verdict(n_actual: Column, n_expected: Column, n_different: Column) -> Column:
    return (
        F.when(n_actual == 0, "empty_actual")
        .when(n_actual != n_expected, "row_count")
        .when(n_different > 0, "content")
        .otherwise("match")
    )


def compare(
    actual: DataFrame, expected: DataFrame, float_digits: int = FLOAT_DIGITS, previews: int = 0
) -> DataFrame:
    """One row that says whether two frames hold the same rows, and if not why.

    Column order and row order are ignored, copies count, floats are rounded and
    nulls equal nulls. An empty actual frame never matches, even an empty expected
    one. Everything is one lazy plan with a single shuffle of merged rows. With
    ``previews``, the first rows of both frames are added as text.
    """
    missing, extra = column_difference(actual.columns, expected.columns)
    if missing or extra:
        counts = (
            actual.select(F.lit(1).alias("a"), F.lit(0).alias("e"))
            .unionAll(expected.select(F.lit(0).alias("a"), F.lit(1).alias("e")))
            .agg(F.coalesce(F.sum("a"), F.lit(0)).alias("actual_n_rows"),
                 F.coalesce(F.sum("e"), F.lit(0)).alias("expected_n_rows"))
            .withColumn("reason", F.lit("column_set"))
        )
    else:
        counts = (
            _counted(actual, expected, expected.columns, float_digits, digest=expected.columns)
            .agg(
                F.coalesce(F.sum("__a"), F.lit(0)).alias("actual_n_rows"),
                F.coalesce(F.sum("__e"), F.lit(0)).alias("expected_n_rows"),
                F.count_if(F.col("__a") != F.col("__e")).alias("n_different"),
            )
            .withColumn("reason", _verdict(F.col("actual_n_rows"), F.col("expected_n_rows"), F.col("n_different")))
        )
    shown = {"actual_preview": actual, "expected_preview": expected} if previews else {}
    return counts.select(
        (F.col("reason") == "match").alias("match"),
        "reason",
        "actual_n_rows",
        "expected_n_rows",
        _texts(actual.columns).alias("actual_columns"),
        _texts(expected.columns).alias("expected_columns"),
        _texts(missing).alias("missing_columns"),
        _texts(extra).alias("extra_columns"),
        summary_text(
            F.col("reason"), F.col("actual_n_rows"), F.col("expected_n_rows"), _list_text(missing), _list_text(extra)
        ).alias("summary"),
        *[preview_text(df, previews).scalar().alias(name) for name, df in shown.items()],
    )


def judge(actual: DataFrame, expected: DataFrame, previews: int = 5, float_digits: int = FLOAT_DIGITS) -> dict:
    """The row of :func:`compare` with previews and, where only the content differs, a ``detail``
    that names the differing columns. Runs at once; the detail costs one more job."""
    verdict = compare(actual, expected, float_digits, previews).first().asDict()
    detail = None
    if verdict["reason"] == "content" and all(
        comparable(actual.schema[c].dataType, expected.schema[c].dataType) for c in expected.columns
    ):
        detail = detail_text(differing_columns(actual, expected, float_digits=float_digits)).first()["detail"]
    elif verdict["reason"] == "content":
        names = [
            c for c in expected.columns if not comparable(actual.schema[c].dataType, expected.schema[c].dataType)
        ]
        detail = f"columns of other types: {_list_text(names)}"
    return {**verdict, "detail": detail}


def compare_by(
    actual: DataFrame,
    expected: DataFrame,
    by: Sequence[str],
    float_digits: int = FLOAT_DIGITS,
    previews: int = 0,
    details: bool = False,
) -> DataFrame:
    """:func:`compare` for many results at once, one row per value of ``by``.

    Both frames hold the results of many runs, told apart by the ``by`` columns.
    Rows are merged per run and content before the shuffle, then counted per run
    with partials, so a run with a third of all rows is still spread out.

    With ``previews``, the first rows of each run on either side, as they sort, are added
    as text. With ``details``, a run of which only the content differs has a ``detail``
    that names the differing columns.
    """
    columns = [*by, *[c for c in expected.columns if c not in by]]
    missing, extra = column_difference(actual.columns, expected.columns)
    if missing or extra:
        raise ValueError(f"frames differ in columns: missing {missing}, extra {extra}")
    rest = [c for c in columns if c not in by]
    counts = (
        _counted(actual, expected, columns, float_digits, digest=rest)
        .groupBy(*map(named, by))
        .agg(
            F.sum("__a").alias("actual_n_rows"),
            F.sum("__e").alias("expected_n_rows"),
            F.count_if(F.col("__a") != F.col("__e")).alias("n_different"),
        )
        .withColumn("reason", _verdict(F.col("actual_n_rows"), F.col("expected_n_rows"), F.col("n_different")))
    )
    if details:
        counts = stage(counts, "verdicts")
    found = counts.select(
        *map(named, by),
        (F.col("reason") == "match").alias("match"),
        "reason",
        "actual_n_rows",
        "expected_n_rows",
        summary_text(F.col("reason"), F.col("actual_n_rows"), F.col("expected_n_rows")).alias("summary"),
    )
    more = {}
    if previews:
        more["actual_preview"] = _first_rows(actual.select(*map(named, columns)), by, previews)
        more["expected_preview"] = _first_rows(expected.select(*map(named, columns)), by, previews)
    if details:
        unlike = counts.where("reason = 'content'").select(group_key(by).alias("__of"))
        rows = _counted(actual, expected, columns, float_digits).withColumn("__of", group_key(by))
        rows = rows.join(unlike, "__of", "left_semi").drop("__of")
        more["detail"] = detail_text(_facing_rows(rows, by, rest, POSITIONS_PER_BLOCK), "of")
    for name, texts in more.items():
        texts = texts.toDF("__of", name)
        found = found.withColumn("__of", group_key(by)).join(texts, "__of", "left").drop("__of")
        if name != "detail":
            found = found.withColumn(name, F.coalesce(name, F.lit("<empty>")))
    return found


def _first_rows(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """(of, text): per group, its first ``n`` rows as they sort, a JSON object per line. Tasks pass on ``n`` rows of a
    group at most."""
    rest = [c for c in df.columns if c not in by]
    order = [F.asc_nulls_first(named(f.name)) for f in df.schema if f.name in rest and hashable(f.dataType)]
    place = F.row_number().over(Window.partitionBy(*map(named, by)).orderBy(*(order or [F.lit(0)])))
    line = F.to_json(F.struct(*map(named, rest)), {"ignoreNullFields": "false"})
    first = df.withColumn("__place", place).where(F.col("__place") <= n)
    lines = F.array_sort(F.collect_list(F.struct("__place", line.alias("line"))))
    texts = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return first.groupBy(*map(named, by)).agg(texts.alias("text")).select(group_key(by).alias("of"), "text")


def differing_columns(
    actual: DataFrame,
    expected: DataFrame,
    key: Sequence[str] | str | None = None,
    float_digits: int = FLOAT_DIGITS,
) -> DataFrame:
    """Per column, in how many rows the two frames differ.

    With ``key``, rows are paired by key; the key must identify a row on each
    side, and a key found on one side only counts for every column. Without it,
    both frames are sorted by all columns and paired by position.
    """
    columns = expected.columns
    if key is not None:
        keys = [key] if isinstance(key, str) else list(key)
        return _differing_by_key(actual, expected, keys, columns, float_digits)
    return _differing_by_position(actual, expected, columns, float_digits)


# Positions of one task where rows of the two frames do not stand side by side.
POSITIONS_PER_BLOCK = 16_384


def _differing_by_position(actual, expected, columns, digits, block: int = POSITIONS_PER_BLOCK) -> DataFrame:
    """Per column, at how many positions of the sorted frames the values differ."""
    return _facing_rows(_counted(actual, expected, columns, digits), [], columns, block)


def _facing_rows(counted: DataFrame, by: Sequence[str], columns: Sequence[str], block: int) -> DataFrame:
    """Both frames are sorted as one: equal rows of either side are merged with their number of copies and cut into
    sorted slices by one range shuffle.

    A distinct row then has an interval of positions on each side, its start being the copies before it. Rows whose
    two intervals are the same face themselves. The intervals of the others are cut at blocks of positions, and a
    sweep over the starts in a block meets every pair of rows that face each other. Values stand for themselves by a
    64-bit hash from the slices on.

    With ``by``, counts are per group. Groups must have as many rows on either side, so that they begin at the same
    positions and no row faces one of another group.
    """
    # Rows of types that cannot be equal are told apart by their side.
    side = ["__side"] if "__side" in counted.columns else []
    hashes = F.array(*[F.xxhash64(named(c), *side) for c in columns])
    order = [F.asc_nulls_first(named(c)) for c in [*by, *columns]]
    sliced = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    sliced = sliced.select(F.spark_partition_id().alias("slice"), "__a", "__e", hashes.alias("row"), group_key(by).alias("of"))
    schema = f"slice int, a bigint, n_a bigint, e bigint, n_e bigint, row array<bigint>, of {dict(sliced.dtypes)['of']}"
    sliced = stage(sliced.mapInArrow(_starts, schema), "slices")
    # One row per slice: what lies before it.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("slice").agg(F.sum("n_a").alias("n_a"), F.sum("n_e").alias("n_e"))
    totals = totals.select("slice", *[F.coalesce(F.sum(f"n_{s}").over(before), F.lit(0)).alias(f"more_{s}") for s in "ae"])
    placed = sliced.join(totals, "slice").select(
        (F.col("a") + F.col("more_a")).alias("a"), (F.col("e") + F.col("more_e")).alias("e"), "n_a", "n_e", "row", "of"
    )
    moved = placed.where((F.col("a") != F.col("e")) | (F.col("n_a") != F.col("n_e")))
    sides = []
    for side in "ae":
        start, end = F.col(side), F.col(side) + F.col(f"n_{side}")
        rows = moved.where(F.col(f"n_{side}") > 0).select(
            F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))).alias("block"),
            start.alias("start"), end.alias("end"), "row", "of",
        )
        first, last = F.greatest("start", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
        interval = F.struct(last.alias("end"), "row", "of")
        nothing = F.lit(None)
        sides.append(
            rows.select("block", first.alias("at"), *[(interval if s == side else nothing).alias(s) for s in "ae"])
        )
    # Two starts at one position are two events, the first of which lasts for no position.
    events = sides[0].unionByName(sides[1])
    in_block = Window.partitionBy("block").orderBy("at")
    held = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.select(
        "at",
        F.coalesce(F.lead("at").over(in_block), (F.col("block") + 1) * block).alias("next"),
        F.last("a", True).over(held).alias("a"),
        F.last("e", True).over(held).alias("e"),
    )
    until = {s: F.when(F.col(s).isNotNull(), F.least("next", F.col(s)["end"])).otherwise(0) for s in "ae"}
    covered = {s: F.greatest(end - F.col("at"), F.lit(0)) for s, end in until.items()}
    swept = swept.select(
        "a", "e", F.least(*covered.values()).alias("both"), F.greatest(*covered.values()).alias("either")
    )
    one_sided = F.sum(F.col("either") - F.col("both"))
    unlike = [
        F.sum(F.when(~F.get(F.col("a.row"), i).eqNullSafe(F.get(F.col("e.row"), i)), F.col("both")).otherwise(0))
        for i in range(len(columns))
    ]
    counts = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("position"), F.lit(c).alias("column"),
                F.coalesce(one_sided + n, F.lit(0)).alias("n_different"),
            )
            for i, (c, n) in enumerate(zip(columns, unlike), 1)
        ]
    )
    if not by:
        return swept.agg(counts.alias("counts")).select(F.inline("counts"))
    groups = swept.where("either > 0").groupBy(F.coalesce("a.of", "e.of").alias("of")).agg(counts.alias("counts"))
    return groups.select("of", F.inline("counts"))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted slice with the copies before them on either side."""
    so_far = {"__a": 0, "__e": 0}
    for batch in batches:
        made = {"slice": batch.column("slice")}
        for side, name in (("__a", "a"), ("__e", "e")):
            copies = batch.column(side).to_numpy(zero_copy_only=False)
            made[name] = pa.array(so_far[side] + np.cumsum(copies) - copies)
            made[f"n_{name}"] = batch.column(side)
            so_far[side] += int(copies.sum())
        yield pa.RecordBatch.from_pydict({**made, "row": batch.column("row"), "of": batch.column("of")})


def _differing_by_key(actual, expected, keys, columns, digits) -> DataFrame:
    sides = []
    for frame, side in ((actual, "a"), (expected, "e")):
        rows = normalise(frame.select(*[named(c) for c in columns]), digits)
        row = F.struct(*[named(c) for c in columns])
        nothing = F.lit(None)
        sides.append(
            rows.select(
                F.struct(*[named(c) for c in keys]).alias("__key"),
                (row if side == "a" else nothing).alias("__a"),
                (row if side == "e" else nothing).alias("__e"),
            )
        )
    grouped = (
        sides[0].unionByName(sides[1])
        .groupBy("__key")
        .agg(
            F.any_value("__a", True).alias("__a"),
            F.any_value("__e", True).alias("__e"),
            F.greatest(F.count("__a"), F.count("__e")).alias("__copies"),
        )
        .where(F.assert_true(F.col("__copies") <= 1, F.lit("the key does not identify a row")).isNull())
    )
    return _count_differences(grouped, columns)


def _count_differences(paired: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn pairs of rows ``__a`` and ``__e`` into one row per column with a count."""
    unequal = [
        (~F.col("__a")[c].eqNullSafe(F.col("__e")[c])) | F.col("__a").isNull() | F.col("__e").isNull()
        for c in columns
    ]
    counts = paired.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).cast("long").alias("position"), F.lit(c).alias("column"),
                    F.count_if(u).alias("n_different"),
                )
                for i, (c, u) in enumerate(zip(columns, unequal), 1)
            ]
        ).alias("counts")
    )
    return counts.select(F.inline("counts"))


def detail_text(differences: DataFrame, by: str | None = None) -> DataFrame:
    """One line that names the differing columns, in their order; empty if none differ. With ``by``, a line for each
    value of that column with a difference."""
    named = differences.where(F.col("n_different") > 0)
    in_order = F.sort_array(F.collect_list(F.struct("position", "column")))
    joined = F.array_join(F.transform(in_order, lambda c: F.concat(F.lit("'"), c["column"], F.lit("'"))), ", ")
    return named.groupBy(*([by] if by else [])).agg(
        F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("columns with differing values: ["), joined, F.lit("]")))
        .otherwise("")
        .alias("detail")
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows."""
    return df.limit(n)


def preview_text(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows as one text, a JSON object per line; ``<empty>`` if there are none."""
    lines = preview(df, n).select(
        F.to_json(F.struct(*[named(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("line")
    )
    text = F.array_join(F.collect_list("line"), "\n")
    return lines.agg(F.when(F.count(F.lit(1)) > 0, text).otherwise("<empty>").alias("text"))
