"""Column expressions over a table of plan texts: extraction, validation, name repair.

They use no grouping and no shuffle, so they also run on a streaming DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.scalar import let
from frameops.plans.run import FALSE_WORDS, TRUE_WORDS

# What a plan may contain.
COMPARE_OPS = ("==", "!=", "<", "<=", ">", ">=")
COMBINES = ("and", "or")
AGGREGATIONS = ("sum", "mean", "min", "max", "len", "n_unique", "first", "last")
JOIN_KINDS = ("inner", "left", "outer")
RANK_METHODS = ("dense", "ordinal", "average", "min", "max")
TRUTH_TEXTS = (*TRUE_WORDS, *FALSE_WORDS)

# Flags and counts stay as written until they are read by the rules of validation.
_WRITTEN_TYPE = (
    "source_table string, operations array<struct<type: string,"
    " conditions: array<struct<column: string, op: string, value: variant>>, combine: string,"
    " columns: array<variant>, aggregations: array<struct<agg: string, column: string, alias: string>>,"
    " table: string, on: string, left_on: string, right_on: string, how: string,"
    " expressions: array<struct<column: string, expr: string, method: string, descending: variant,"
    " over: string, alias: string>>, n: variant>>"
)


def balanced_prefix(column: Column, opening: str, closing: str) -> Column:
    """Text up to the bracket that closes the first one; null if none does.

    Depth counting is no regular language, so this one step runs in Python, over
    Arrow batches; rows that do not need it should be passed as null.
    """
    brackets = re.compile(f"[{re.escape(opening + closing)}]")

    def cut(text):
        depth = 0
        for bracket in brackets.finditer(text) if text is not None else ():
            depth += 1 if bracket.group() == opening else -1
            if depth == 0:
                return text[: bracket.end()]
        return None

    @F.pandas_udf(T.StringType())
    def prefix(texts: pd.Series) -> pd.Series:
        return texts.map(cut, na_action="ignore")

    return prefix(column)


def extract_block(text: Column) -> Column:
    """First ``{...}`` block of free text: the rest of the text if it is never
    closed, the text itself if none is opened. Braces inside strings count too."""
    start = F.instr(text, "{")
    rest = F.when(start > 0, F.substring(text, start, F.char_length(text)))
    return F.coalesce(balanced_prefix(rest, "{", "}"), rest, text)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("ABSENT"))


def _is_text(value: Column) -> Column:
    return _kind(value) == "STRING"


def _is_number(value: Column) -> Column:
    return _kind(value).rlike(r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")


def _text(name: str, required: bool = True) -> Callable[[Column], Column]:
    def check(value: Column) -> Column:
        item = _field(value, name)
        return _is_text(item) if required else _kind(item).isin("STRING", "ABSENT")

    return check


def _choice(name: str, options: Sequence[str], required: bool = True) -> Callable[[Column], Column]:
    def check(value: Column) -> Column:
        chosen = _is_text(_field(value, name)) & F.coalesce(
            F.try_variant_get(value, f"$.{name}", "string").isin(*options), F.lit(False)
        )
        return chosen if required else chosen | (_kind(_field(value, name)) == "ABSENT")

    return check


def _flag(name: str) -> Callable[[Column], Column]:
    """An optional truth value, also accepted as 0 / 1 or as a word."""

    def check(value: Column) -> Column:
        item = F.lower(F.try_variant_get(value, f"$.{name}", "string"))
        return _kind(_field(value, name)).isin("BOOLEAN", "ABSENT") | F.coalesce(
            item.isin(*TRUTH_TEXTS), F.lit(False)
        )

    return check


def _whole(name: str) -> Callable[[Column], Column]:
    def check(value: Column) -> Column:
        number = F.try_variant_get(value, f"$.{name}", "string")
        return (_is_number(_field(value, name)) | _is_text(_field(value, name))) & F.coalesce(
            number.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.lit(False)
        )

    return check


def _literal(name: str) -> Callable[[Column], Column]:
    def check(value: Column) -> Column:
        item = _field(value, name)
        return _is_text(item) | _is_number(item) | (_kind(item) == "BOOLEAN")

    return check


def _list(name: str, *checks: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def check(value: Column) -> Column:
        items = F.try_variant_get(value, f"$.{name}", "array<variant>")
        return F.coalesce(F.forall(items, lambda item: _all(checks, item)), F.lit(False))

    return check


def _all(checks: Sequence[Callable[[Column], Column]], value: Column) -> Column:
    verdict = F.lit(True)
    for check in checks:
        verdict = verdict & check(value)
    return verdict


# Required and optional fields of each operation.
_OPERATION_CHECKS = {
    "filter": (
        _list("conditions", _text("column"), _choice("op", COMPARE_OPS), _literal("value")),
        _choice("combine", COMBINES, required=False),
    ),
    "group_by": (
        _list("columns", _is_text),
        _list("aggregations", _choice("agg", AGGREGATIONS), _text("column"), _text("alias")),
    ),
    "sort": (_list("columns", _text("name"), _flag("descending")),),
    "select": (_list("columns", _is_text),),
    "join": (
        _text("table"), _text("on", False), _text("left_on", False), _text("right_on", False),
        _choice("how", JOIN_KINDS, required=False),
    ),
    "with_columns": (
        _list(
            "expressions", _text("column"), _choice("expr", ("rank",)),
            _choice("method", RANK_METHODS, required=False), _flag("descending"),
            _text("over", False), _text("alias"),
        ),
    ),
    "head": (_whole("n"),),
}


def _operation_ok(operation: Column) -> Column:
    def check(kind: Column) -> Column:
        (first, checks), *others = _OPERATION_CHECKS.items()
        verdict = F.when(kind == first, _all(checks, operation))
        for name, checks in others:
            verdict = verdict.when(kind == name, _all(checks, operation))
        return verdict.otherwise(False)

    return let(F.try_variant_get(operation, "$.type", "string"), check)


def plan_problem(text: Column) -> Column:
    """What is wrong with a plan text, or null if it is a valid plan:
    ``malformed``, ``source_table``, ``operations`` or ``operation <n>``."""

    def first_bad(verdicts: Column) -> Column:
        return F.when(
            F.array_contains(verdicts, False),
            F.concat(F.lit("operation "), F.array_position(verdicts, False).cast("string")),
        )

    def judge(plan: Column) -> Column:
        operations = F.try_variant_get(plan, "$.operations", "array<variant>")
        return (
            F.when(plan.isNull(), "malformed")
            .when(~_is_text(_field(plan, "source_table")), "source_table")
            .otherwise(
                let(
                    F.transform(operations, _operation_ok),
                    lambda verdicts: F.when(verdicts.isNull(), "operations").otherwise(first_bad(verdicts)),
                )
            )
        )

    return let(F.try_parse_json(text), judge)


def plan_valid(text: Column) -> Column:
    return plan_problem(text).isNull()


def _flag_value(written: Column) -> Column:
    word = F.lower(F.try_variant_get(written, "$", "string"))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def _whole_value(written: Column) -> Column:
    digits = F.regexp_extract(F.try_variant_get(written, "$", "string"), r"^\s*([+-]?\d+)(\.0*)?\s*$", 1)
    return digits.try_cast("bigint")


def _sort_column(name: Column, flag: Column) -> Column:
    return F.to_variant_object(F.struct(name.alias("name"), F.coalesce(flag, F.lit(False)).alias("descending")))


def parse_plan(text: Column) -> Column:
    """The plan as a struct; fields that an operation lacks are null.

    Flags and counts written as text or number become truth values and whole numbers, as
    validation reads them.
    """

    def column_as_read(column: Column) -> Column:
        written = _field(column, "descending")
        as_read = _sort_column(F.try_variant_get(column, "$.name", "string"), _flag_value(written))
        return F.when(~_kind(written).isin("BOOLEAN", "ABSENT"), as_read).otherwise(column)

    def as_read(operation: Column) -> Column:
        kind = operation["type"]
        columns, expressions = operation["columns"], operation["expressions"]
        return _changed(
            operation,
            columns=F.when(kind == "sort", F.transform(columns, column_as_read)).otherwise(columns),
            expressions=F.transform(
                expressions, lambda e: _changed(e, _EXPRESSION_FIELDS, descending=_flag_value(e["descending"]))
            ),
            n=_whole_value(operation["n"]),
        )

    plan = F.from_json(text, _WRITTEN_TYPE)
    return let(
        plan,
        lambda p: F.when(
            p.isNotNull(),
            F.struct(
                p["source_table"].alias("source_table"), F.transform(p["operations"], as_read).alias("operations")
            ),
        ),
    )


# Fields of a parsed operation and of an expression in it.
_OPERATION_FIELDS = (
    "type", "conditions", "combine", "columns", "aggregations", "table", "on", "left_on", "right_on", "how",
    "expressions", "n",
)
_EXPRESSION_FIELDS = ("column", "expr", "method", "descending", "over", "alias")


def _changed(item: Column, fields: Sequence[str] = _OPERATION_FIELDS, **new: Column) -> Column:
    """A struct with some fields replaced, built once; null stays null."""
    built = F.struct(*[new.get(f, item[f]).alias(f) for f in fields])
    return F.when(item.isNotNull(), built)


def _repair(name: Column, valid: Column) -> Column:
    underscored = F.replace(name, F.lit(" "), F.lit("_"))
    return F.when(
        F.contains(name, F.lit(" ")) & ~F.array_contains(valid, name) & F.array_contains(valid, underscored),
        underscored,
    ).otherwise(name)


def repair_plan(plan: Column, valid: Column) -> Column:
    """A parsed plan with repairable column names replaced, as in
    :func:`frameops.plans.run.repair_names`, given the array of known names."""

    def fixed_items(items: Column, fields: Sequence[str]) -> Column:
        return F.transform(items, lambda item: _changed(item, fields, column=_repair(item["column"], valid)))

    def fix_column(item: Column) -> Column:
        # Sort columns are objects, the others bare names; names that stay are not rewritten.
        object_name = F.try_variant_get(item, "$.name", "string")

        def rewrite(name: Column) -> Column:
            repaired = _repair(name, valid)
            as_object = _sort_column(repaired, F.try_variant_get(item, "$.descending", "boolean"))
            return (
                F.when(name == repaired, item)
                .when(object_name.isNotNull(), as_object)
                .otherwise(repaired.cast("variant"))
            )

        return let(F.coalesce(object_name, F.try_variant_get(item, "$", "string")), rewrite)

    def fix(operation: Column) -> Column:
        kind = operation["type"]

        def where(kinds: Sequence[str], items: str, fixed: Column) -> Column:
            return F.when(kind.isin(*kinds), fixed).otherwise(operation[items])

        return _changed(
            operation,
            conditions=where(
                ["filter"], "conditions", fixed_items(operation["conditions"], ("column", "op", "value"))
            ),
            columns=where(
                ["group_by", "sort", "select"], "columns", F.transform(operation["columns"], fix_column)
            ),
            aggregations=where(
                ["group_by"], "aggregations", fixed_items(operation["aggregations"], ("agg", "column", "alias"))
            ),
            expressions=where(
                ["with_columns"], "expressions", fixed_items(operation["expressions"], _EXPRESSION_FIELDS)
            ),
        )

    return _changed(
        plan, ("source_table", "operations"), operations=F.transform(plan["operations"], fix)
    )


def referenced_columns(plan: Column) -> Column:
    """Column names a parsed plan mentions, in order, operation by operation."""

    def of(operation: Column) -> Column:
        empty = F.array().cast("array<string>")
        columns = F.transform(
            operation["columns"],
            lambda c: F.coalesce(F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$", "string")),
        )
        return F.concat(
            F.coalesce(F.transform(operation["conditions"], lambda c: c["column"]), empty),
            F.coalesce(columns, empty),
            F.coalesce(F.transform(operation["aggregations"], lambda c: c["column"]), empty),
            F.coalesce(F.transform(operation["expressions"], lambda c: c["column"]), empty),
        )

    return F.flatten(F.transform(plan["operations"], of))
