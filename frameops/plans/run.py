"""Run a declarative plan: a fold of DataFrame operators over a source table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.functions.aggregates import AGGREGATES, agg_len
from frameops.functions.ordering import order_key
from frameops.functions.scalar import named
from frameops.operators.frame import filter_all, group_agg, head, sort, top_k
from frameops.operators.joins import join
from frameops.operators.ranking import rank

# Where each operation keeps the column names that may be repaired,
# as (list field, name field); None means the list holds the names themselves.
NAME_FIELDS = {
    "filter": (("conditions", "column"),),
    "group_by": (("columns", None), ("aggregations", "column")),
    "sort": (("columns", "name"),),
    "select": (("columns", None),),
    "with_columns": (("expressions", "column"),),
}


def repair_name(name: str, valid: Sequence[str]) -> str:
    """``name`` with spaces as underscores if only that makes it a known column."""
    underscored = name.replace(" ", "_")
    return underscored if name not in valid and underscored in valid else name


def repair_names(plan: Mapping, valid: Sequence[str]) -> dict:
    """The plan with repairable column names replaced; join keys stay as they are."""
    known = set(valid)
    operations = []
    for operation in plan["operations"]:
        fixed = dict(operation)
        for items, key in NAME_FIELDS.get(operation["type"], ()):
            fixed[items] = [
                repair_name(item, known) if key is None else {**item, key: repair_name(item[key], known)}
                for item in operation[items]
            ]
        operations.append(fixed)
    return {**plan, "operations": operations}


# Words that count as true and false where a flag is written as text or number.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


def as_flag(value: object) -> bool:
    """A truth value, also written as 0 / 1 or as a word."""
    word = str(int(value) if isinstance(value, float) and value.is_integer() else value).strip().lower()
    if word in TRUE_WORDS or word in FALSE_WORDS:
        return word in TRUE_WORDS
    raise ValueError(f"not a truth value: {value!r}")


def as_whole(value: object) -> int:
    """A whole number, also written as ``3.0`` or as text."""
    number = float(value)
    if isinstance(value, bool) or not number.is_integer():
        raise ValueError(f"not a whole number: {value!r}")
    return int(value) if isinstance(value, int) else int(number)


def coerce_plan(plan: Mapping) -> dict:
    """The plan with flags and counts as truth values and whole numbers, as validation reads them."""

    def flagged(item: object) -> object:
        if isinstance(item, Mapping) and "descending" in item:
            return {**item, "descending": as_flag(item["descending"])}
        return item

    operations = []
    for operation in plan["operations"]:
        fixed = dict(operation)
        if fixed["type"] == "head":
            fixed["n"] = as_whole(fixed["n"])
        for items in {"sort": ("columns",), "with_columns": ("expressions",)}.get(fixed["type"], ()):
            fixed[items] = [flagged(item) for item in fixed[items]]
        operations.append(fixed)
    return {**plan, "operations": operations}


def join_keys(on: str = "", left_on: str = "", right_on: str = "") -> dict[str, str]:
    """Join arguments of a plan; ``on`` may be written ``"left == right"``."""
    shared = on.strip()
    if left_on or right_on:
        return {"on": shared} if shared else {"left_on": left_on, "right_on": right_on}
    if "==" in shared:
        left, _, right = shared.partition("==")
        return {"left_on": left.strip(), "right_on": right.strip()}
    return {"on": shared}


@dataclass
class _State:
    """The frame so far, and the order its rows were last sorted in."""

    df: DataFrame
    tables: Mapping[str, DataFrame]
    order: list[tuple[str, bool]] = field(default_factory=list)


def _aggregation(spec: Mapping, state: _State) -> Column:
    kind, column = spec["agg"], spec["column"]
    if kind == "len" or column == "*":
        return agg_len()
    if kind in ("first", "last"):
        return _at_end(column, kind == "first", state)
    return AGGREGATES[kind](named(column))


def _at_end(column: str, first: bool, state: _State) -> Column:
    """First or last value by the order of the preceding sort (nulls first): one aggregate, with partials per task."""
    value = named(column)
    types = {f.name: f.dataType for f in state.df.schema}
    if lost := [n for n, _ in state.order if n not in types]:
        raise ValueError(f"first and last need the columns that the rows are sorted by: {', '.join(lost)}")
    if not any(descending for _, descending in state.order):
        key = F.struct(*[named(n) for n, _ in state.order])
    else:
        key = order_key([(named(n), types[n], descending) for n, descending in state.order])
    return F.min_by(value, key) if first else F.max_by(value, key)


def _filter(state: _State, op: Mapping) -> DataFrame:
    conditions = [(c["column"], c["op"], c["value"]) for c in op["conditions"]]
    return filter_all(state.df, conditions, op.get("combine", "and"))


def _group_by(state: _State, op: Mapping) -> DataFrame:
    keys, wanted = op["columns"], op["aggregations"]
    if not state.order and any(a["agg"] in ("first", "last") and a["column"] != "*" for a in wanted):
        raise ValueError("first and last need a preceding sort")
    return group_agg(state.df, keys, **{a["alias"]: _aggregation(a, state) for a in wanted})


def _join(state: _State, op: Mapping) -> DataFrame:
    keys = join_keys(op.get("on", ""), op.get("left_on", ""), op.get("right_on", ""))
    return join(state.df, state.tables[op["table"]], how=op.get("how", "inner"), **keys)


def _with_columns(state: _State, op: Mapping) -> DataFrame:
    """Ranks of the input columns; they are named last so that none sees another."""
    df = state.df
    pending = {}
    for i, spec in enumerate(op["expressions"]):
        if spec["expr"] != "rank":
            raise ValueError(f"unknown expression {spec['expr']!r}")
        pending[f"__plan_{i}"] = spec["alias"]
        df = rank(
            df, spec["column"], spec.get("method", "dense"), spec.get("descending", True),
            spec.get("over") or None, f"__plan_{i}",
        )
    kept = [named(c) for c in state.df.columns if c not in pending.values()]
    return df.select(*kept, *[F.col(c).alias(alias) for c, alias in pending.items()])


def _head(state: _State, n: int) -> DataFrame:
    """The first rows by the order of the last sort, which later operations have kept."""
    if not state.order:
        return head(state.df, n)
    names = [name for name, _ in state.order]
    if lost := [name for name in names if name not in state.df.columns]:
        raise ValueError(f"head needs the columns that the rows are sorted by: {', '.join(lost)}")
    return top_k(state.df, names, n, [descending for _, descending in state.order])


_OPERATIONS = {
    "filter": _filter,
    "group_by": _group_by,
    "select": lambda state, op: state.df.select(*[named(c) for c in op["columns"]]),
    "join": _join,
    "with_columns": _with_columns,
    "head": lambda state, op: _head(state, max(1, op["n"])),
}


def run_plan(plan: Mapping | str, tables: Mapping[str, DataFrame], repair: bool = True) -> DataFrame:
    """The frame a plan describes. All of it is lazy but a rank, which may write slices while the plan is built.

    ``plan`` is a mapping or its JSON text: ``source_table`` and ``operations`` of
    type filter, group_by, sort, select, join, with_columns or head. A head after a sort is a
    top-k by the sort's columns, also with filters, ranks, inner and left joins in between; if
    those columns are gone by then it is an error. Flags and counts may be written as text.
    """
    if isinstance(plan, str):
        plan = json.loads(plan)
    if repair:
        plan = repair_names(plan, [c for t in tables.values() for c in t.columns])
    operations = coerce_plan(plan)["operations"]
    state = _State(tables[plan["source_table"]], tables)
    skip = False
    for op, following in zip(operations, [*operations[1:], None]):
        if skip:
            skip = False
            continue
        if op["type"] == "sort":
            names = [c["name"] for c in op["columns"]]
            flags = [c.get("descending", False) for c in op["columns"]]
            state.order = list(zip(names, flags))
            skip = following is not None and following["type"] == "head"
            if skip:
                state.df = top_k(state.df, names, max(1, following["n"]), flags)
            else:
                state.df = sort(state.df, names, flags)
        elif op["type"] in _OPERATIONS:
            state.df = _OPERATIONS[op["type"]](state, op)
            if op["type"] == "group_by" or (op["type"] == "join" and op.get("how", "inner") == "outer"):
                state.order = []
        else:
            raise ValueError(f"unknown operation {op['type']!r}")
    return state.df
