"""Texts rendered from schema columns.

A record's tables are one array column of ``struct<table, n_rows, columns:
array<struct<name, dtype>>>`` (:data:`frameops.functions.types.TABLES_TYPE`), bounded by
the record itself. Nothing is grouped or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Style:
    """How a schema block is laid out."""

    header: str
    bullet: str
    gap: str
    zero_rows: bool


# The layouts in use.
STYLES = {
    "chat": Style("Datasets:", "- ", " ", True),
    "plan": Style("Datasets:", "- ", " ", False),
    "checked": Style("Datasets:", "  ", "  ", False),
    "plain": Style("", "- ", "  ", True),
}


def schema_block(tables: Column, style: str = "chat") -> Column:
    """Header, then per table its name and row count and a line per column."""
    look = STYLES[style]

    def lines(table: Column) -> Column:
        shown = table["n_rows"].isNotNull()
        if not look.zero_rows:
            shown = shown & (table["n_rows"] != 0)
        rows = F.when(shown, F.concat(F.lit(f"{look.gap}("), table["n_rows"].cast("string"), F.lit(" rows)")))
        title = F.concat(F.lit(look.bullet), table["table"], F.coalesce(rows, F.lit("")))
        columns = F.transform(
            table["columns"], lambda c: F.concat(F.lit("    "), c["name"], F.lit(": "), c["dtype"])
        )
        return F.concat(F.array(title), columns)

    header = F.array(F.lit(look.header)) if look.header else F.array().cast("array<string>")
    return F.array_join(F.concat(header, F.flatten(F.transform(tables, lines))), "\n")


def column_reminder(tables: Column) -> Column:
    """One line per table that has columns; empty if there is none."""
    filled = F.filter(tables, lambda t: F.size(t["columns"]) > 0)
    lines = F.transform(
        filled,
        lambda t: F.concat(
            F.lit("  "), t["table"], F.lit(": "), F.array_join(F.transform(t["columns"], lambda c: c["name"]), ", ")
        ),
    )
    # Fixed value: the line above the list.
    header = "Available columns (any reference to a name NOT in this list will fail with ColumnNotFoundError):\n"
    return F.when(F.size(filled) > 0, F.concat(F.lit(header), F.array_join(lines, "\n"))).otherwise("")


def user_turn(tables: Column, question: Column, strict: bool = False, style: str = "chat") -> Column:
    """Schema block and question; ``strict`` adds the column reminder below."""
    turn = F.concat(schema_block(tables, style), F.lit("\n\nQuestion: "), question)
    if not strict:
        return turn
    reminder = column_reminder(tables)
    return F.concat(turn, F.when(reminder != "", F.concat(F.lit("\n\n"), reminder)).otherwise(""))


def plain_user_turn(tables: Column, question: Column, expected_columns: Column | None = None) -> Column:
    """Plain schema block and question, then the wanted output columns if there are any."""
    # The text around the parts.
    turn = F.concat(F.lit("Schema:\n"), schema_block(tables, "plain"), F.lit("\n\nQuestion: "), question)
    if expected_columns is None:
        return turn
    quoted = F.transform(expected_columns, lambda c: F.concat(F.lit('"'), c, F.lit('"')))
    wanted = F.concat(
        F.lit("\n\nExpected output columns (use these exact names, via .alias() when needed): ["),
        F.array_join(quoted, ", "),
        F.lit("]"),
    )
    return F.concat(turn, F.when(F.size(expected_columns) > 0, wanted).otherwise(""))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(system: str, examples: Sequence[tuple[str, str]], turn: Column) -> Column:
    """Message list: system text, example pairs, the user's turn."""
    fixed = [message("system", F.lit(system))]
    for question, answer in examples:
        fixed += [message("user", F.lit(question)), message("assistant", F.lit(answer))]
    return F.array(*fixed, message("user", turn))


def repair_messages(messages: Column, previous: Column, request: Column) -> Column:
    """Message list for another attempt: the earlier answer, then the request to fix it."""
    return F.concat(
        messages,
        F.array(message("assistant", F.coalesce(previous, F.lit(""))), message("user", request)),
    )


def schema_names(tables: Column) -> Column:
    """Struct of the sorted distinct ``tables`` and ``columns``; an error if either is empty."""
    table_names = F.array_sort(F.array_distinct(F.transform(tables, lambda t: t["table"])))
    columns = F.array_sort(
        F.array_distinct(F.flatten(F.transform(tables, lambda t: F.transform(t["columns"], lambda c: c["name"]))))
    )
    return F.struct(
        _not_empty(table_names, "no tables in the schema").alias("tables"),
        _not_empty(columns, "no columns found across the tables").alias("columns"),
    )


def _not_empty(names: Column, complaint: str) -> Column:
    return F.when(F.size(names) > 0, names).otherwise(F.raise_error(F.lit(complaint)))
