"""Triage of execution error texts."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.functions.scalar import let

# Patterns that find the missing and the valid column names.
MISSING_COLUMN = r'(?i)unable to find column\s+"([^"]+)"'
VALID_COLUMNS = r"(?i)valid columns?:\s*\[([^\]]+)\]"

# Error names in order of precedence, with the characters kept of the message.
ERROR_CLASSES = (
    ("DuplicateError", 200),
    ("ColumnNotFoundError", 200),
    ("SchemaError", 250),
    ("AttributeError", 250),
)
OTHER_LENGTH = 400


def error_class(message: Column) -> Column:
    """``empty``, ``missing_column`` (names it and the valid ones), an error name or ``other``."""
    listed = message.rlike(MISSING_COLUMN) & message.rlike(VALID_COLUMNS)
    chain = F.when(F.coalesce(message, F.lit("")) == "", "empty").when(listed, "missing_column")
    for name, _ in ERROR_CLASSES:
        chain = chain.when(message.contains(name), name)
    return chain.otherwise("other")


EXCERPTS = {**dict(ERROR_CLASSES), "other": OTHER_LENGTH}


def triage(message: Column, lengths: Mapping[str, int] = MappingProxyType({})) -> Column:
    """Struct of ``error_class``, ``missing_column``, ``valid_columns``, ``message`` and ``excerpt``.

    The message is whole. The excerpt, for display, is as many characters of it as ``lengths`` has for its class
    (``EXCERPTS``: the usual ones), or all; null for the classes that are told by what was extracted.
    """

    def parts(kind: Column) -> Column:
        named = kind == "missing_column"
        length = F.when(kind.isin(*EXCERPTS), F.char_length(message))
        for name, characters in lengths.items():
            length = F.when(kind == name, characters).otherwise(length)
        return F.struct(
            kind.alias("error_class"),
            F.when(named, F.regexp_extract(message, MISSING_COLUMN, 1)).alias("missing_column"),
            F.when(named, F.regexp_extract(message, VALID_COLUMNS, 1)).alias("valid_columns"),
            message.alias("message"),
            F.substring(message, F.lit(1), length).alias("excerpt"),
        )

    return let(error_class(message), parts)


def class_counts(df: DataFrame, message: str = "error") -> DataFrame:
    """Number of messages per class."""
    return df.groupBy(error_class(F.col(message)).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))
