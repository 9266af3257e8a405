"""Screening generated code: cleaning, pattern checks, verdicts, choice of a candidate.

All checks are column expressions; only bracket depth and Python syntax, which no
regular expression can decide, run in Python over Arrow batches.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.scalar import let
from frameops.plans.batch import balanced_prefix

# White space as Python's str.strip() sees it.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Label and pattern of each misused call, in the order they are reported.
ANTI_PATTERNS = (
    ("used `.with_column(` (singular) — use `.with_columns(` instead",
     r"\.with_column\s*\("),
    ("used `pl.desc(` — it does not exist, use `.sort(col, descending=True)`",
     r"\bpl\.desc\s*\("),
    ("used `.dense(` — use `.rank(method=\"dense\")` instead",
     r"\.dense\s*\("),
    ("accessed `df.len` as an attribute — use `df.height` or `pl.len()`",
     r"\.len\b(?!\s*\()"),
    ("used pandas-style `groupby(` — use `group_by(` (underscore) in Polars",
     r"\bgroupby\s*\("),
    ("called `.contains(` on an Expr — use `.str.contains(` for strings",
     r"(?<!\.str)\.contains\s*\("),
    ("used boolean indexing `df[...>...]` — use `df.filter(pl.col(...) > ...)`",
     r"\[\s*\w+\s*\[\s*\""),
)

# How code names a column and an alias.
COLUMN_REFERENCE = r'pl\.col\s*\(\s*"([^"]+)"\s*\)'
ALIAS = r'\.alias\s*\(\s*"([^"]+)"\s*\)'

# Candidate levels from most to least preferred, and without validation.
LEVELS = ("fast", "constrained", "retry")
UNCHECKED_LEVELS = ("constrained", "fast", "retry")


def strip(text: Column) -> Column:
    """Trim white space at both ends; only the ends of the text are looked at."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_code_fence(text: Column) -> Column:
    """Drop a leading ```` ```python ```` or ```` ``` ```` and a trailing ```` ``` ````."""
    opened = strip(F.regexp_replace(strip(text), r"^```(?:python)?", ""))
    return strip(F.regexp_replace(opened, r"```\z", ""))


def final_assignment(code: Column) -> Column:
    """The last ``result =`` with its parenthesised value, or with the rest of the
    text if the value is not in parentheses or they are never closed."""
    marker = "result ="
    after = F.substring_index(code, marker, -1)
    value = F.ltrim(after, F.lit(WHITE_SPACE))
    closed = balanced_prefix(F.when(F.instr(code, marker) > 0, F.when(value.startswith("("), value)), "(", ")")
    return (
        F.when(F.instr(code, marker) == 0, code)
        .when(closed.isNotNull(), F.concat(F.lit("result = "), closed))
        .otherwise(F.concat(F.lit(marker), after))
    )


def anti_patterns(code: Column) -> Column:
    """Labels of all misused calls found in the code."""
    hits = F.array(*[F.when(code.rlike(pattern), F.lit(label)) for label, pattern in ANTI_PATTERNS])
    return F.coalesce(F.filter(hits, lambda hit: hit.isNotNull()), F.array().cast("array<string>"))


def unknown_column(code: Column, columns: Column) -> Column:
    """First referenced column that is neither known nor an alias anywhere in the
    code; null if there is none or if nothing is known to check against."""
    used = F.regexp_extract_all(code, F.lit(COLUMN_REFERENCE), F.lit(1))

    def first_stray(known: Column) -> Column:
        strays = F.filter(used, lambda name: ~F.array_contains(known, name))
        return F.when(F.size(known) > 0, F.get(strays, F.lit(0)))

    return let(F.array_union(columns, F.regexp_extract_all(code, F.lit(ALIAS), F.lit(1))), first_stray)


@F.pandas_udf(T.StringType())
def syntax_error(code: pd.Series) -> pd.Series:
    """Message of the Python syntax error in each text, null where it parses."""

    def check(text):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        except SyntaxError as error:
            return error.msg
        except (ValueError, RecursionError, MemoryError) as error:
            return str(error) or type(error).__name__
        return None

    return code.map(check, na_action="ignore")


def verdict(code: Column, columns: Column, error: Column) -> Column:
    """``ok`` or the first reason to reject the code. ``error`` is its syntax error."""
    misused = F.coalesce(*[F.when(code.rlike(pattern), F.lit(label)) for label, pattern in ANTI_PATTERNS])
    stray = unknown_column(code, columns)
    return (
        F.when(F.coalesce(strip(code) == "", F.lit(True)), "empty")
        .when(error.isNotNull(), F.concat(F.lit("syntax_error: "), error))
        .when(~(code.contains("result =") | code.contains("result=")), "missing_result_assignment")
        # The concatenations are null, and skipped, where nothing was found.
        .otherwise(
            F.coalesce(
                F.concat(F.lit("hallucinated_api: "), misused),
                F.concat(F.lit("unknown_column: '"), stray, F.lit("'")),
                F.lit("ok"),
            )
        )
    )


def screen(df: DataFrame, code: str = "code", columns: str = "valid_columns") -> DataFrame:
    """Add ``reason`` (the verdict) and ``ok`` to a table of code."""
    written = F.when(strip(F.col(code)) != "", F.col(code))
    checked = df.withColumn("__syntax", syntax_error(written))
    judged = checked.withColumn("reason", verdict(F.col(code), F.col(columns), F.col("__syntax")))
    return judged.withColumn("ok", F.col("reason") == "ok").drop("__syntax")


def default_code(tables: Column) -> Column:
    """The code to fall back on: the first table, given the nested tables array."""
    first = F.get(tables, F.lit(0))["table"]
    return F.when(first.isNotNull(), F.concat(F.lit("result = "), first)).otherwise("result = None")


def choose_candidates(candidates: DataFrame, key: str = "id", default: str = "default_code") -> DataFrame:
    """One code per record: the first valid candidate, else the default.

    ``candidates`` has one row per record and level with ``level``, ``code``, ``ok``,
    ``reason`` and the record's ``default``. The choice is an aggregate with map-side
    partials, so no record's candidates are gathered.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    usable = F.col("ok") & (place > 0)
    first = F.col("level") == LEVELS[0]
    chosen = candidates.groupBy(key).agg(
        F.min_by(
            F.when(usable, F.struct("code", "level", F.lit("ok").alias("reason"))), F.when(usable, place)
        ).alias("best"),
        F.max(F.when(first, F.col("code"))).alias("l1_code"),
        F.max(F.when(first, F.col("reason"))).alias("l1_reason"),
        F.max(default).alias("fallback"),
    )
    return chosen.select(
        key,
        F.coalesce("best.code", "fallback").alias("code"),
        F.coalesce("best.level", F.lit("fallback_default")).alias("level"),
        F.coalesce("best.reason", "l1_reason").alias("reason"),
        "l1_code",
        "l1_reason",
    )


def first_candidate(candidates: DataFrame, key: str = "id", default: str = "default_code") -> DataFrame:
    """One code per record without checking it: the first that is not empty."""
    place = F.array_position(F.array(*[F.lit(x) for x in UNCHECKED_LEVELS]), F.col("level"))
    usable = (F.coalesce(F.col("code"), F.lit("")) != "") & (place > 0)
    return candidates.groupBy(key).agg(
        F.coalesce(F.min_by(F.when(usable, F.col("code")), F.when(usable, place)), F.max(default)).alias("code")
    )
