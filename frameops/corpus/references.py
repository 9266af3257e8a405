"""What code refers to, read from its syntax tree: columns in every form of call, names it gives, misused calls.

One walk per text, over Arrow batches, in the order in which the code would run. What stands in comments or in other
strings is not code and does not count.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.corpus.screen import ANTI_PATTERNS

NAME = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("given", T.BooleanType()),
        T.StructField("before", T.BooleanType()),
    ]
)
FACTS = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("names", T.ArrayType(NAME)),
        T.StructField("misused", T.ArrayType(T.StringType())),
    ]
)

# Calls whose text arguments name columns, and keywords that do.
NAMING_CALLS = (
    "select", "group_by", "sort", "unique", "drop", "over", "partition_by", "sort_by", "drop_nulls",
    "with_columns", "agg", "top_k", "explode",
)
NAMING_KEYWORDS = ("on", "left_on", "right_on", "by", "subset", "index", "columns", "values")
# Calls whose other keywords name the columns they make.
GIVING_CALLS = ("select", "with_columns", "agg", "group_by")


class Walk:
    """Names in the order of evaluation: (name, line, given, before), ``given`` for one that the code makes, and
    ``before`` for one that an earlier part of the code has made."""

    def __init__(self) -> None:
        self.names: list[tuple[str, int, bool, bool]] = []
        self.made: set[str] = set()
        self.found: set[int] = set()  # misused calls, by their place in ANTI_PATTERNS

    def use(self, name: str, node: ast.AST) -> None:
        self.names.append((name, node.lineno, False, name in self.made))

    def give(self, name: str, node: ast.AST) -> None:
        self.names.append((name, node.lineno, True, name in self.made))

    def settle(self, start: int) -> None:
        """Names given since ``start`` can be referred to from now on."""
        self.made.update(name for name, _, given, _ in self.names[start:] if given)

    def texts(self, node: ast.AST) -> Iterator[ast.Constant]:
        """The texts of an argument: itself, or those of a list."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            yield node
        elif isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            for item in node.elts:
                yield from self.texts(item)

    def visit(self, node: ast.AST) -> None:
        if isinstance(node, ast.Call):
            self.call(node)
        elif isinstance(node, ast.Subscript):
            self.subscript(node)
        elif isinstance(node, ast.Attribute):
            if node.attr == "len":
                self.found.add(3)
            self.visit(node.value)
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            if node.value is not None:
                self.visit(node.value)
        else:
            for child in ast.iter_child_nodes(node):
                self.visit(child)

    def subscript(self, node: ast.Subscript) -> None:
        self.visit(node.value)
        inner = [n for n in ast.walk(node.slice) if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name)]
        if any(isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str) for n in inner):
            self.found.add(6)
        for text in self.texts(node.slice):
            self.use(text.value, text)
        self.visit(node.slice)

    def call(self, node: ast.Call) -> None:
        function = node.func
        name = function.attr if isinstance(function, ast.Attribute) else function.id if isinstance(function, ast.Name) else ""
        owner = function.value if isinstance(function, ast.Attribute) else None
        of_library = isinstance(owner, ast.Name) and owner.id == "pl"
        if owner is not None:
            self.visit(owner)
            self.misuse(name, owner, of_library)
        else:
            self.visit(function)
            if name == "groupby":
                self.found.add(4)
        start = len(self.names)
        given = [*node.args, *(k.value for k in node.keywords if k.arg not in NAMING_KEYWORDS)]
        for argument in given:
            self.visit(argument)
        if name == "alias" and node.args:
            for text in self.texts(node.args[0]):
                self.give(text.value, text)
        elif name == "col" and (of_library or owner is None):
            for argument in node.args:
                for text in self.texts(argument):
                    self.use(text.value, text)
        elif name == "rename" and node.args and isinstance(node.args[0], ast.Dict):
            for old, new in zip(node.args[0].keys, node.args[0].values):
                for text in self.texts(old) if old is not None else ():
                    self.use(text.value, text)
                for text in self.texts(new):
                    self.give(text.value, text)
        elif name in NAMING_CALLS and not of_library:
            for argument in node.args:
                for text in self.texts(argument):
                    self.use(text.value, text)
        for keyword in node.keywords:
            if keyword.arg in NAMING_KEYWORDS:
                self.visit(keyword.value)
                for text in self.texts(keyword.value):
                    self.use(text.value, text)
            elif keyword.arg and name in GIVING_CALLS and keyword.arg != "maintain_order":
                self.give(keyword.arg, keyword.value)
        if name == "len" and owner is not None:
            self.give("len", node)
        # Expressions of one call do not see each other's names; the calls after it do.
        if not of_library and name not in ("alias", "col"):
            self.settle(start)

    def misuse(self, name: str, owner: ast.AST, of_library: bool) -> None:
        if name == "with_column":
            self.found.add(0)
        elif name == "desc" and of_library:
            self.found.add(1)
        elif name == "dense":
            self.found.add(2)
        elif name == "groupby":
            self.found.add(4)
        elif name == "contains" and not (isinstance(owner, ast.Attribute) and owner.attr == "str"):
            self.found.add(5)


def facts_of(text: str) -> tuple[str | None, list[tuple], list[str]]:
    """Syntax error, names and misused calls of one text; without names where it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        walk = Walk()
        for statement in tree.body:
            start = len(walk.names)
            walk.visit(statement)
            walk.settle(start)
    except SyntaxError as error:
        return error.msg, [], []
    except (ValueError, RecursionError, MemoryError) as error:
        return str(error) or type(error).__name__, [], []
    return None, walk.names, [ANTI_PATTERNS[i][0] for i in sorted(walk.found)]


@F.pandas_udf(FACTS)
def code_facts(code: pd.Series) -> pd.DataFrame:
    """Per text a struct of its syntax ``error``, its ``names`` in order, and its ``misused`` calls in the order of
    the list. A null text has no error and no names."""
    rows = [(None, [], []) if text is None else facts_of(text) for text in code]
    return pd.DataFrame({
        "error": [r[0] for r in rows],
        "names": [[dict(zip(("name", "line", "given", "before"), n)) for n in r[1]] for r in rows],
        "misused": [r[2] for r in rows],
    })


def unknown_reference(facts: Column, columns: Column, in_order: bool = True, suffix: str = "_right") -> Column:
    """The first name referred to that is no column and that the code has not made before (with ``in_order=False``: not
    anywhere); a column with the suffix of a join is known. Null if there is none, or nothing to check against."""
    given = F.transform(F.filter(facts["names"], lambda n: n["given"]), lambda n: n["name"])

    def known(name: Column) -> Column:
        base = F.regexp_replace(name, F.lit(f"{suffix}$"), F.lit(""))
        return F.array_contains(columns, name) | F.array_contains(columns, base)

    def stray(n: Column) -> Column:
        made = n["before"] if in_order else F.array_contains(given, n["name"])
        return ~n["given"] & ~made & ~known(n["name"])

    first = F.get(F.filter(facts["names"], stray), F.lit(0))["name"]
    return F.when(F.size(columns) > 0, first)
