"""Names and misused calls from the syntax tree."""

import pytest
from pyspark.sql import functions as F

from frameops.corpus import references, screen


def names(text):
    error, found, _ = references.facts_of(text)
    assert error is None
    return [(n, "given" if g else "made" if b else "used") for n, _, g, b in found]


@pytest.mark.parametrize("text,expected", [
    ("df.select('a', \"b\", pl.col('c'))", [("c", "used"), ("a", "used"), ("b", "used")]),
    ("df.select(['a', pl.col(['b', 'c'])])", [("b", "used"), ("c", "used"), ("a", "used")]),
    ("df.group_by('a').agg(pl.col('b').sum().alias('t')).sort('t', descending=True)",
     [("a", "used"), ("b", "used"), ("t", "given"), ("t", "made")]),
    ("df.filter(pl.col('t') > 1).with_columns(pl.len().alias('t'))", [("t", "used"), ("len", "given"), ("t", "given")]),
    ("df.with_columns(t=pl.col('a') * 2, u=pl.col('t'))", [("a", "used"), ("t", "used"), ("t", "given"), ("u", "given")]),
    ("x = df.rename({'a': 'b'})\nresult = x.sort(by=['b'])", [("a", "used"), ("b", "given"), ("b", "made")]),
    ("df.join(o, left_on='a', right_on=\"b\", how='left', suffix='_o')", [("a", "used"), ("b", "used")]),
    ("df.unique(subset=['a', 'b'])", [("a", "used"), ("b", "used")]),
    ("df.filter(pl.col('a').str.contains('b')) # pl.col('z').alias('y')", [("a", "used")]),
    ("print(\"pl.col('z')\"); df['a']", [("a", "used")]),
    ("df.select(pl.col('a').rank('dense').over('g'))", [("a", "used"), ("g", "used")]),
    ("df.group_by('a').len().sort('len')", [("a", "used"), ("len", "given"), ("len", "made")]),
    ("f'{df}'", []),
])
def test_names_in_order(text, expected):
    assert names(text) == expected


@pytest.mark.parametrize("text,which", [
    ("df.with_column(pl.col('a'))", [0]), ("df.sort(pl.desc('a'))", [1]), ("pl.col('a').dense()", [2]), ("df.len", [3]),
    ("df.groupby('a')", [4]), ("pl.col('a').contains('x')", [5]), ("df[df['a'] > 1]", [6]),
    ("df.len() + df.height", []), ("pl.col('a').str.contains('.groupby(')", []), ("# df.groupby('a')\ndf.group_by('a')", []),
    ("df[df['a'] > 1].groupby('a').len", [3, 4, 6]),
])
def test_misused_calls(text, which):
    assert references.facts_of(text)[2] == [screen.ANTI_PATTERNS[i][0] for i in which]


def test_unknown_references(spark):
    rows = [
        ("df.select('a', 'zz')", "zz", "zz"),
        ("df.filter(pl.col('t') > 1).with_columns(pl.col('a').alias('t'))", "t", None),
        ("df.join(o, on='a').select('b_right', 'c_right')", "c_right", "c_right"),
        ("df.select('a'", None, None),
        (None, None, None),
        ("", None, None),
        ("x" * 200_000 + ".select('b')", None, None),
    ]
    df = spark.createDataFrame([r[:1] for r in rows], "code string").withColumn("facts", references.code_facts("code"))
    known = F.array(F.lit("a"), F.lit("b"))
    found = df.select(
        references.unknown_reference(F.col("facts"), known).alias("strict"),
        references.unknown_reference(F.col("facts"), known, in_order=False).alias("lax"),
        references.unknown_reference(F.col("facts"), F.array().cast("array<string>")).alias("none"),
        "facts.error",
    ).collect()
    assert [(r.strict, r.lax) for r in found] == [r[1:] for r in rows]
    assert {r.none for r in found} == {None} and [r.error is not None for r in found] == [i == 3 for i in range(7)]
