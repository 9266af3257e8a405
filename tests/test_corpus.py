"""Screening, triage, prompts and corpus builds on small inputs."""

import pytest
from helpers import rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from frameops.corpus import build, errors, prompts, screen
from frameops.functions.types import TABLES_TYPE, normalise_tables
from frameops.session import scratch_path


def apply(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.out for r in df.select("i", function(F.col("t")).alias("out")).orderBy("i").collect()]


def test_strip_code_fence(spark):
    cases = {
        "x = 1": "x = 1",
        "```python\nx = 1\n```": "x = 1",
        "```\nx\n```": "x",
        "  ```python x```  ": "x",
        "```": "",
        "``````": "",
        "```pythonx```": "x",
        "a ``` b": "a ``` b",
        "\n\t x   ": "x",
        "```python\n\n```\n": "",
        "```py\nx\n```": "py\nx",
        "x```": "x",
        "": "",
        " \x1c\x1f\u3000\xa0x": "x",
    }
    assert apply(spark, screen.strip_code_fence, cases) == list(cases.values())


def test_final_assignment(spark):
    cases = {
        "x = 1": "x = 1",
        "a = 2\nresult = (t.f(1))\nb": "result = (t.f(1))",
        "result = 1\nresult = t.f()\n": "result = t.f()\n",
        "result =   (a": "result =   (a",
        "result = (a) + (b)": "result = (a)",
        "result=(a)": "result=(a)",
        'result = (f("("))': 'result = (f("("))',
    }
    assert apply(spark, screen.final_assignment, cases) == list(cases.values())


def labels(spark, *codes):
    return apply(spark, screen.anti_patterns, codes)


def test_anti_patterns(spark):
    names = [label for label, _ in screen.ANTI_PATTERNS]
    found = labels(
        spark,
        "df.with_column(x)", "pl.desc ('a')", "c.dense()", "df.len", "df.groupby('a')", "c.contains('a')", 'df[df["a"] > 1]',
        "df.len_chars() + df.len()", "c.str.contains('x')", "df.with_columns(a).group_by('b')",
        'df.with_column(x).groupby("a")[df["b"]]', "", "spl.desc(1)",
    )
    assert found[:7] == [[n] for n in names]
    assert found[7:10] == [[], [], []]
    assert found[10] == [names[0], names[4], names[6]]
    assert found[11] == [] and found[12] == []


def verdicts(spark, codes, columns=("k", "name")):
    df = spark.createDataFrame([(i, c, list(columns)) for i, c in enumerate(codes)], "i int, code string, valid_columns array<string>")
    return [r.reason for r in screen.screen(df).orderBy("i").collect()]


def test_screen_precedence(spark):
    names = [label for label, _ in screen.ANTI_PATTERNS]
    assert verdicts(spark, [None, "", "  \n"]) == ["empty"] * 3
    found = verdicts(
        spark,
        [
            "result = (", "x = t.groupby('a')", 'result = t.groupby(pl.col("zzz"))', 'result = t.filter(pl.col("zzz") > 1)',
            'result = t.select((pl.col("k")).alias("zz")).filter(pl.col("zz") > 1)', "result=t", 'result = t.sort("zzz")',
            'result = pl.col( "zz" )', "result = 1\x00",
        ],
    )
    assert found[0].startswith("syntax_error: ")
    assert found[1] == "missing_result_assignment"
    assert found[2] == f"hallucinated_api: {names[4]}"
    assert found[3] == "unknown_column: 'zzz'"
    assert found[4:7] == ["ok", "ok", "ok"]
    assert found[7] == "unknown_column: 'zz'"
    assert found[8].startswith("syntax_error")


def test_unknown_columns_are_not_checked_without_a_schema(spark):
    assert verdicts(spark, ['result = t.filter(pl.col("zzz") > 1)'], columns=()) == ["ok"]
    assert verdicts(spark, ['result = t.filter(pl.col("zzz") > pl.lit(1).alias("q"))'], columns=()) == ["unknown_column: 'zzz'"]


def test_choice_of_a_candidate(spark):
    rows = [
        (1, "fast", "f", True, "ok"), (1, "constrained", "c", True, "ok"),
        (2, "fast", "f", False, "empty"), (2, "retry", "r", True, "ok"), (2, "constrained", "c", True, "ok"),
        (3, "fast", "f", False, "bad"), (3, "retry", "", False, "empty"),
        (4, "fast", None, False, "empty"),
    ]
    df = spark.createDataFrame(rows, "id int, level string, code string, ok boolean, reason string").withColumn(
        "default_code", F.lit("result = t")
    )
    found = {r.id: (r.code, r.level, r.reason, r.l1_code, r.l1_reason) for r in screen.choose_candidates(df).collect()}
    assert found == {
        1: ("f", "fast", "ok", "f", "ok"),
        2: ("c", "constrained", "ok", "f", "empty"),
        3: ("result = t", "fallback_default", "bad", "f", "bad"),
        4: ("result = t", "fallback_default", "empty", None, "empty"),
    }
    assert {r.id: r.code for r in screen.first_candidate(df).collect()} == {1: "c", 2: "c", 3: "f", 4: "result = t"}


def test_default_code(spark):
    df = spark.createDataFrame([([("b", None, []), ("a", None, [])],), ([],)], f"t {TABLES_TYPE.simpleString()}")
    assert [r.c for r in df.select(screen.default_code(F.col("t")).alias("c")).collect()] == ["result = b", "result = None"]


def test_error_triage(spark):
    listed = 'ColumnNotFoundError: Unable to find column "x"; valid columns: ["a", "b"]'
    found = apply(
        spark, lambda message: errors.triage(message, errors.EXCERPTS),
        [None, "", listed, "DuplicateError: " + "d" * 300, 'unable to find column "x" ColumnNotFoundError', "SchemaError" + "s" * 300,
         "AttributeError DuplicateError", "boom " + "b" * 500],
    )
    assert [r.error_class for r in found] == [
        "empty", "empty", "missing_column", "DuplicateError", "ColumnNotFoundError", "SchemaError", "DuplicateError", "other",
    ]
    assert (found[2].missing_column, found[2].valid_columns, found[2].excerpt) == ("x", '"a", "b"', None)
    assert [len(r.excerpt) for r in found[3:8]] == [200, 45, 250, 29, 400]
    assert len(apply(spark, errors.triage, ["boom " + "b" * 500])[0].excerpt) == 505


# --- texts ---------------------------------------------------------------------

SHAPES = {
    "enriched": {"t": {"columns": {"x": "Int64", "y": "Utf8"}, "n_rows": 0}, "u": {"columns": {"x": "Date"}, "n_rows": 7}},
    "flat": {"t": {"x": "Int64"}},
    "names": {"t": ["x", "y"]},
    "none": {},
    "bare": {"t": []},
}


@pytest.fixture
def shapes(spark):
    rows = [(name, normalise_tables(shape)) for name, shape in SHAPES.items()]
    return spark.createDataFrame(rows, f"shape string, tables {TABLES_TYPE.simpleString()}")


def rendered(shapes, column):
    return {r.shape: r.out for r in shapes.select("shape", column.alias("out")).collect()}


def test_schema_blocks(shapes):
    chat = rendered(shapes, prompts.schema_block(F.col("tables")))
    assert chat["enriched"] == "Datasets:\n- t (0 rows)\n    x: Int64\n    y: Utf8\n- u (7 rows)\n    x: Date"
    assert chat["flat"] == "Datasets:\n- t\n    x: Int64"
    assert chat["none"] == "Datasets:"
    assert rendered(shapes, prompts.schema_block(F.col("tables"), "plan"))["enriched"].startswith("Datasets:\n- t\n")
    assert rendered(shapes, prompts.schema_block(F.col("tables"), "checked"))["enriched"].endswith("  u  (7 rows)\n    x: Date")
    plain = rendered(shapes, prompts.schema_block(F.col("tables"), "plain"))
    assert plain["enriched"].startswith("- t  (0 rows)\n") and plain["none"] == ""


def test_turns(shapes):
    strict = rendered(shapes, prompts.user_turn(F.col("tables"), F.lit("Why?"), strict=True))
    assert strict["none"] == "Datasets:\n\nQuestion: Why?"
    assert strict["bare"] == "Datasets:\n- t\n\nQuestion: Why?"
    assert strict["names"].endswith("fail with ColumnNotFoundError):\n  t: x, y")
    wanted = F.array(F.lit("a"), F.lit("b"))
    plain = rendered(shapes, prompts.plain_user_turn(F.col("tables"), F.lit("Why?"), wanted))
    assert plain["flat"].startswith("Schema:\n- t\n    x: Int64\n\nQuestion: Why?\n\nExpected output columns")
    assert plain["flat"].endswith('["a", "b"]')
    without = rendered(shapes, prompts.plain_user_turn(F.col("tables"), F.lit("Why?"), F.array().cast("array<string>")))
    assert without["flat"].endswith("Question: Why?")


def test_messages(spark):
    df = spark.createDataFrame([("q", None)], "q string, code string")
    base = prompts.chat_messages("sys", [("a", "b")], F.col("q"))
    messages = df.select(prompts.repair_messages(base, F.col("code"), F.lit("fix")).alias("m")).first().m
    assert [tuple(m) for m in messages] == [
        ("system", "sys"), ("user", "a"), ("assistant", "b"), ("user", "q"), ("assistant", ""), ("user", "fix"),
    ]


def test_schema_names(shapes):
    names = rendered(shapes.where("shape in ('enriched', 'names')"), prompts.schema_names(F.col("tables")))
    assert (names["enriched"].tables, names["enriched"].columns) == (["t", "u"], ["x", "y"])
    for shape in ("none", "bare"):
        with pytest.raises(PySparkException):
            shapes.where(F.col("shape") == shape).select(prompts.schema_names(F.col("tables"))).collect()


def test_column_jobs_run_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("```python\nresult = t\n```",), ("x = 1",)], "code string").write.json(source)
    stream = spark.readStream.schema("code string").json(source)
    cleaned = stream.select(screen.strip_code_fence(F.col("code")).alias("code"), F.array(F.lit("k")).alias("valid_columns"))
    running = (
        screen.screen(cleaned).select("code", "reason").writeStream.format("memory").queryName("screened")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    running.awaitTermination(120)
    assert rows_of(spark.table("screened")) == [("'result = t'", "'ok'"), ("'x = 1'", "'missing_result_assignment'")]


# --- builds ----------------------------------------------------------------------


def test_question_corpus(spark):
    questions = spark.createDataFrame(
        [("1", "a", "q1", "SELECT count(*) AS n FROM t"), ("2", "b", "q2", "SELECT x FROM t WHERE x > 100"),
         ("3", "b", "q3", "SELECT y FROM t"), ("4", "b", "q4", "SELECT x, x AS z FROM t"),
         ("5", "a", "q5", "SELECT CAST('w' AS INT) AS w FROM t")],
        "id string, db_id string, question string, sql string",
    )
    sizes = {"a": 5, "b": 3}
    out = scratch_path(spark, "test-corpus")
    records, outcomes = build.build_question_corpus(
        questions, lambda session, db: {"t": session.range(sizes[db]).withColumnRenamed("id", "x")}, out
    )
    found = {r.id: r for r in outcomes.collect()}
    assert {i: r.status for i, r in found.items()} == {"1": "ok", "2": "empty", "3": "failed", "4": "ok", "5": "failed"}
    assert "cannot be resolved" in found["3"].error
    assert found["4"].columns == ["x", "z"] and found["4"].n_rows == 3
    assert spark.read.parquet(found["1"].output).first().n == 5
    assert {r.status: r.n for r in build.status_totals(outcomes).collect()} == {"ok": 2, "empty": 1, "failed": 2}
    kept = {r.id: r for r in records.collect()}
    assert set(kept) == {"1", "4"}
    assert kept["4"].tables["t"].n_rows == 3 and kept["4"].tables["t"].columns == {"x": "Int64"}
    assert kept["1"].expected_output_hash == found["1"].content_hash and kept["1"].polars_code is None


def test_reference_build_keeps_empty_results(spark):
    tables = {"t": spark.range(4), "u": spark.range(2)}
    catalog = {"none": lambda t: t["t"].where("id > 9"), "all": lambda t: t["t"], "bad": lambda t: t["t"].select("nope")}
    records, outcomes = build.build_references(
        spark, catalog, tables, {"none": ["t"], "all": ["t", "u"], "bad": ["t"]}, scratch_path(spark, "test-refs")
    )
    found = {r.id: r for r in records.collect()}
    assert {k: r.expected_n_rows for k, r in found.items()} == {"none": 0, "all": 4}
    assert set(found["all"].tables) == {"t", "u"} and found["all"].tables["u"].n_rows == 2
    assert outcomes.where("status = 'failed'").first().id == "bad"
