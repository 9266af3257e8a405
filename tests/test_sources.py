"""Tables, records, exports and SQL texts."""

import json

import pytest
from conftest import DATA
from helpers import rows_of
from pyspark.sql import functions as F

from frameops.sources import audit, records
from frameops.sources.export import export_databases, export_tables
from frameops.sources.sqltext import execute_sql
from frameops.sources.tables import load_database, load_expected, load_tables, row_counts, table_names, write_frame


def test_tables_are_found_as_files_and_directories(spark, tmp_path):
    write_frame(spark.range(3), str(tmp_path / "b.parquet"))
    write_frame(spark.range(2), str(tmp_path / "a.parquet"))
    (tmp_path / "notes.txt").write_text("x")
    assert table_names(spark, str(tmp_path)) == ["a", "b"]
    assert rows_of(row_counts(load_tables(spark, str(tmp_path)))) == [("'a'", "2"), ("'b'", "3")]
    assert "lineitem" in table_names(spark, DATA + "/")
    assert load_expected(spark, str(tmp_path / "missing")) == {}


def test_database_and_schema(spark, tmp_path):
    write_frame(spark.range(3).withColumn("s", F.lit("x")), str(tmp_path / "db" / "t.parquet"))
    tables, schemas = load_database(spark, str(tmp_path), "db")
    assert schemas == {"t": {"id": "Int64", "s": "Utf8"}} and tables["t"].count() == 3
    (tmp_path / "empty").mkdir()
    for db in ("missing", "empty"):
        with pytest.raises(FileNotFoundError):
            load_database(spark, str(tmp_path), db)


def test_records_skip_blank_lines_and_keep_file_order(spark, tmp_path):
    lines = [json.dumps({"id": f"r{i}", "tags": ["é"], "difficulty": i, "tables": {"t": {"columns": {"x": "Int64"}, "n_rows": 3}}},
                        ensure_ascii=False) for i in range(20)]
    (tmp_path / "seeds.jsonl").write_text("\n\n".join(lines) + "\n\n")
    path = str(tmp_path / "seeds.jsonl")
    assert records.read_records(spark, path).count() == 20
    assert records.read_records(spark, path, limit=0).count() == 20
    first = records.read_records(spark, path, limit=3).collect()
    assert [r.id for r in first] == ["r0", "r1", "r2"]
    assert first[0].tables["t"].columns == {"x": "Int64"} and first[0].tags == ["é"]


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("é", 2)], "s string, n int")
    records.write_records(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert "é" in text and '"n":null' in text
    assert rows_of(records.read_records(spark, str(tmp_path / "out"), df.schema)) == rows_of(df)


@pytest.mark.parametrize("bound", [0, 10**6])
def test_question_ids_count_per_database(spark, bound):
    rows = [(i, "ab"[i % 2] if i < 9 else "c", f"q{i}", {"t": i}) for i in range(12)]
    df = spark.createDataFrame(rows, "seq int, db_id string, question string, sizes map<string,int>")
    found = records.load_questions(df, ["a", "b"], limit=5, max_rows_per_task=bound).orderBy("seq").collect()
    assert [r.id for r in found] == ["spider_a_0000", "spider_b_0000", "spider_a_0001", "spider_b_0001", "spider_a_0002"]
    assert records.load_questions(df, ["a", "b", "c"], whitelist=["c", "z"], max_rows_per_task=bound).count() == 3
    with pytest.raises(ValueError):
        records.load_questions(df, ["a"], whitelist=["z"])


def test_first_records_read_the_first_files_only(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"part {i:02d}.jsonl").write_text("".join(f'{{"id": "r{i}_{j}"}}\n' for j in range(4)))
    found = records.read_records(spark, str(tmp_path), "id string", limit=6)
    assert [r.id for r in found.collect()] == [f"r0_{j}" for j in range(4)] + ["r1_0", "r1_1"]
    assert records.read_records(spark, str(tmp_path), "id string", limit=100).count() == 40
    # A file that cannot be read fails a read only if it is opened.
    (tmp_path / "part 10.jsonl.gz").write_bytes(b"no archive")
    assert records.read_records(spark, str(tmp_path), "id string", limit=6).count() == 6
    with pytest.raises(Exception, match="(?i)gzip|zip|read"):
        records.read_records(spark, str(tmp_path), "id string", limit=100).count()


def test_available_databases_as_a_frame(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "seq int, db_id string")
    found = records.load_questions(df, df.where("db_id = 'a' OR db_id IS NULL").select("db_id"))
    assert sorted((r.seq, r.id) for r in found.collect()) == [(0, "spider_a_0000"), (2, "spider_a_0001")]
    with pytest.raises(ValueError):
        records.load_questions(df, df.where("seq > 5"))


def test_export_of_databases(spark, tmp_path):
    out = str(tmp_path / "out")
    made = {"item": spark.range(59), "bare": spark.range(0), "odd name": spark.range(1)}
    sources = {"shop": (list(made), made.__getitem__), "gone": None}
    manifest = export_databases(spark, sources, out)
    assert rows_of(manifest) == sorted([("'shop'", "'item'", "59"), ("'shop'", "'bare'", "0"), ("'shop'", "'odd name'", "1")])
    assert rows_of(spark.read.schema(manifest.schema).json(out + "/manifest.json")) == rows_of(manifest)
    tables, _ = load_database(spark, out, "shop")
    assert sorted(tables) == ["bare", "item", "odd name"] and tables["item"].count() == 59


def test_export_counts_while_writing(spark, tables, tmp_path):
    counts = export_tables(["nation", "region"], lambda name: tables[name], str(tmp_path))
    assert counts == {"nation": 25, "region": 5}


def test_sql_errors_are_values(spark):
    t = {"t": spark.createDataFrame([("1",), ("x",)], "s string")}
    fine = execute_sql(spark, "SELECT count(*) AS n FROM T", t)
    assert fine.success and fine.error is None and fine.result.first().n == 2
    for bad in ("SELECT nope FROM t", "SELEC 1", "SELECT * FROM missing"):
        failed = execute_sql(spark, bad, t)
        assert not failed.success and failed.result is None and failed.error
    late = "SELECT CAST(s AS INT) AS i FROM t"
    assert execute_sql(spark, late, t).success
    assert not execute_sql(spark, late, t, run=True).success
    assert not spark.catalog.tableExists("t")


def test_sql_puts_hidden_views_back(spark):
    spark.range(1).createOrReplaceTempView("mine")
    assert execute_sql(spark, "SELECT count(*) AS n FROM mine", {"mine": spark.range(7)}).result.first().n == 7
    assert spark.table("mine").count() == 1
    spark.catalog.dropTempView("mine")


@pytest.mark.parametrize("sql,found", [
    ("SELECT a, sum(b) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", []),
    ("SELECT a, CASE WHEN b IN (1, 2) THEN 'x' END, b::string, t.c.d, a[0], -b, b % 2, x -> x FROM t WHERE a LIKE 'x%'", []),
    ("SELECT * FROM (SELECT a FROM t UNION ALL SELECT a FROM t EXCEPT SELECT 1) s LATERAL VIEW explode(array(1)) e AS v", []),
    ("WITH c AS (SELECT 1 AS a) SELECT c.a, count(DISTINCT t.a) FROM c JOIN t ON c.a = t.a GROUP BY 1 HAVING count(*) > 1 LIMIT 3", []),
    ("SELECT (SELECT max(a) FROM u) FROM t WHERE EXISTS (SELECT java_method('x', 'y') FROM t)", ["function java_method", "relation u"]),
    ("SELECT input_file_name(), current_user() FROM t", ["function input_file_name", "function current_user"]),
    ("SELECT * FROM db.t", ["relation db.t"]),
    ("SELECT * FROM csv.`/etc/passwd`", ["relation csv./etc/passwd"]),
    ("SELECT * FROM range(3)", []),
    ("SELECT MAP(a) USING 'sh' AS x FROM t", None),
])
def test_audit_of_texts(spark, sql, found):
    if found is None:
        assert "node ScriptTransformation" in audit.refused(spark, "SELECT TRANSFORM(a) USING 'sh' AS x FROM t", ["t"])
    else:
        assert sorted(audit.refused(spark, sql, ["t"])) == sorted(found)


def test_own_functions_can_be_admitted(spark):
    assert audit.refused(spark, "SELECT my_sum(a) FROM t") == ["function my_sum"]
    assert audit.refused(spark, "SELECT my_sum(a) FROM t", functions=["MY_SUM"]) == []
