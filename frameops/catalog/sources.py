"""Queries for tables, records, exports and SQL texts."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import functions as F

from frameops.catalog.registry import query
from frameops.functions.types import struct_type
from frameops.jobs import rows_of_jobs
from frameops.session import scratch_path
from frameops.sources import records
from frameops.sources.export import export_databases
from frameops.sources.audit import RefusedError
from frameops.sources.sqltext import execute_sql, private_session, query_frame
from frameops.sources.tables import (
    load_database,
    load_expected,
    load_tables,
    row_counts,
    write_frame,
)

_NAMES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
    "nation", "orders", "pages", "part", "region", "supplier",
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n_rows FROM {n}" for n in _NAMES))
def table_row_counts(t):
    return row_counts(load_tables(t.spark, t.folder))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def table_scan(t):
    return load_tables(t.spark, t.folder)["lineitem"].select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "SELECT 'per_segment' AS \"table\", count(DISTINCT c_mktsegment) AS n_rows FROM customer"
    " UNION ALL SELECT 'per_status', count(DISTINCT o_orderstatus) FROM orders"
)
def expected_outputs(t):
    folder = scratch_path(t.spark, "expected")
    write_frame(t.customer.groupBy("c_mktsegment").count(), f"{folder}/per_segment.parquet")
    write_frame(t.orders.groupBy("o_orderstatus").count(), f"{folder}/per_status.parquet")
    return row_counts(load_expected(t.spark, folder))


@query(
    "SELECT count(*) AS n_rows, 'o_orderkey:Int64,o_custkey:Int64,o_orderstatus:Utf8,o_totalprice:Float64,"
    "o_orderdate:Datetime,o_orderpriority:Utf8' AS declared FROM orders"
)
def database_schema(t):
    root, db_id = t.folder.rsplit("/", 1)
    tables, schemas = load_database(t.spark, root, db_id)
    declared = ",".join(f"{c}:{d}" for c, d in schemas["orders"].items())
    return tables["orders"].agg(F.count(F.lit(1)).alias("n_rows")).withColumn("declared", F.lit(declared))


@query(
    "SELECT 'spider_' || source || '_' || printf('%04d', row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)"
    " AS id, source AS db_id, doc_id AS seq, n_chars FROM documents"
)
def question_ids(t):
    questions = t.documents.select(F.col("source").alias("db_id"), F.col("doc_id").alias("seq"), "n_chars")
    return records.load_questions(questions, questions.select("db_id"))


@query(
    "SELECT id, db_id, seq FROM (SELECT 'spider_' || event_type || '_' || printf('%04d', row_number() OVER"
    " (PARTITION BY event_type ORDER BY event_id) - 1) AS id, event_type AS db_id, event_id AS seq FROM events"
    " WHERE event_type IN ('click', 'error'))"
)
def question_ids_in_sliced_groups(t):
    questions = t.events.select(F.col("event_type").alias("db_id"), F.col("event_id").alias("seq"))
    return records.load_questions(
        questions, ["click", "error", "view"], whitelist=["click", "error", "missing"], max_rows_per_task=0
    )


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def records_round_trip(t):
    path = scratch_path(t.spark, "records")
    records.write_records(t.documents, path)
    return records.read_records(t.spark, path, t.documents.schema)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def first_records(t):
    # The first records of a file in its own order is what this reader is for.
    path = scratch_path(t.spark, "records")
    ordered = t.customer.select("c_custkey", "c_name").orderBy("c_custkey")
    records.write_records(ordered, path)
    return records.read_records(t.spark, path, struct_type({"c_custkey": "Int64", "c_name": "Utf8"}), limit=100)


@query(
    " UNION ALL ".join(
        f"SELECT '{db}' AS db_id, '{n}' AS \"table\", count(*) AS n_rows FROM {n}"
        for db, n in (("sales", "orders"), ("sales", "customer"), ("stock", "part"))
    )
)
def export_manifest(t):
    databases = {
        "sales": (["orders", "customer"], lambda name: t[name]),
        "gone": None,
        "stock": (["part"], lambda name: t[name]),
    }
    return export_databases(t.spark, databases, scratch_path(t.spark, "export"))


_SQL = (
    "SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM customer"
    " JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey"
)


@query(_SQL)
def sql_text(t):
    outcome = execute_sql(t.spark, _SQL, {"customer": t.customer, "orders": t.orders})
    return outcome.result


@query(
    "SELECT count(*) AS n, false AS success, 'AnalysisException' AS error FROM customer"
)
def sql_text_error(t):
    outcome = execute_sql(t.spark, "SELECT no_such_column FROM customer", {"customer": t.customer})
    return t.customer.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(outcome.success).alias("success"), F.lit(outcome.error.split(":")[0]).alias("error")
    )


# A text per nation: plain queries, and some that ask for more.
_ASKED = (
    "'SELECT count(*) AS n FROM customer WHERE c_nationkey = ' || n_nationkey",
    "'SELECT reflect(''java.lang.System'', ''getProperty'', ''user.name'') FROM nation WHERE n_nationkey = ' || n_nationkey",
    "'SELECT TRANSFORM (n_name) USING ''cat'' AS (x) FROM nation LIMIT ' || n_nationkey",
    "'SELECT * FROM parquet.`/data/' || n_name || '` t'",
    "'WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = ' || n_nationkey || ') SELECT count(*) FROM c'",
    "'SELECT count(*) FROM supplier WHERE s_nationkey = ' || n_nationkey",
    "'DROP TABLE nation_' || n_nationkey",
)


@query(
    "WITH texts AS (SELECT n_nationkey, CASE n_nationkey % 7 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_ASKED))
    + """ END AS sql FROM nation)
SELECT n_nationkey, CASE WHEN sql LIKE '%reflect(%' THEN 'function reflect' WHEN sql LIKE '%TRANSFORM%' THEN 'node ScriptTransformation'
  WHEN sql LIKE '%parquet.%' THEN 'relation parquet.' || regexp_extract(sql, '`(.*)`', 1)
  WHEN sql LIKE '% supplier %' THEN 'relation supplier' WHEN sql NOT LIKE 'SELECT%' AND sql NOT LIKE 'WITH%' THEN 'no query' END AS refused,
  CASE WHEN sql LIKE '%customer%' THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS n
FROM texts""")
def audited_sql(t):
    """Texts with what was refused of them, and the results of those that were run."""
    sql = "CASE n_nationkey % 7 " + " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(_ASKED)) + " END"
    session = private_session(t.spark)
    for name in ("customer", "nation"):
        session.read.parquet(f"{t.folder}/{name}.parquet").createOrReplaceTempView(name)

    def work(row):
        try:
            return row["n_nationkey"], None, query_frame(session, row["sql"], ("customer", "nation")).first()[0]
        except RefusedError as error:
            return row["n_nationkey"], str(error), None
        except ParseException:
            return row["n_nationkey"], "no query", None

    texts = t.nation.select("n_nationkey", F.expr(sql).alias("sql")).orderBy("n_nationkey").toLocalIterator()
    return rows_of_jobs(t.spark, texts, work, "n_nationkey int, refused string, n bigint", 4)
