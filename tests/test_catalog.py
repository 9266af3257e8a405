"""Every named query against its SQL in DuckDB."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest
from conftest import DATA, ROOT
from helpers import bag

import __spark_entry__ as entry_module
from frameops.catalog import QUERIES

SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, DATA)
    found = bag(df.collect(), df.columns)
    wanted = duck.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    types = {d[0]: str(d[1]) for d in wanted.description}
    assert sorted(df.columns) == sorted(columns)
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in df.schema} == types
    assert found == bag(wanted.fetchall(), columns)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 10


def test_every_query_has_sql():
    # The text operators, where they are installed, add queries of their own, some without SQL.
    assert set(QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("missing", ["public_tokenizers", "frameops.llm", "corpus_pipeline"])
def test_catalog_without_the_text_operators(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; from frameops.catalog import QUERIES;"
        " assert set(e.queries()) == set(QUERIES) == set(e.oracle_sql())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
