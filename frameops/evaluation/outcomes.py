"""A log of outcomes, so that a call over many queries goes on where an earlier one ended.

An outcome is kept under a key: a digest of the query's text and of the state of the tables it may read. It is
appended with its batch; a later call, after a lost driver or with more queries, finds the keys and runs the rest. A
query whose text or tables have changed has another key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from frameops.evaluation.fingerprint import content_hash
from frameops.jobs import rows_of_jobs
from frameops.session import stage

# Outcomes appended together; a lost driver costs as many at the most.
ROWS_PER_APPEND = 32

FACTS = "key string, call string, "


def content_state(df: DataFrame) -> str:
    """The content of a table: a full read, the same wherever the rows are kept."""
    return content_hash(df).first()["content_hash"]


def file_state(df: DataFrame) -> str:
    """Paths, sizes and times of the files a table is read from, without reading its rows; of a table that is not read
    from files, its content."""
    try:
        files = df.select(*[f"_metadata.{c}" for c in ("file_path", "file_size", "file_modification_time")]).distinct()
    except AnalysisException:
        return content_state(df)
    return "files:" + content_state(files)


def table_states(
    names: Iterable, load: Callable[[object], DataFrame], state: Callable[[DataFrame], str] = file_state, at_once: int = 4
) -> dict:
    """The state of each table, ``missing`` for one that cannot be loaded: its queries fail anew once it can."""

    def one(name) -> str:
        try:
            return state(load(name))
        except Exception:  # whatever keeps a table from being read
            return "missing"

    names = list(names)
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return dict(zip(names, pool.map(one, names)))


def query_key(parts: Iterable[Column], tables: Column) -> Column:
    """The key of a query: its texts, and ``tables``, an array of (table, state). Nulls count."""
    facts = F.struct(F.array(*[p.cast("string") for p in parts]).alias("texts"), F.array_sort(tables).alias("tables"))
    return F.sha2(F.to_json(facts, {"ignoreNullFields": "false"}), 256)


def with_keys(
    queries: DataFrame, texts: Iterable[str], states: Mapping[str, str], version: str = "", tables: str = "tables"
) -> DataFrame:
    """``queries`` with their ``key``. The column ``tables`` names the tables a query may read; ``version`` stands for
    all else that outcomes depend on, the expected outputs for instance."""
    known = F.create_map(*[F.lit(x) for pair in sorted(states.items()) for x in pair]) if states else None
    state = lambda t: F.coalesce(F.try_element_at(known, t), F.lit("missing")) if states else F.lit("missing")
    names = F.array_distinct(F.coalesce(F.col(tables), F.array().cast("array<string>")))
    read = F.transform(names, lambda t: F.struct(t.alias("table"), state(t).alias("state")))
    return queries.withColumn("key", query_key([F.lit(version), *map(F.col, texts)], read))


@dataclass
class OutcomeLog:
    """Outcomes below a folder, with the columns of ``schema``. One driver appends at a time."""

    spark: SparkSession
    folder: str
    schema: str
    call: str = field(default_factory=lambda: uuid.uuid4().hex)

    def rows(self) -> DataFrame:
        """(key, call, outcome): one row per key, of any of the calls that wrote it."""
        schema = FACTS + self.schema
        try:
            kept = self.spark.read.schema(schema).parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            kept = self.spark.createDataFrame([], schema)
        return kept.dropDuplicates(["key"])

    def run(
        self,
        queries: DataFrame,
        work: Callable[[Row], tuple],
        at_once: int = 4,
        again: Column | None = None,
        rows_per_append: int = ROWS_PER_APPEND,
    ) -> DataFrame:
        """The outcomes (key, call, outcome) of all ``queries`` (key, ...); ``work`` runs only those without one.

        Outcomes for which ``again`` holds are made anew, for instance those that failed on a lost cluster.
        """
        queries = stage(queries, "queries")
        done = self.rows() if again is None else self.rows().where(~F.coalesce(again, F.lit(False)))
        todo = queries.join(stage(done.select("key"), "done"), "key", "left_anti").dropDuplicates(["key"])
        rows = todo.orderBy("key").toLocalIterator()
        made = rows_of_jobs(
            self.spark, rows, lambda row: (row["key"], self.call, *work(row)), FACTS + self.schema, at_once,
            into=self.folder, rows_per_write=rows_per_append,
        )
        # What this call made goes before what it made anew.
        newest = F.max_by(F.struct(*made.columns), F.col("call") == self.call)
        kept = made.join(queries.select("key").distinct(), "key", "left_semi").groupBy("key").agg(newest.alias("row"))
        return kept.select("row.*")
