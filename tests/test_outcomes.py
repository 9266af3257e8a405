"""The log of outcomes: what runs again, and what does not."""

import pytest
from pyspark.sql import functions as F

from frameops.corpus.build import build_question_corpus, build_references
from frameops.evaluation.harness import ANSWER_SCHEMA, Resume, evaluate_sql
from frameops.evaluation.outcomes import OutcomeLog, content_state, file_state, table_states, with_keys


def answers(spark, texts, tables=("t",)):
    rows = [(i, [], 1, list(tables), text, None, 0.0) for i, text in texts.items()]
    return spark.createDataFrame(rows, ANSWER_SCHEMA)


def calls(results):
    return {r.id: r.judged_by_call for r in results.collect()}


def test_second_call_runs_the_rest(spark, tmp_path):
    for name in "tu":
        spark.range(5).write.parquet(f"{tmp_path}/{name}")
    load = lambda session, name: session.read.parquet(f"{tmp_path}/{name}")
    resume = Resume(f"{tmp_path}/log")
    few = {f"q{i}": f"SELECT id FROM t WHERE id > {i}" for i in range(4)}
    first = calls(evaluate_sql(answers(spark, few), load, {}, resume=resume))
    assert len(first) == 4 and len(set(first.values())) == 1
    more = answers(spark, {**few, "q9": "SELECT 9 FROM t", "bad": "SELECT x FROM t"}).unionAll(
        answers(spark, {"both": "SELECT t.id FROM t JOIN u USING (id)"}, "tu")
    ).unionAll(answers(spark, {"u": "SELECT id FROM u"}, "u"))
    second = calls(evaluate_sql(more, load, {}, resume=resume))
    assert {i: c for i, c in second.items() if i in first} == first
    assert len(set(second.values())) == 2 and len(second) == 8
    # A changed text, and a failed run that is asked for again.
    changed = answers(spark, {**few, "q0": "SELECT 0 FROM t", "bad": "SELECT x FROM t"})
    third = calls(evaluate_sql(changed, load, {}, resume=Resume(f"{tmp_path}/log", run_failed_again=True)))
    assert {i for i in third if third[i] not in second.values()} == {"q0", "bad"}
    # A changed table: only what may read it.
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/u")
    fourth = calls(evaluate_sql(more, load, {}, resume=resume))
    assert {i for i in fourth if fourth[i] not in (*second.values(), *third.values())} == {"both", "u"}
    # Other expected outputs.
    fifth = calls(evaluate_sql(more, load, {}, resume=Resume(f"{tmp_path}/log", version="2")))
    assert not set(fifth.values()) & {*second.values(), *fourth.values()}


def test_a_lost_driver_costs_one_batch(spark, tmp_path):
    queries = spark.range(10).select(F.col("id").cast("string").alias("key"), "id")
    log = OutcomeLog(spark, f"{tmp_path}/log", "value bigint")
    ran = []

    def work(row):
        if row["id"] == 7 and len(ran) < 8:
            raise KeyboardInterrupt
        ran.append(row["id"])
        return (row["id"] * 10,)

    with pytest.raises(KeyboardInterrupt):
        log.run(queries, work, at_once=1, rows_per_append=3)
    assert log.rows().count() == 6
    ran += [None] * 8
    found = OutcomeLog(spark, log.folder, log.schema).run(queries, work, at_once=1, rows_per_append=3)
    assert {r.key: r.value for r in found.collect()} == {str(i): i * 10 for i in range(10)}
    assert {r.call == log.call for r in found.where("key < '6'").collect()} == {True}
    assert found.where(F.col("call") != log.call).count() == 4


def test_states(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert file_state(t) == file_state(spark.read.parquet(f"{tmp_path}/t")) != content_state(t)
    assert content_state(t) == content_state(spark.range(5).repartition(3)) == file_state(spark.range(5))
    states = table_states(["t", "none"], lambda name: spark.read.parquet(f"{tmp_path}/{name}"))
    assert states == {"t": file_state(t), "none": "missing"}
    queries = spark.createDataFrame([("a", ["t", "u"]), ("a", ["u", "t", "t"]), ("a", ["t"]), (None, None), ("", [])], "q string, tables array<string>")
    keys = [r.key for r in with_keys(queries, ["q"], {"t": "1", "u": "2"}).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 4
    other = [r.key for r in with_keys(queries, ["q"], {"t": "1", "u": "3"}).collect()]
    assert [a == b for a, b in zip(keys, other)] == [False, False, True, True, True]


def test_corpora_go_on(spark, tmp_path):
    for db in "ab":
        spark.range(3).write.parquet(f"{tmp_path}/{db}")
    load = lambda session, db: {"t": session.read.parquet(f"{tmp_path}/{db}")}
    rows = [("a1", "a", "?", "SELECT id FROM t"), ("a2", "a", "?", "SELECT id FROM t WHERE id > 9"), ("b1", "b", "?", "SELECT nope FROM t")]
    questions = spark.createDataFrame(rows, "id string, db_id string, question string, sql string")
    where = {"out": f"{tmp_path}/out", "log": f"{tmp_path}/log"}
    kept, outcomes = build_question_corpus(questions.where("db_id = 'a'"), load, **where)
    assert kept.count() == 1 and {r.id: r.status for r in outcomes.collect()} == {"a1": "ok", "a2": "empty"}
    kept, outcomes = build_question_corpus(questions, load, **where)
    assert {r.id: r.status for r in outcomes.collect()} == {"a1": "ok", "a2": "empty", "b1": "failed"}
    assert kept.first().expected_n_rows == 3
    assert OutcomeLog(spark, where["log"], "id string").rows().groupBy("call").count().count() == 2

    ran = []
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in "ab"}
    catalog = {n: lambda t, n=n: ran.append(n) or t[n].where("id > 0") for n in "ab"}
    for _ in range(2):
        records, _ = build_references(spark, catalog, tables, {"a": ["a"], "b": ["b"]}, f"{tmp_path}/refs", log=f"{tmp_path}/rlog")
        assert {r.id: r.expected_n_rows for r in records.collect()} == {"a": 2, "b": 2}
    assert sorted(ran) == ["a", "b"]
