"""Queries for comparison, fingerprints and roll-up reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameops.catalog.registry import query
from frameops.evaluation import report
from frameops.evaluation.compare import (
    column_difference,
    compare,
    compare_by,
    detail_text,
    difference,
    differing_columns,
    normalise,
    preview,
)
from frameops.evaluation.fingerprint import content_hash, content_hash_by
from frameops.operators.frame import sort

# --- comparison -----------------------------------------------------------------


def _shown(verdict):
    """A verdict with its lists as text."""
    lists = ("actual_columns", "expected_columns", "missing_columns", "extra_columns")
    return verdict.select(
        *[F.array_join(c, ",").alias(c) if c in lists else c for c in verdict.columns]
    )


def _verdict_sql(reason, actual, expected, actual_columns, expected_columns, summary, missing="", extra=""):
    return (
        f"SELECT '{reason}' = 'match' AS match, '{reason}' AS reason, a AS actual_n_rows, e AS expected_n_rows,"
        f" '{actual_columns}' AS actual_columns, '{expected_columns}' AS expected_columns,"
        f" '{missing}' AS missing_columns, '{extra}' AS extra_columns, {summary} AS summary"
        f" FROM (SELECT ({actual}) AS a, ({expected}) AS e)"
    )


_LINES = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
_LINE_LIST = ",".join(_LINES)
_ALL_LINES = "SELECT count(*) FROM lineitem"


@query(_verdict_sql("match", _ALL_LINES, _ALL_LINES, "l_returnflag,l_linenumber,l_orderkey,l_extendedprice",
                    _LINE_LIST, "'match'"))
def compare_match(t):
    expected = t.lineitem.select(*_LINES)
    moved = t.lineitem.select(
        "l_returnflag", "l_linenumber", "l_orderkey", (F.col("l_extendedprice") + 1e-9).alias("l_extendedprice")
    )
    return _shown(compare(moved, expected))


@query(_verdict_sql("content", _ALL_LINES, _ALL_LINES, _LINE_LIST, _LINE_LIST,
                    "'content: ' || a || ' rows match in count but values/order differ'"))
def compare_content(t):
    expected = t.lineitem.select(*_LINES)
    changed = expected.withColumn(
        "l_extendedprice", F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice"))
    )
    return _shown(compare(changed, expected))


@query(_verdict_sql("row_count", "SELECT count(*) FROM lineitem WHERE l_linenumber <> 7", _ALL_LINES, _LINE_LIST,
                    _LINE_LIST, "'row_count: actual=' || a || ' expected=' || e"))
def compare_row_count(t):
    expected = t.lineitem.select(*_LINES)
    return _shown(compare(expected.where(F.col("l_linenumber") != 7), expected))


@query(_verdict_sql("empty_actual", "SELECT CAST(0 AS BIGINT)", _ALL_LINES, _LINE_LIST, _LINE_LIST,
                    "'empty_actual: generated code produced an empty DataFrame'"))
def compare_empty(t):
    expected = t.lineitem.select(*_LINES)
    return _shown(compare(expected.where(F.col("l_linenumber") < 0), expected))


@query(_verdict_sql("column_set", _ALL_LINES, "SELECT count(*) FROM orders", _LINE_LIST, "l_orderkey,o_custkey,o_status",
                    "'column_set: missing=[''o_custkey'', ''o_status'']"
                    "  extra=[''l_extendedprice'', ''l_linenumber'', ''l_returnflag'']'",
                    "o_custkey,o_status", "l_extendedprice,l_linenumber,l_returnflag"))
def compare_column_set(t):
    expected = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderstatus").alias("o_status")
    )
    return _shown(compare(t.lineitem.select(*_LINES), expected))


_SIDES = """
  SELECT o_custkey AS run, o_orderkey, round(o_totalprice + CASE WHEN o_custkey % 5 = 1 AND o_orderstatus = 'F'
    THEN 1 ELSE 0 END, 6) AS price, 1 AS a, 0 AS e FROM orders
    WHERE o_custkey % 5 <> 2 AND NOT (o_custkey % 5 = 3 AND o_orderstatus = 'O')
  UNION ALL
  SELECT o_custkey, o_orderkey, round(o_totalprice, 6), 0, 1 FROM orders"""


@query(f"""
WITH sides AS ({_SIDES}),
rows AS (SELECT run, o_orderkey, price, sum(a) AS a, sum(e) AS e FROM sides GROUP BY ALL),
runs AS (SELECT run, sum(a) AS a, sum(e) AS e, sum(CASE WHEN a <> e THEN 1 ELSE 0 END) AS d FROM rows GROUP BY run),
judged AS (SELECT *, CASE WHEN a = 0 THEN 'empty_actual' WHEN a <> e THEN 'row_count' WHEN d > 0 THEN 'content'
  ELSE 'match' END AS reason FROM runs)
SELECT run, reason = 'match' AS match, reason, CAST(a AS BIGINT) AS actual_n_rows, CAST(e AS BIGINT) AS expected_n_rows,
  CASE reason WHEN 'empty_actual' THEN 'empty_actual: generated code produced an empty DataFrame'
    WHEN 'row_count' THEN 'row_count: actual=' || CAST(a AS BIGINT) || ' expected=' || CAST(e AS BIGINT)
    WHEN 'content' THEN 'content: ' || CAST(a AS BIGINT) || ' rows match in count but values/order differ'
    ELSE 'match' END AS summary
FROM judged""")
def compare_many_runs(t):
    expected = t.orders.select(F.col("o_custkey").alias("run"), "o_orderkey", F.col("o_totalprice").alias("price"))
    group = F.col("o_custkey") % 5
    changed = F.when((group == 1) & (F.col("o_orderstatus") == "F"), 1.0).otherwise(0.0)
    actual = t.orders.where((group != 2) & ~((group == 3) & (F.col("o_orderstatus") == "O"))).select(
        F.col("o_custkey").alias("run"), "o_orderkey", (F.col("o_totalprice") + changed).alias("price")
    )
    return compare_by(actual, expected, ["run"])


_LINE = """string_agg('{"o_orderkey":' || o_orderkey || ',"day":"' || CAST(day AS DATE) || '","status":"' || status || '"}',
  chr(10) ORDER BY o_orderkey)"""


@query(f"""
WITH e AS (SELECT o_orderstatus || o_custkey % 3 AS run, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status,
  o_custkey % 3 AS part FROM orders),
a AS (SELECT run, o_orderkey, CAST(day + CAST(CASE WHEN part = 1 AND o_orderkey % 50 = 7 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS day,
  CASE WHEN part = 1 AND o_orderkey % 70 = 5 THEN 'X' ELSE status END AS status FROM e
  WHERE part < 2 OR o_orderkey % 2 = 0),
judged AS (SELECT run, count(a.o_orderkey) AS n_a, count(*) AS n_e, count(*) FILTER (a.day <> e.day) AS days,
  count(*) FILTER (a.status <> e.status) AS statuses FROM e LEFT JOIN a USING (run, o_orderkey) GROUP BY run),
first_a AS (SELECT run, {_LINE} AS shown FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY o_orderkey) AS r FROM a)
  WHERE r <= 3 GROUP BY run),
first_e AS (SELECT run, {_LINE} AS shown FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY o_orderkey) AS r FROM e)
  WHERE r <= 3 GROUP BY run)
SELECT run, CASE WHEN n_a = 0 THEN 'empty_actual' WHEN n_a <> n_e THEN 'row_count' WHEN days + statuses > 0 THEN 'content'
  ELSE 'match' END AS reason,
  coalesce(first_a.shown, '<empty>') AS actual_preview, first_e.shown AS expected_preview,
  CASE WHEN n_a = n_e AND days + statuses > 0 THEN 'columns with differing values: ['
    || concat_ws(', ', CASE WHEN days > 0 THEN '''day''' END, CASE WHEN statuses > 0 THEN '''status''' END) || ']' END AS detail
FROM judged LEFT JOIN first_a USING (run) LEFT JOIN first_e USING (run)""")
def compare_many_runs_details(t):
    """A third of the runs as expected, a third with other days and states, a third with rows missing."""
    part, key = F.col("o_custkey") % 3, F.col("o_orderkey")
    run = F.concat("o_orderstatus", part.cast("string")).alias("run")
    day, status = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
    expected = t.orders.select(run, "o_orderkey", day.alias("day"), status.alias("status"))
    actual = t.orders.where((part < 2) | (key % 2 == 0)).select(
        run,
        "o_orderkey",
        F.when((part == 1) & (key % 50 == 7), F.date_add(day, 1)).otherwise(day).alias("day"),
        F.when((part == 1) & (key % 70 == 5), "X").otherwise(status).alias("status"),
    )
    found = compare_by(actual, expected, ["run"], previews=3, details=True)
    return found.select("run", "reason", "actual_preview", "expected_preview", "detail")


@query("""
WITH a AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
e AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)
SELECT coalesce(a.l_partkey, e.l_partkey) AS l_partkey, coalesce(a.l_quantity, e.l_quantity) AS l_quantity,
  coalesce(a.n, 0) AS n_actual, coalesce(e.n, 0) AS n_expected
FROM a FULL JOIN e ON a.l_partkey = e.l_partkey AND a.l_quantity = e.l_quantity
WHERE coalesce(a.n, 0) <> coalesce(e.n, 0)""")
def row_difference(t):
    slim = t.lineitem.select("l_partkey", "l_quantity", "l_returnflag")
    return difference(
        slim.where(F.col("l_returnflag") != "R").drop("l_returnflag"),
        slim.where(F.col("l_returnflag") != "A").drop("l_returnflag"),
    )


def _perturbed_orders(t):
    columns = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    expected = t.orders.select(*columns)
    actual = expected.select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_custkey") % 4 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 10 == 3, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return actual, expected


_COLUMN_COUNTS = """
SELECT CAST(1 AS BIGINT) AS position, 'o_orderkey' AS "column", CAST(0 AS BIGINT) AS n_different
UNION ALL SELECT 2, 'o_custkey', 0 UNION ALL SELECT 3, 'o_totalprice', count(*) FROM orders WHERE o_custkey % 4 = 0 AND o_totalprice <> 0
UNION ALL SELECT 4, 'o_orderstatus', count(*) FROM orders WHERE o_orderkey % 10 = 3"""


@query(_COLUMN_COUNTS)
def differing_columns_by_key(t):
    return differing_columns(*_perturbed_orders(t), key="o_orderkey")


@query(_COLUMN_COUNTS)
def differing_columns_by_position(t):
    # The first column is unique, so the sorted rows pair up as they do by key.
    return differing_columns(*_perturbed_orders(t))


@query("SELECT 'columns with differing values: [''o_totalprice'', ''o_orderstatus'']' AS detail"
       " FROM (SELECT count(*) AS n FROM orders WHERE o_custkey % 4 = 0) WHERE n > 0")
def mismatch_detail(t):
    return detail_text(differing_columns(*_perturbed_orders(t), key="o_orderkey"))


@query(
    "SELECT n_name, count(*) AS n, 'r_name' AS missing, 'n_name,n_nationkey' AS extra FROM nation"
    " JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"
)
def column_set_difference(t):
    expected = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_regionkey", "r_name")
    missing, extra = column_difference(t.nation.columns, expected.columns)
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.lit(",".join(missing)).alias("missing"), F.lit(",".join(extra)).alias("extra")
    )


@query(_verdict_sql("match", "SELECT count(*) FROM documents", "SELECT count(*) FROM documents",
                    "text,doc_id,n_chars", "doc_id,text,n_chars", "'match'"))
def compare_long_texts(t):
    expected = t.documents.select("doc_id", "text", "n_chars")
    return _shown(compare(expected.select("text", "doc_id", "n_chars"), expected))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 3) AS part FROM lineitem")
def normalise_floats(t):
    slim = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7).alias("part"))
    return normalise(slim, 3)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 5")
def preview_rows(t):
    slim = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return preview(sort(slim, "c_custkey", spread_ties=False))


# --- fingerprints ---------------------------------------------------------------


def _field(text):
    return f"coalesce(length({text}) || ':' || {text}, 'N')"


def _float(name):
    return f"CAST(CAST(round({name}, 6) AS DECIMAL(38, 6)) AS VARCHAR)"


def _hash_sql(table, names, fields, by=""):
    row = " || ',' || ".join(_field(f) for f in fields)
    pieces = ", ".join(
        f"sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS UBIGINT) AS HUGEINT)) AS p{i}" for i in range(2)
    )
    joined = " || '|' || ".join(["'" + names + "'", "n", "p0", "p1"])
    group = f"GROUP BY {by}" if by else ""
    keep = f"{by}, " if by else ""
    return (
        f"SELECT {keep}sha256({joined}) AS content_hash, n AS n_rows FROM (SELECT {keep}count(*) AS n, {pieces}"
        f" FROM (SELECT {keep}sha256({row}) AS h FROM {table}) {group})"
    )


@query(
    _hash_sql(
        "orders",
        "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
        ["CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", _float("o_totalprice"),
         "CAST(o_orderdate AS VARCHAR)", "o_orderpriority"],
    )
)
def table_fingerprint(t):
    return content_hash(
        t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    )


@query(
    _hash_sql(
        "lineitem",
        "l_orderkey,l_linenumber,l_quantity,l_extendedprice",
        ["CAST(l_orderkey AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)", _float("l_quantity"),
         _float("l_extendedprice")],
        by="l_returnflag",
    )
)
def fingerprint_by_group(t):
    slim = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return content_hash_by(slim, ["l_returnflag"])


@query(
    _hash_sql(
        "(SELECT d.doc_id, text, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
        "doc_id,text,quality",
        ["CAST(doc_id AS VARCHAR)", "text", "CAST(quality AS VARCHAR)"],
    )
)
def fingerprint_with_nulls(t):
    return content_hash(
        t.documents.join(t.labels, "doc_id", "left").select("doc_id", "text", "quality")
    )


@query(
    "SELECT sha256('<empty>:event_id,value') AS content_hash, count(*) AS n_rows FROM events WHERE value < -1000000"
)
def fingerprint_of_empty(t):
    return content_hash(t.events.where(F.col("value") < -1000000).select("event_id", "value"))


# --- reports ----------------------------------------------------------------------

_OUTCOMES = """
SELECT 'e' || event_id AS id, event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS size,
  CAST(user_id % 5 + 1 AS INTEGER) AS difficulty, CAST(user_id % 3 AS INTEGER) AS run, value / 10 AS latency_sec,
  CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'result = ' || event_type END AS generated_code,
  CASE WHEN event_id % 13 = 0 THEN 'timeout' END AS generation_error,
  CASE WHEN value < 10 THEN 'invalid syntax' END AS syntax_error,
  CASE WHEN value >= 10 AND value < 20 THEN 'ColumnNotFoundError: ' || event_type END AS run_error,
  user_id % 17 <> 0 AS compared, value > 30 AS same,
  CASE WHEN value > 30 THEN 'match' WHEN value > 27 THEN 'content' WHEN value > 24 THEN 'row_count'
    ELSE 'column_set' END AS verdict,
  CASE event_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'constrained' WHEN 2 THEN 'exec_retry1' END AS cascade_level,
  CASE WHEN event_id % 19 <> 0 THEN '{}' END AS json_plan
FROM events"""

_FLAGGED = f"""
outcomes AS ({_OUTCOMES}),
parsed AS (SELECT *, generation_error IS NULL AND trim(generated_code) <> '' AS converted,
  json_plan IS NOT NULL AS plan_valid FROM outcomes),
ran AS (SELECT *, converted AND syntax_error IS NULL AS parses FROM parsed),
judged AS (SELECT *, parses AND run_error IS NULL AS runs FROM ran),
results AS (SELECT *, runs AND compared AND same AS matches, CASE
  WHEN generation_error IS NOT NULL THEN 'generation failed: ' || generation_error
  WHEN NOT converted THEN 'EMPTY_TEXT' WHEN NOT parses THEN 'SyntaxError: ' || syntax_error
  WHEN NOT runs THEN run_error WHEN NOT compared THEN 'no expected parquet for this record'
  WHEN NOT same THEN verdict || ': differs' END AS error FROM judged),
staged AS (SELECT *, CASE WHEN matches THEN 'match' WHEN runs AND compared THEN verdict WHEN runs THEN 'wrong-output'
  WHEN parses THEN 'crash' ELSE 'syntax' END AS stage,
  CASE WHEN matches THEN 'match' WHEN runs AND compared THEN verdict WHEN runs THEN 'wrong-output'
  WHEN parses THEN 'crash' WHEN converted THEN 'syntax' WHEN plan_valid THEN 'convert-fail' ELSE 'invalid-plan' END
  AS plan_stage FROM results)"""


def _results_sql(select, empty="empty generation"):
    return "WITH" + _FLAGGED.replace("EMPTY_TEXT", empty) + "\n" + select


def _outcomes(t):
    value, event = F.col("value"), F.col("event_id")
    verdict = (
        F.when(value > 30, "match").when(value > 27, "content").when(value > 24, "row_count").otherwise("column_set")
    )
    comparison = F.struct(
        (value > 30).alias("match"), verdict.alias("reason"), F.concat(verdict, F.lit(": differs")).alias("summary")
    )
    level = F.when(event % 4 == 0, "fast").when(event % 4 == 1, "constrained").when(event % 4 == 2, "exec_retry1")
    return t.events.select(
        F.concat(F.lit("e"), event).alias("id"),
        F.array("event_type", F.when(value > 50, "high").otherwise("low")).alias("tags"),
        (F.col("user_id") % 5 + 1).cast("int").alias("difficulty"),
        (F.col("user_id") % 3).cast("int").alias("run"),
        (value / 10).alias("latency_sec"),
        F.when(event % 11 == 0, " ").otherwise(F.concat(F.lit("result = "), "event_type")).alias("generated_code"),
        F.when(event % 13 == 0, "timeout").alias("generation_error"),
        F.when(value < 10, "invalid syntax").alias("syntax_error"),
        F.when((value >= 10) & (value < 20), F.concat(F.lit("ColumnNotFoundError: "), "event_type")).alias("run_error"),
        F.when(F.col("user_id") % 17 != 0, comparison).alias("comparison"),
        level.alias("cascade_level"),
        F.when(event % 19 != 0, "{}").alias("json_plan"),
    )


def _results(t, from_plans=False):
    return report.tier_flags(_outcomes(t), from_plans)


@query(_results_sql("SELECT id, parses, runs, matches, error, stage FROM staged"))
def result_tiers(t):
    return _results(t).select("id", "parses", "runs", "matches", "error", report.stage().alias("stage"))


@query(_results_sql("SELECT id, plan_valid, converted, parses, runs, matches, error, plan_stage AS stage FROM staged",
                    "empty conversion"))
def result_tiers_of_plans(t):
    return _results(t, True).select(
        "id", *report.PLAN_TIERS, "error", report.stage(from_plans=True).alias("stage")
    )


_COUNTED = "sum(CAST({0} AS INTEGER)) AS {0}, sum(CAST({0} AS INTEGER)) * 100.0 / count(*) AS {0}_pct"


@query(_results_sql(
    "SELECT n, CAST(parses AS BIGINT) AS parses, round(parses_pct, 6) AS parses_pct, CAST(runs AS BIGINT) AS runs,"
    " round(runs_pct, 6) AS runs_pct, CAST(matches AS BIGINT) AS matches, round(matches_pct, 6) AS matches_pct,"
    " round(latency, 6) AS avg_latency FROM (SELECT count(*) AS n, "
    + ", ".join(_COUNTED.format(c) for c in report.TIERS)
    + ", avg(coalesce(latency_sec, 0)) AS latency FROM staged)"))
def report_overall(t):
    totals = report.overall(_results(t))
    return totals.select(*[F.round(c, 6).alias(c) if c.endswith(("_pct", "latency")) else c for c in totals.columns])


def _hits_sql(group, source="staged"):
    return _results_sql(
        f"SELECT {group}, CAST(sum(CAST(matches AS INTEGER)) AS BIGINT) AS hits, count(*) AS total,"
        f" round(sum(CAST(matches AS INTEGER)) * 100.0 / count(*), 6) AS pct FROM {source} GROUP BY {group}"
    )


def _rounded(hits):
    return hits.withColumn("pct", F.round("pct", 6))


@query(_hits_sql("tag", "(SELECT matches, unnest([event_type, size]) AS tag FROM staged)"))
def report_by_tag(t):
    return _rounded(report.by_tag(_results(t)))


@query(_hits_sql("difficulty"))
def report_by_difficulty(t):
    return _rounded(report.by_difficulty(_results(t)))


@query(_hits_sql("cascade_level", "(SELECT * FROM staged WHERE cascade_level IS NOT NULL)"))
def report_by_level(t):
    return _rounded(report.by_level(_results(t)))


def _stages_sql(stage):
    listed = ", ".join(f"'{s}'" for s in report.STAGE_ORDER)
    return _results_sql(
        f"SELECT {stage} AS stage, count(*) AS n, CAST(list_position([{listed}], {stage}) AS BIGINT) AS position"
        f" FROM staged WHERE NOT matches GROUP BY {stage}"
    )


@query(_stages_sql("stage"))
def report_by_stage(t):
    return report.by_stage(_results(t))


@query(_stages_sql("plan_stage"))
def report_by_stage_of_plans(t):
    return report.by_stage(_results(t, True), from_plans=True)


@query(_results_sql("SELECT stage, id, error FROM staged WHERE NOT matches"))
def report_failures(t):
    return report.failures(_results(t))


def _with_memory(results):
    return results.withColumns(
        {
            "vram_gb": F.when(F.col("run") == 0, 16.0).when(F.col("run") == 1, 10.0).otherwise(8.0),
            "ram_gb": F.when(F.col("run") == 0, 32.0).otherwise(12.0),
        }
    )


@query(_results_sql(
    "SELECT run, n_correct, round(total_sec, 3) AS total_sec, vram_gb, ram_gb,"
    " round(n_correct / (total_sec * pow(vram_gb, 0.1) * pow(ram_gb, 0.01)), 9) AS score FROM ("
    "SELECT run, CAST(sum(CAST(matches AS INTEGER)) AS BIGINT) AS n_correct, sum(coalesce(latency_sec, 0)) AS total_sec,"
    " CASE run WHEN 0 THEN 16.0 WHEN 1 THEN 10.0 ELSE 8.0 END::DOUBLE AS vram_gb,"
    " CASE run WHEN 0 THEN 32.0 ELSE 12.0 END::DOUBLE AS ram_gb FROM staged GROUP BY run)"))
def report_score(t):
    scored = report.score(_with_memory(_results(t)))
    return scored.withColumns({"total_sec": F.round("total_sec", 3), "score": F.round("score", 9)})


def _runs_sql():
    parts = []
    for run in (0, 1, 2):
        here = f"run = {run}"
        parts += [
            f"count(*) FILTER (WHERE {here}) AS n_{run}",
            f"round(count(*) FILTER (WHERE {here} AND runs) * 100.0 / count(*) FILTER (WHERE {here}), 6) AS runs_pct_{run}",
            f"round(count(*) FILTER (WHERE {here} AND matches) * 100.0 / count(*) FILTER (WHERE {here}), 6) AS matches_pct_{run}",
            f"round(avg(latency_sec) FILTER (WHERE {here}), 6) AS latency_{run}",
        ]
    return _results_sql(f"SELECT event_type, {', '.join(parts)} FROM staged GROUP BY event_type")


@query(_runs_sql())
def report_runs_side_by_side(t):
    results = _results(t).withColumn("event_type", F.get("tags", F.lit(0)))
    side = report.compare_runs(results, [0, 1, 2], by="event_type")
    return side.select(*[F.round(c, 6).alias(c) if "pct" in c or "latency" in c else c for c in side.columns])
