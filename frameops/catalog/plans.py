"""Queries for declarative plans, one at a time and as tables of plan texts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from frameops.catalog import relational  # noqa: F401  (registers the queries repeated here)
from frameops.catalog.registry import QUERIES, query
from frameops.plans import batch
from frameops.plans.run import run_plan


def _op(kind, **fields):
    return {"type": kind, **fields}


def _agg(agg, column, alias):
    return {"agg": agg, "column": column, "alias": alias}


def _by(*names, **flags):
    return [{"name": n, "descending": flags.get(n, False)} for n in names]


# Plans by the name of the query that runs them or that they repeat.
PLANS = {
    "german_documents": {
        "source_table": "documents",
        "operations": [
            _op("filter", conditions=[{"column": "lang", "op": "==", "value": "de"}], combine="and"),
            _op("select", columns=["doc_id", "source", "n chars"]),
        ],
    },
    "filter_any": {
        "source_table": "orders",
        "operations": [
            _op(
                "filter",
                conditions=[
                    {"column": "o totalprice", "op": ">=", "value": 450000},
                    {"column": "o_orderstatus", "op": "==", "value": "P"},
                    {"column": "o_orderkey", "op": "<", "value": 10},
                ],
                combine="or",
            ),
            _op("select", columns=["o_orderkey", "o totalprice"]),
        ],
    },
    "largest_events": {
        "source_table": "events",
        "operations": [
            _op("filter", conditions=[{"column": "event_type", "op": "!=", "value": "error"}]),
            _op("sort", columns=_by("value", "event_id", value=True, event_id=True)),
            _op("head", n=15),
            _op("select", columns=["event_id", "user_id", "value"]),
        ],
    },
    "turns_by_role": {
        "source_table": "conversations",
        "operations": [
            _op("group_by", columns=["role"], aggregations=[_agg("len", "*", "n_turns")]),
            _op("sort", columns=_by("role")),
        ],
    },
    "documents_by_lang_and_source": {
        "source_table": "documents",
        "operations": [
            _op("group_by", columns=["lang", "source"], aggregations=[
                _agg("len", "doc_id", "n_documents"), _agg("sum", "n_chars", "chars")]),
        ],
    },
    "n_unique": {
        "source_table": "orders",
        "operations": [
            _op("group_by", columns=["o_orderstatus"], aggregations=[_agg("n_unique", "o_custkey", "customers")]),
        ],
    },
    "join_labels": {
        "source_table": "documents",
        "operations": [
            _op("join", table="labels", on="doc_id", how="left"),
            _op("select", columns=["doc_id", "n_chars", "quality"]),
        ],
    },
    "outer_join": {
        "source_table": "nation",
        "operations": [
            _op("join", table="region", on="n_regionkey == r_regionkey", how="outer"),
            _op("select", columns=["n_name", "n_regionkey", "r_regionkey", "r_name"]),
        ],
    },
    "dearest_orders": {
        "source_table": "customer",
        "operations": [
            _op("filter", conditions=[{"column": "c_mktsegment", "op": "==", "value": "BUILDING"}]),
            _op("join", table="orders", left_on="c_custkey", right_on="o_custkey", how="inner"),
            _op("filter", conditions=[{"column": "o_totalprice", "op": ">", "value": 1000.5}]),
            _op("group_by", columns=["c_custkey"], aggregations=[
                _agg("sum", "o_orderkey", "key_sum"), _agg("max", "o_totalprice", "best"), _agg("len", "*", "n")]),
            _op("sort", columns=_by("best", "c_custkey", best=True)),
            _op("head", n=10),
        ],
    },
    "rank_dense": {
        "source_table": "orders",
        "operations": [
            _op("select", columns=["o_orderkey", "o_orderstatus", "o_totalprice"]),
            _op("with_columns", expressions=[
                {"column": "o_totalprice", "expr": "rank", "method": "dense", "descending": True,
                 "over": "o_orderstatus", "alias": "place"}]),
        ],
    },
    "first_last": {
        "source_table": "orders",
        "operations": [
            _op("sort", columns=_by("o_orderkey")),
            _op("group_by", columns=["o_custkey"], aggregations=[
                _agg("first", "o_totalprice", "first_price"), _agg("last", "o_totalprice", "last_price")]),
        ],
    },
}


def _run(t, name):
    plan = PLANS[name]
    used = [plan["source_table"], *[o["table"] for o in plan["operations"] if o["type"] == "join"]]
    return run_plan(json.dumps(plan), {n: t[n] for n in used})


@query(QUERIES["german_documents"].sql)
def plan_filter_select(t):
    return _run(t, "german_documents")


@query(QUERIES["filter_any"].sql)
def plan_filter_any(t):
    return _run(t, "filter_any")


@query(QUERIES["largest_events"].sql)
def plan_top_k(t):
    return _run(t, "largest_events")


@query(QUERIES["turns_by_role"].sql)
def plan_count_by_group(t):
    return _run(t, "turns_by_role")


@query(QUERIES["documents_by_lang_and_source"].sql)
def plan_group_two_columns(t):
    return _run(t, "documents_by_lang_and_source")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def plan_n_unique(t):
    return _run(t, "n_unique")


@query(QUERIES["left_join_labels"].sql)
def plan_left_join(t):
    return _run(t, "join_labels")


@query("SELECT n_name, n_regionkey, r_regionkey, r_name FROM nation FULL JOIN region ON n_regionkey = r_regionkey")
def plan_outer_join(t):
    return _run(t, "outer_join")


@query(
    "SELECT c_custkey, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, max(o_totalprice) AS best, count(*) AS n FROM customer"
    " JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000.5"
    " GROUP BY c_custkey ORDER BY best DESC, c_custkey LIMIT 10"
)
def plan_join_group_top(t):
    return _run(t, "dearest_orders")


@query(QUERIES["rank_dense"].sql)
def plan_rank(t):
    return _run(t, "rank_dense")


@query(QUERIES["first_last"].sql)
def plan_first_last(t):
    return _run(t, "first_last")


# --- tables of plan texts ---------------------------------------------------------

# A plan text per order: text templates by the key's residue, the order key as literal,
# and what is wrong with each (None for a valid plan).
_TEXTS = (
    ('{"source_table":"orders","operations":[{"type":"filter","conditions":[{"column":"o totalprice","op":">","value":',
     '}],"combine":"and"},{"type":"sort","columns":[{"name":"o orderkey","descending":true}]},'
     '{"type":"select","columns":["o orderkey","no such","o_custkey"]}]}', None),
    ('{"source_table":"orders","operations":[{"type":"head","n":', "}]}", None),
    ('{"source_table":"orders","operations":[{"type":"filter","conditions":[{"column":"o_custkey","op":"=>","value":',
     "}]}]}", "operation 1"),
    ('{"source_table":"orders","operations":[{"type":"head","n":3},{"type":"pivot","n":', "}]}", "operation 2"),
    ('{"source_table":', ',"operations":[]}', "source_table"),
    ('{"source_table":"orders","operations":', "}", "operations"),
    ('{"source_table":"orders","operations":[{"type":"head","n":', "}", "malformed"),
    ('{"source_table":"orders","operations":[{"type":"group_by","columns":["o orderstatus"],"aggregations":'
     '[{"agg":"len","column":"*","alias":"n', '"}]}]}', None),
    ('{"source_table":"orders","operations":[{"type":"join","table":"customer","how":"left","on":"o_custkey==c_custkey'
     , '"},{"type":"with_columns","expressions":[{"column":"o totalprice","expr":"rank","alias":"r"}]}]}', None),
    ('{"source_table":"orders","operations":[{"type":"with_columns","expressions":[{"column":"o_totalprice","expr":'
     '"rank","method":"first","alias":"r', '"}]}]}', "operation 1"),
)


def _plan_texts(t):
    text = F.lit(None).cast("string")
    for i, (before, after, _) in enumerate(_TEXTS):
        made = F.concat(F.lit(before), F.col("o_orderkey").cast("string"), F.lit(after))
        text = F.when(F.col("o_orderkey") % len(_TEXTS) == i, made).otherwise(text)
    return t.orders.select("o_orderkey", text.alias("plan"))


def _case_sql(values):
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return "CASE o_orderkey % {} {} END".format(
        len(values), " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(quoted))
    )


@query(
    f"SELECT o_orderkey, problem IS NULL AS plan_valid, problem FROM"
    f" (SELECT o_orderkey, {_case_sql([p for _, _, p in _TEXTS])} AS problem FROM orders)"
)
def plan_validation(t):
    checked = _plan_texts(t).withColumn("problem", batch.plan_problem(F.col("plan")))
    return checked.select("o_orderkey", F.col("problem").isNull().alias("plan_valid"), "problem")


# Names in each plan after repair, for the valid ones.
_REPAIRED = (
    "o_totalprice,o_orderkey,o_orderkey,no such,o_custkey", "", None, None, None, None, None,
    "o_orderstatus,*", "o_totalprice", None,
)


@query(f"SELECT * FROM (SELECT o_orderkey, {_case_sql(_REPAIRED)} AS names FROM orders) WHERE names IS NOT NULL")
def plan_name_repair(t):
    valid = F.array(*[F.lit(c) for c in t.orders.columns])
    plans = _plan_texts(t).where(batch.plan_valid(F.col("plan"))).withColumn("parsed", batch.parse_plan(F.col("plan")))
    repaired = plans.withColumn("parsed", batch.repair_plan(F.col("parsed"), valid))
    return repaired.select("o_orderkey", F.array_join(batch.referenced_columns(F.col("parsed")), ",").alias("names"))


_ANSWER = (
    "CASE event_id % 4 WHEN 0 THEN 'Plan: {\"a\": ' || props || ', \"b\": {\"c\": {}}} done }'"
    " WHEN 1 THEN 'see ' || props || ' or {\"x\": 1}' WHEN 2 THEN 'no plan for ' || event_type"
    " ELSE 'cut {\"a\": ' || props END"
)


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"a\": ' || props || ', \"b\": {\"c\": {}}}' WHEN 1 THEN props"
    " WHEN 2 THEN 'no plan for ' || event_type ELSE '{\"a\": ' || props END AS block FROM events"
)
def extract_json_block(t):
    return t.events.select("event_id", batch.extract_block(F.expr(_ANSWER)).alias("block"))


@query(
    "SELECT user_id, count(*) AS n_events FROM events WHERE value >= 50 GROUP BY user_id"
    " ORDER BY n_events ASC, user_id DESC LIMIT 12"
)
def plan_lax_values(t):
    """Flags and counts written as text and as decimals mean what validation says they do."""
    plan = {
        "source_table": "events",
        "operations": [
            _op("filter", conditions=[{"column": "value", "op": ">=", "value": 50}]),
            _op("group_by", columns=["user_id"], aggregations=[_agg("len", "*", "n_events")]),
            _op(
                "sort",
                columns=[{"name": "n_events", "descending": "false"}, {"name": "user_id", "descending": "Yes"}],
            ),
            _op("head", n="12.0"),
        ],
    }
    return run_plan(json.dumps(plan), {"events": t.events})


@query(
    "SELECT event_id, event_type, place FROM (SELECT event_id, event_type,"
    " dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS place FROM events)"
    " ORDER BY event_id DESC LIMIT 25"
)
def plan_sort_rank_head(t):
    """The rows' order goes through a rank to the head."""
    plan = {
        "source_table": "events",
        "operations": [
            _op("sort", columns=_by("event_id", event_id=True)),
            _op(
                "with_columns",
                expressions=[
                    {"column": "user_id", "expr": "rank", "method": "dense", "descending": "no", "over": "event_type",
                     "alias": "place"}
                ],
            ),
            _op("head", n=25),
            _op("select", columns=["event_id", "event_type", "place"]),
        ],
    }
    return run_plan(json.dumps(plan), {"events": t.events})


@query(
    "SELECT d.doc_id, n_chars, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
    " ORDER BY n_chars DESC, d.doc_id LIMIT 15"
)
def plan_sort_join_head(t):
    """The rows' order goes through a left join to the head."""
    plan = {
        "source_table": "documents",
        "operations": [
            _op("select", columns=["doc_id", "n_chars"]),
            _op("sort", columns=_by("n_chars", "doc_id", n_chars=1)),
            _op("join", table="labels", on="doc_id", how="left"),
            _op("head", n=15),
            _op("select", columns=["doc_id", "n_chars", "quality"]),
        ],
    }
    return run_plan(json.dumps(plan), {"documents": t.documents, "labels": t.labels})


@query(
    "SELECT event_type, arg_min(event_id, (-user_id, event_id)) AS first_event,"
    " arg_max(event_id, (-user_id, event_id)) AS last_event, count(*) AS n FROM events GROUP BY event_type"
)
def plan_first_mixed_order(t):
    """First and last of rows sorted down by one column and up by another."""
    plan = {
        "source_table": "events",
        "operations": [
            _op("sort", columns=_by("user_id", "event_id", user_id="true")),
            _op("group_by", columns=["event_type"], aggregations=[
                _agg("first", "event_id", "first_event"), _agg("len", "*", "n"), _agg("last", "event_id", "last_event")]),
        ],
    }
    return run_plan(json.dumps(plan), {"events": t.events})
