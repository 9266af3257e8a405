"""Queries for projection, filters, joins, aggregates, windows, ordering and functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from frameops.catalog.registry import query
from frameops.functions import aggregates as agg
from frameops.functions import scalar as fn
from frameops.operators import frame as op
from frameops.operators.joins import join
from frameops.operators.ranking import aggregate_over, number_rows, rank, top_per_group
from frameops.session import stage


def _days(first: str, last: str) -> tuple[dt.date, dt.date]:
    return dt.date.fromisoformat(first), dt.date.fromisoformat(last)


# --- projection and filters -------------------------------------------------


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'de'", "documents")
def german_documents(t):
    return t.documents.filter(F.col("lang") == "de").select("doc_id", "source", "n_chars")


@query(
    "SELECT o_orderkey, o_totalprice FROM orders"
    " WHERE o_totalprice >= 450000 OR o_orderstatus = 'P' OR o_orderkey < 10"
)
def filter_any(t):
    rows = op.filter_all(
        t.orders, [("o_totalprice", ">=", 450000), ("o_orderstatus", "==", "P"), ("o_orderkey", "<", 10)], "or"
    )
    return rows.select("o_orderkey", "o_totalprice")


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"
    " WHERE l_quantity > 10 AND l_quantity <= 20 AND l_returnflag <> 'R'"
)
def filter_every(t):
    rows = op.filter_all(
        t.lineitem, [("l_quantity", ">", 10), ("l_quantity", "<=", 20), ("l_returnflag", "!=", "R")]
    )
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def chained_filter(t):
    return (
        t.orders.filter(F.col("o_totalprice") > 1000).filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    )


@query(
    "SELECT role, max(turn) AS last_turn, count(*) AS n_rows FROM conversations WHERE role = 'system' OR turn > 3"
    " GROUP BY role",
    "conversations",
)
def late_or_system_turns(t):
    kept = t.conversations.filter((F.col("role") == "system") | (F.col("turn") > 3))
    return op.group_agg(kept, "role", last_turn=agg.agg_max("turn"), n_rows=agg.agg_len())


@query("SELECT event_id, event_type, value FROM events WHERE NOT (event_type = 'view' OR value < 120)")
def no_views_nor_small_values(t):
    return t.events.filter(~((F.col("event_type") == "view") | (F.col("value") < 120))).select(
        "event_id", "event_type", "value"
    )


@query(
    "SELECT count(DISTINCT user_id) AS n_users, max(value) AS largest FROM events WHERE event_type = 'purchase'"
    " AND value >= 20 AND ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'",
    "events",
)
def buyers_in_mid_january(t):
    kept = t.events.filter(
        (F.col("event_type") == "purchase")
        & (F.col("value") >= 20)
        & fn.is_between("ts", *_days("2024-01-08", "2024-01-19"))
    )
    return op.aggregate(kept, n_users=agg.agg_n_unique("user_id"), largest=agg.agg_max("value"))


@query(
    "SELECT min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n_lines FROM lineitem"
    " WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-05-10' AND DATE '1995-06-20'",
    "lineitem",
)
def quantities_shipped_in_six_weeks(t):
    kept = t.lineitem.filter(fn.is_between("l_shipdate", *_days("1995-05-10", "1995-06-20")))
    return op.aggregate(
        kept, least=agg.agg_min("l_quantity"), most=agg.agg_max("l_quantity"), n_lines=agg.agg_len()
    )


@query("SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-10'")
def between_days_of_timestamps(t):
    return t.events.filter(fn.is_between("ts", *_days("2024-01-01", "2024-01-10"))).select("event_id", "ts")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.06")
def between_numbers(t):
    return t.lineitem.filter(fn.is_between("l_discount", 0.03, 0.06)).select(
        "l_orderkey", "l_linenumber", "l_discount"
    )


@query("SELECT page_id, lower(url) AS address, length(html) - length(url) AS surplus, url FROM pages", "pages")
def page_addresses(t):
    wider = op.with_columns(
        t.pages,
        {
            "address": fn.str_to_lowercase("url"),
            "surplus": (fn.str_len_chars("html") - fn.str_len_chars("url")).cast("long"),
        },
    )
    return wider.select("page_id", "address", "surplus", "url")


@query("SELECT conv_id AS thread, turn AS step, role AS speaker, text FROM conversations", "conversations")
def threads(t):
    return op.rename(t.conversations, {"conv_id": "thread", "turn": "step", "role": "speaker"})


@query(
    "SELECT l_orderkey, l_linenumber, -l_quantity AS negated, (l_quantity + 1) * 2 - l_tax AS mixed,"
    " l_quantity / 4 AS quarter FROM lineitem"
)
def arithmetic(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (-F.col("l_quantity")).alias("negated"),
        ((F.col("l_quantity") + 1) * 2 - F.col("l_tax")).alias("mixed"),
        fn.true_divide("l_quantity", 4).alias("quarter"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'nan' WHEN l_discount = 0 THEN 'inf'"
    " ELSE CAST(CAST(round(l_tax / l_discount, 4) AS DECIMAL(18, 4)) AS VARCHAR) END AS ratio FROM lineitem"
)
def divide_by_zero(t):
    ratio = fn.true_divide("l_tax", "l_discount")
    shown = (
        F.when(F.isnan(ratio), "nan")
        .when(ratio == float("inf"), "inf")
        .otherwise(F.round(ratio, 4).cast("decimal(18,4)").cast("string"))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", shown.alias("ratio"))


@query(
    "SELECT l.doc_id, CAST(l.doc_id AS VARCHAR) AS doc_text, CAST(quality AS DOUBLE) AS quality,"
    " toxic <> 0 AS is_toxic FROM labels l"
)
def labels_in_other_types(t):
    wider = op.with_columns(
        t.labels,
        {
            "doc_text": fn.cast("doc_id", "Utf8"),
            "quality": fn.cast("quality", "Float64"),
            "is_toxic": fn.cast("toxic", "Boolean"),
        },
    )
    return wider.select("doc_id", "doc_text", "quality", "is_toxic")


@query(
    "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS as_int32, CAST(trunc(o_totalprice) AS BIGINT) AS as_int64,"
    " CAST(o_custkey AS DOUBLE) AS as_float64, CAST(o_custkey % 1000 AS FLOAT) AS as_float32,"
    " CAST(o_orderkey AS VARCHAR) AS as_text, CAST(o_orderdate AS DATE) AS as_date, o_orderdate AS as_datetime,"
    " o_custkey % 2 <> 0 AS as_bool FROM orders"
)
def cast_targets(t):
    return t.orders.select(
        "o_orderkey",
        fn.cast("o_custkey", "Int32").alias("as_int32"),
        fn.cast("o_totalprice", "Int64").alias("as_int64"),
        fn.cast("o_custkey", "Float64").alias("as_float64"),
        fn.cast(F.col("o_custkey") % 1000, "Float32").alias("as_float32"),
        fn.cast("o_orderkey", "Utf8").alias("as_text"),
        fn.cast("o_orderdate", "Date").alias("as_date"),
        fn.cast(fn.cast("o_orderdate", "Date"), "Datetime").alias("as_datetime"),
        fn.cast(F.col("o_custkey") % 2, "Boolean").alias("as_bool"),
    )


# --- joins --------------------------------------------------------------------


@query(
    "SELECT d.doc_id, lang AS language, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1",
    "documents labels",
)
def languages_of_toxic_documents(t):
    joined = join(t.documents, t.labels.filter(F.col("toxic") == 1), left_on="doc_id", right_on="doc_id")
    return joined.select("doc_id", F.col("lang").alias("language"), "quality")


@query(
    "SELECT r_name, p_brand, sum(l_quantity) AS quantity, count(*) AS n_lines FROM part"
    " JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey"
    " JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    " WHERE p_size <= 12 AND l_returnflag = 'N' GROUP BY r_name, p_brand",
    "part lineitem supplier nation region",
)
def small_parts_by_supplier_region(t):
    joined = (
        t.part.filter(F.col("p_size") <= 12)
        .transform(join, t.lineitem.filter(F.col("l_returnflag") == "N"), left_on="p_partkey", right_on="l_partkey")
        .transform(join, t.supplier, left_on="l_suppkey", right_on="s_suppkey")
        .transform(join, t.nation, left_on="s_nationkey", right_on="n_nationkey")
        .transform(join, t.region, left_on="n_regionkey", right_on="r_regionkey")
    )
    return op.group_agg(joined, ["r_name", "p_brand"], quantity=agg.agg_sum("l_quantity"), n_lines=agg.agg_len())


@query(
    "SELECT p_partkey, p_brand, CAST(max(date_diff('day', o_orderdate, l_shipdate)) AS INTEGER) AS longest_wait,"
    " count(*) AS n_lines FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey"
    " WHERE p_size BETWEEN 5 AND 15 AND l_linestatus = 'O' GROUP BY p_partkey, p_brand"
    " ORDER BY longest_wait DESC, n_lines DESC, p_partkey LIMIT 10"
)
def longest_waits_for_parts(t):
    waited = (
        t.part.filter(fn.is_between("p_size", 5, 15))
        .transform(join, t.lineitem.filter(F.col("l_linestatus") == "O"), left_on="p_partkey", right_on="l_partkey")
        .transform(join, t.orders, left_on="l_orderkey", right_on="o_orderkey")
        .transform(op.with_columns, {"wait": F.datediff("l_shipdate", "o_orderdate")})
        .transform(
            op.group_agg, ["p_partkey", "p_brand"], longest_wait=agg.agg_max("wait"), n_lines=agg.agg_len()
        )
    )
    return op.top_k(waited, ["longest_wait", "n_lines", "p_partkey"], 10, [True, True, False])


@query(
    "SELECT s_suppkey, s_acctbal FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey"
    " WHERE l_suppkey = s_suppkey AND p_size = 1 AND l_discount >= 0.08)",
    "supplier lineitem part",
)
def suppliers_of_cheap_small_parts(t):
    sold = join(
        t.lineitem.filter(F.col("l_discount") >= 0.08), t.part.filter(F.col("p_size") == 1),
        left_on="l_partkey", right_on="p_partkey",
    )
    found = join(t.supplier, sold, left_on="s_suppkey", right_on="l_suppkey", how="semi")
    return found.select("s_suppkey", "s_acctbal")


@query(
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS"
    " (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)"
)
def anti_customers(t):
    large = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
    return join(t.customer, large, left_on="c_custkey", right_on="o_custkey", how="anti").select(
        "c_custkey", "c_name"
    )


@query(
    "SELECT q.conv_id, q.turn, a.role AS reply_role, length(a.text) AS reply_length FROM conversations q"
    " LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user'"
)
def replies_to_users(t):
    asked = t.conversations.filter(F.col("role") == "user").select("conv_id", "turn", (F.col("turn") + 1).alias("next"))
    joined = join(asked, t.conversations, left_on=["conv_id", "next"], right_on=["conv_id", "turn"], how="left")
    return joined.select(
        "conv_id", "turn", F.col("role").alias("reply_role"),
        fn.str_len_chars("text").cast("long").alias("reply_length"),
    )


@query(
    "SELECT d.doc_id, n_chars, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def left_join_labels(t):
    return join(t.documents, t.labels, on="doc_id", how="left").select("doc_id", "n_chars", "quality")


_SMALL = "SELECT doc_id, toxic, quality FROM labels WHERE quality = 0"
_LONG = "SELECT doc_id, n_chars, 1 - n_chars % 2 AS quality FROM documents WHERE n_chars > 500"


@query(
    f"SELECT l.doc_id, l.toxic, l.quality, r.doc_id AS doc_id_right, r.n_chars, r.quality AS quality_right"
    f" FROM ({_SMALL}) l FULL JOIN ({_LONG}) r ON l.doc_id = r.doc_id"
)
def full_join(t):
    small = t.labels.filter(F.col("quality") == 0).select("doc_id", "toxic", "quality")
    long = t.documents.filter(F.col("n_chars") > 500).select(
        "doc_id", "n_chars", (1 - F.col("n_chars") % 2).alias("quality")
    )
    return join(small, long, on="doc_id", how="full")


@query(
    f"SELECT l.toxic, l.quality, r.doc_id, r.n_chars, r.quality AS quality_right"
    f" FROM ({_SMALL}) l RIGHT JOIN ({_LONG}) r ON l.doc_id = r.doc_id"
)
def right_join(t):
    small = t.labels.filter(F.col("quality") == 0).select("doc_id", "toxic", "quality")
    long = t.documents.filter(F.col("n_chars") > 500).select(
        "doc_id", "n_chars", (1 - F.col("n_chars") % 2).alias("quality")
    )
    return join(small, long, on="doc_id", how="right")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_join(t):
    # Two dimension tables of fixed size.
    return join(t.nation.select("n_name"), t.region.select("r_name"), how="cross")


@query(
    "SELECT a.l_orderkey, a.l_linenumber, a.quantity, b.quantity AS quantity_other FROM"
    " (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'A'"
    "  GROUP BY ALL) a JOIN"
    " (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R'"
    "  GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"
)
def self_join_many_keys(t):
    quantity = {"quantity": agg.agg_sum("l_quantity")}
    keys = ["l_orderkey", "l_linenumber"]
    accepted = op.group_agg(t.lineitem.filter(F.col("l_returnflag") == "A"), keys, **quantity)
    returned = op.group_agg(t.lineitem.filter(F.col("l_returnflag") == "R"), keys, **quantity)
    return join(accepted, returned, on=keys, suffix="_other")


@query(
    "SELECT s_name, p_name, l_orderkey, l_linenumber, round(l_extendedprice / l_quantity - p_retailprice, 4) AS markup"
    " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
    " WHERE l_quantity >= 2 ORDER BY markup DESC, l_orderkey, l_linenumber, s_name, p_name LIMIT 12"
)
def largest_markups(t):
    markup = fn.true_divide("l_extendedprice", "l_quantity") - F.col("p_retailprice")
    joined = (
        t.lineitem.filter(F.col("l_quantity") >= 2)
        .transform(join, t.part, left_on="l_partkey", right_on="p_partkey")
        .transform(join, t.supplier, left_on="l_suppkey", right_on="s_suppkey")
        .select("s_name", "p_name", "l_orderkey", "l_linenumber", F.round(markup, 4).alias("markup"))
    )
    names = ["markup", "l_orderkey", "l_linenumber", "s_name", "p_name"]
    return op.top_k(joined, names, 12, [True, False, False, False, False])


# --- aggregates ---------------------------------------------------------------


@query("SELECT role, count(*) AS n_turns FROM conversations GROUP BY role", "conversations")
def turns_by_role(t):
    return op.group_agg(t.conversations, "role", n_turns=agg.agg_len())


@query(
    "SELECT lang, source, count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source",
    "documents",
)
def documents_by_lang_and_source(t):
    return op.group_agg(t.documents, ["lang", "source"], n_documents=agg.agg_len(), chars=agg.agg_sum("n_chars"))


@query(
    "SELECT event_type, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, min(value) AS least,"
    " max(ts) AS latest, count(value) AS n_values FROM events GROUP BY event_type",
    "events",
)
def values_by_event_type(t):
    return op.group_agg(
        t.events,
        "event_type",
        total=F.round(agg.agg_sum("value"), 2),
        mean=F.round(agg.agg_mean("value"), 4),
        least=agg.agg_min("value"),
        latest=agg.agg_max("ts"),
        n_values=agg.agg_count("value"),
    )


@query(
    "SELECT CAST(day(ts) AS INTEGER) AS day, event_type, count(*) AS n_events FROM events GROUP BY ALL",
    "events",
)
def events_per_day(t):
    dated = op.with_columns(t.events, {"day": fn.dt_day("ts")})
    return op.group_agg(dated, ["day", "event_type"], n_events=agg.agg_len())


@query(
    "SELECT CAST(month(l_shipdate) AS INTEGER) AS ship_month, CAST(day(l_shipdate) AS INTEGER) AS ship_day,"
    " count(*) AS n FROM lineitem GROUP BY ALL"
)
def group_by_expression(t):
    keys = [fn.dt_month("l_shipdate").alias("ship_month"), fn.dt_day("l_shipdate").alias("ship_day")]
    return op.group_agg(t.lineitem, keys, n=agg.agg_len())


@query(
    "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events WHERE value > 10",
    "events",
)
def users_and_kinds(t):
    kept = t.events.filter(F.col("value") > 10)
    return op.aggregate(kept, users=agg.agg_n_unique("user_id"), kinds=agg.agg_n_unique("event_type"))


@query(
    "SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT user_id) AS users, true AS within"
    " FROM events GROUP BY event_type",
    "events",
)
def distinct_users_rolled_up(t):
    """Users per kind of event from sketches kept per kind and day, against the exact count."""
    daily = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(
        agg.agg_distinct_sketch("user_id").alias("users")
    )
    daily = stage(daily, "daily-users")
    rolled = daily.groupBy("event_type").agg(F.count("*").alias("days"), agg.agg_merged_sketch("users").alias("sketch"))
    exact = t.events.groupBy("event_type").agg(agg.agg_n_unique("user_id").alias("users"))
    off = F.abs(agg.distinct_estimate("sketch") - F.col("users"))
    return exact.join(rolled, "event_type").select(
        "event_type", "days", "users", (off <= agg.SKETCH_ERROR * F.col("users")).alias("within")
    )


@query(
    "SELECT source, count(DISTINCT quality) + CAST(coalesce(bool_or(quality IS NULL), false) AS INTEGER) AS n_unique,"
    " count(quality) AS n_labelled, count(*) AS n_rows, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS n_toxic"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"
)
def aggregates_with_nulls(t):
    labelled = join(t.documents, t.labels, on="doc_id", how="left")
    return op.group_agg(
        labelled,
        "source",
        n_unique=agg.agg_n_unique("quality"),
        n_labelled=agg.agg_count("quality"),
        n_rows=agg.agg_len(),
        n_toxic=agg.agg_sum("toxic"),
    )


@query(
    "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey)"
    " AS last_price FROM orders GROUP BY o_custkey"
)
def first_last(t):
    return op.group_agg(
        t.orders,
        "o_custkey",
        first_price=agg.agg_first("o_totalprice", "o_orderkey"),
        last_price=agg.agg_last("o_totalprice", "o_orderkey"),
    )


@query(
    "SELECT count(*) AS n, sum(value) FILTER (WHERE value < 0) IS NULL AS no_negative, 0 AS sum_of_none,"
    " max(value) AS top FROM events"
)
def aggregate_all(t):
    negative = F.when(F.col("value") < 0, F.col("value"))
    return op.aggregate(
        t.events,
        n=agg.agg_len(),
        no_negative=agg.agg_count(negative) == 0,
        sum_of_none=agg.agg_sum(negative).cast("int"),
        top=agg.agg_max("value"),
    )


@query(
    "SELECT event_type, count(*) AS n FROM events WHERE year(ts) = 2024 GROUP BY event_type",
)
def events_by_type(t):
    kept = t.events.filter(fn.dt_year("ts") == 2024)
    counted = op.group_agg(kept, "event_type", n=agg.agg_len())
    return op.sort(counted, "n", descending=True)


@query(
    "SELECT s_suppkey, s_acctbal, max(s_acctbal) OVER () AS best,"
    " round(s_acctbal / max(s_acctbal) OVER (), 6) AS share, count(*) OVER () AS n FROM supplier"
)
def aggregates_on_every_row(t):
    wider = op.with_aggregates(t.supplier, best=agg.agg_max("s_acctbal"), n=agg.agg_len())
    return wider.select(
        "s_suppkey", "s_acctbal", "best", F.round(fn.true_divide("s_acctbal", "best"), 6).alias("share"), "n"
    )


# --- windows ------------------------------------------------------------------


@query(
    "SELECT * FROM (SELECT doc_id, lang, n_chars, dense_rank() OVER (PARTITION BY lang ORDER BY n_chars) AS size_place"
    " FROM documents) WHERE size_place <= 4",
    "documents",
)
def shortest_documents_per_lang(t):
    slim = t.documents.select("doc_id", "lang", "n_chars")
    return top_per_group(slim, "n_chars", 4, over="lang", descending=False, name="size_place")


@query(
    "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, rank() OVER"
    " (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS place FROM lineitem) WHERE place <= 5"
)
def min_rank_top5(t):
    slim = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return top_per_group(slim, "l_quantity", 5, over="l_returnflag", method="min", name="place")


@query(
    "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, dense_rank() OVER"
    " (ORDER BY l_extendedprice DESC) AS place FROM lineitem) WHERE place <= 10"
)
def dense_rank_top10_overall(t):
    slim = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return top_per_group(slim, "l_extendedprice", 10, name="place")


_RANKED = "SELECT o_orderkey, o_orderstatus, o_totalprice, {rank} AS place FROM orders"


def _ranked(t, method, descending=True):
    slim = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rank(slim, "o_totalprice", method, descending, over="o_orderstatus", name="place")


_BY_STATUS = "OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC)"
_TIES = "count(*) OVER (PARTITION BY o_orderstatus, o_totalprice)"


@query(_RANKED.format(rank=f"dense_rank() {_BY_STATUS}"))
def rank_dense(t):
    return _ranked(t, "dense")


@query(_RANKED.format(rank="rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice)"))
def rank_min_ascending(t):
    return _ranked(t, "min", descending=False)


@query(_RANKED.format(rank=f"rank() {_BY_STATUS} + {_TIES} - 1"))
def rank_max(t):
    return _ranked(t, "max")


@query(_RANKED.format(rank=f"rank() {_BY_STATUS} + ({_TIES} - 1) / 2"))
def rank_average(t):
    return _ranked(t, "average")


@query(_RANKED.format(rank="row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)"))
def rank_ordinal(t):
    slim = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rank(slim, "o_totalprice", "ordinal", True, over="o_orderstatus", name="place", tie_break="o_orderkey")


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, dense_rank() OVER (ORDER BY l_quantity DESC) AS place,"
    " FROM lineitem"
)
def rank_whole_table_dense(t):
    slim = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return rank(slim, "l_quantity", "dense", True, name="place")


@query(
    "SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice)"
    " + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS place FROM lineitem"
)
def rank_whole_table_average(t):
    slim = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rank(slim, "l_extendedprice", name="place")


@query(
    "SELECT l_returnflag, l_linestatus, l_extendedprice, rank() OVER (PARTITION BY l_returnflag, l_linestatus"
    " ORDER BY l_extendedprice DESC) AS place FROM lineitem"
)
def rank_in_sliced_groups(t):
    slim = t.lineitem.select("l_returnflag", "l_linestatus", "l_extendedprice")
    return rank(
        slim, "l_extendedprice", "min", True, over=["l_returnflag", "l_linestatus"], name="place", max_rows_per_task=0
    )


@query(
    "SELECT l_returnflag, l_shipdate, l_quantity, row_number() OVER (PARTITION BY l_returnflag"
    " ORDER BY l_shipdate, l_quantity) AS number FROM lineitem"
)
def number_rows_in_sliced_groups(t):
    slim = t.lineitem.select("l_returnflag", "l_shipdate", "l_quantity")
    return number_rows(slim, "l_shipdate", over="l_returnflag", name="number", max_rows_per_task=0)


@query(
    "SELECT d.doc_id, source, quality, CASE WHEN quality IS NOT NULL THEN dense_rank() OVER"
    " (PARTITION BY source ORDER BY quality DESC NULLS LAST) END AS place"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def rank_with_nulls(t):
    labelled = join(t.documents, t.labels, on="doc_id", how="left").select("doc_id", "source", "quality")
    return rank(labelled, "quality", "dense", True, over="source", name="place")


@query(
    "SELECT o_orderkey, o_custkey, o_totalprice, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2)"
    " AS customer_total, count(*) OVER (PARTITION BY o_custkey) AS customer_orders FROM orders"
)
def aggregate_over_group(t):
    slim = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return aggregate_over(
        slim,
        "o_custkey",
        customer_total=F.round(agg.agg_sum("o_totalprice"), 2),
        customer_orders=agg.agg_len(),
    )


# --- ordering and distinct ------------------------------------------------------


@query(
    "SELECT event_id, user_id, value FROM events WHERE event_type <> 'error' ORDER BY value DESC, event_id DESC LIMIT 15",
    "events",
)
def largest_events(t):
    kept = t.events.filter(F.col("event_type") != "error")
    return op.top_k(kept, ["value", "event_id"], 15).select("event_id", "user_id", "value")


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders")
def sort_all(t):
    slim = t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice")
    return op.sort(slim, ["o_orderstatus", "o_totalprice"], [False, True])


@query("SELECT DISTINCT turn, role FROM conversations", "conversations")
def roles_at_turns(t):
    return op.unique(t.conversations.select("turn", "role"))


@query(
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER"
    " (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"
)
def unique_on_subset(t):
    slim = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return op.unique(slim, "o_custkey", keep_first_by="o_orderkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def unique_any_row(t):
    return op.unique(t.lineitem, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey")


# --- functions --------------------------------------------------------------------


@query("SELECT page_id, url FROM pages WHERE contains(url, '.org/')", "pages")
def pages_of_org_hosts(t):
    return t.pages.filter(fn.str_contains("url", "\\.org/")).select("page_id", "url")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(red|blue) [a-w]+')")
def name_matches(t):
    return t.part.filter(fn.str_contains("p_name", "(red|blue) [a-w]+")).select("p_partkey", "p_name")


@query(
    "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') ORDER BY p_partkey LIMIT 10",
    "part",
)
def starts_with(t):
    kept = t.part.filter(fn.str_starts_with("p_name", "red")).select("p_partkey", "p_name")
    return op.top_k(kept, "p_partkey", 10, descending=False)


@query("SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 'ring')")
def ends_with(t):
    return t.part.filter(fn.str_ends_with("p_name", "ring")).select("p_partkey", "p_name")


@query("SELECT p_partkey, lower(p_brand) AS lowered, upper(p_name) AS raised FROM part")
def letter_case(t):
    return t.part.select(
        "p_partkey", fn.str_to_lowercase("p_brand").alias("lowered"), fn.str_to_uppercase("p_name").alias("raised")
    )


@query("SELECT doc_id, length(text) AS n FROM documents")
def len_chars(t):
    return t.documents.select("doc_id", fn.str_len_chars("text").cast("long").alias("n"))


@query(
    "SELECT CAST(month(l_shipdate) AS INTEGER) AS month, l_linestatus, count(*) AS n_lines FROM lineitem"
    " WHERE month(l_shipdate) IN (11, 12) AND day(l_shipdate) <= 7 GROUP BY ALL"
)
def first_weeks_of_winter(t):
    dated = op.with_columns(t.lineitem, {"month": fn.dt_month("l_shipdate"), "day": fn.dt_day("l_shipdate")})
    kept = dated.filter(F.col("month").isin(11, 12) & (F.col("day") <= 7))
    return op.group_agg(kept, ["month", "l_linestatus"], n_lines=agg.agg_len())


@query(
    "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d,"
    " ts >= DATE '2024-02-01' AS late FROM events"
)
def date_parts(t):
    return t.events.select(
        "event_id",
        fn.dt_year("ts").alias("y"),
        fn.dt_month("ts").alias("m"),
        fn.dt_day("ts").alias("d"),
        (F.col("ts") >= fn.date(2024, 2, 1)).alias("late"),
    )


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS price FROM lineitem")
def round_floats(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", fn.round_digits("l_extendedprice", 1).alias("price"))


@query(
    "SELECT source, arg_min(d.doc_id, (coalesce(quality, -1), d.doc_id)) AS first_doc,"
    " arg_max(d.doc_id, (coalesce(quality, -1), d.doc_id)) AS last_doc"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"
)
def first_last_null_order(t):
    """Rows whose order value is null come first; they are not skipped."""
    marked = join(t.documents.select("doc_id", "source"), t.labels.select("doc_id", "quality"), on="doc_id", how="left")
    return op.group_agg(
        marked,
        "source",
        first_doc=agg.agg_first("doc_id", ["quality", "doc_id"]),
        last_doc=agg.agg_last("doc_id", ["quality", "doc_id"]),
    )
