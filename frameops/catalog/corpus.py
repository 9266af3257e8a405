"""Queries for jobs over code, error texts, schemas, prompts and question corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameops.catalog import relational  # noqa: F401  (registers the queries recorded here)
from frameops.catalog.registry import QUERIES, query
from frameops.corpus import build, errors, prompts, references, screen
from frameops.session import scratch_path
from frameops.sources.tables import load_tables

# --- code ---------------------------------------------------------------------

# Code per part, by the key's residue: SQL text, the anti-pattern it holds (position
# from 1), the unknown column it names, and whether Python can parse it.
_CODES = (
    ("'result = part.filter(pl.col(\"p_size\") > ' || p_size || ')'", 0, None, True),
    ("'result = part.with_column(pl.col(\"p_size\").alias(\"x' || p_size || '\"))'", 1, None, True),
    ("'result = part.sort(pl.desc(\"' || p_name || '\"))'", 2, None, True),
    ("'result = part.select(pl.col(\"p_size\").dense())'", 3, None, True),
    ("'n = part.len' || chr(10) || 'result = part.head(n)'", 4, None, True),
    ("'result = part.groupby(\"p_brand\").agg(pl.len())'", 5, None, True),
    ("'result = part.filter(pl.col(\"p_name\").contains(\"' || p_name || '\"))'", 6, None, True),
    ("'result = part[part[\"p_size\"] > ' || p_size || ']'", 7, None, True),
    ("'result = part.filter(pl.col(\"p_name\").str.contains(\"a\")).select(pl.col(\"p_name\").str.len_chars())'",
     0, None, True),
    ("'result = part.select((pl.col(\"p_size\") + 1).alias(\"plus\"), pl.col(\"size_' || p_size || '\"))'",
     0, "'size_' || p_size", True),
    ("'result = part.filter(pl.col(\"p_size\") > ' || p_size", 0, None, False),
    ("'table = part.head(' || p_size || ')'", 0, None, True),
    ("'  ' || chr(10)", 0, None, True),
    ("'result = part.select((pl.col(\"p_size\") + 1).alias(\"plus\")).filter(pl.col(\"plus\") > 2)'", 0, None, True),
)


def _pick(values, key="p_partkey"):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_CODE = _pick([c for c, *_ in _CODES])
_LABELS = [label.replace("'", "''") for label, _ in screen.ANTI_PATTERNS]
_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _codes(t):
    columns = F.array(*[F.lit(c) for c in _PART_COLUMNS])
    return t.part.select("p_partkey", F.expr(_CODE).alias("code"), columns.alias("valid_columns"))


@query(
    "SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS code FROM documents"
)
def strip_fence(t):
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" ```python\n"), "text", F.lit("\n```\n"))).otherwise(
        F.concat(F.lit("```\n"), "text", F.lit("```"))
    )
    return t.documents.select("doc_id", screen.strip_code_fence(fenced).alias("code"))


_ASSIGNED = (
    "CASE p_partkey % 4 WHEN 0 THEN 'a = 1' || chr(10) || 'result = (part.head(' || p_size || '))' || chr(10) || 'b = (2)'"
    " WHEN 1 THEN 'result = 1' || chr(10) || 'result = part.head(' || p_size || ') # end'"
    " WHEN 2 THEN 'x = (' || p_size || ')' ELSE 'y = 0' || chr(10) || 'result =  (part.head(' || p_size || ')' END"
)


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'result = (part.head(' || p_size || '))'"
    " WHEN 1 THEN 'result = part.head(' || p_size || ') # end' WHEN 2 THEN 'x = (' || p_size || ')'"
    " ELSE 'result =  (part.head(' || p_size || ')' END AS code FROM part"
)
def final_assignment(t):
    return t.part.select("p_partkey", screen.final_assignment(F.expr(_ASSIGNED)).alias("code"))


@query(
    "SELECT p_partkey, " + _pick(["'" + ("" if n == 0 else _LABELS[n - 1]) + "'" for _, n, _, _ in _CODES])
    + " AS labels FROM part"
)
def anti_pattern_scan(t):
    return _codes(t).select("p_partkey", F.array_join(screen.anti_patterns(F.col("code")), "; ").alias("labels"))


@query(
    "SELECT p_partkey, " + _pick([u or "NULL" for _, _, u, _ in _CODES]) + " AS unknown FROM part"
)
def unknown_columns(t):
    codes = _codes(t)
    stray = screen.unknown_column(F.col("code"), F.col("valid_columns"))
    # A sort key in pl.desc is no column reference and is not checked.
    return codes.select("p_partkey", stray.alias("unknown"))


# Code whose names are texts of one word: bare names, either quotes, names inside comments, names used too early.
_REFERRING = (
    "'result = part.sort(''p_size'').select(\"p_name\", ''size_' || p_size || ''')'",
    "'result = part.group_by([''p_brand'']).agg(pl.col(''p_size'').max().alias(''top'')).sort(''top'') # pl.col(\"no_' || p_size || '\")'",
    "'# part.select(''no_such'')' || chr(10) || 'result = part.unique(subset=[\"p_type\", \"kind_' || p_size % 3 || '\"])'",
    "'result = part.filter(pl.col(\"twice\") > ' || p_size || ').with_columns((pl.col(''p_size'') * 2).alias(''twice''))'",
    "'result = part.with_columns((pl.col(''p_size'') * 2).alias(''twice'')).filter(pl.col(\"twice\") > ' || p_size || ')'",
)


@query(
    f"""WITH codes AS (SELECT p_partkey, {_pick(_REFERRING)} AS code FROM part),
bare AS (SELECT p_partkey, regexp_replace(code, '#[^\\n]*', '', 'g') AS code FROM codes),
words AS (SELECT p_partkey, unnest(regexp_extract_all(code, '(?:alias\\()?["''][a-z_0-9]+["'']')) AS word,
  generate_subscripts(regexp_extract_all(code, '(?:alias\\()?["''][a-z_0-9]+["'']'), 1) AS nth FROM bare),
named AS (SELECT p_partkey, nth, starts_with(word, 'alias(') AS given, regexp_extract(word, '["'']([a-z_0-9]+)', 1) AS name FROM words),
strays AS (SELECT p_partkey, arg_min(name, nth) AS name FROM named n WHERE NOT given
  AND name NOT IN ({', '.join(f"'{c}'" for c in _PART_COLUMNS)})
  AND NOT EXISTS (SELECT 1 FROM named g WHERE g.p_partkey = n.p_partkey AND g.given AND g.name = n.name AND g.nth < n.nth)
  GROUP BY p_partkey)
SELECT p_partkey, len(regexp_extract_all(code, '["''][a-z_0-9]+["'']')) AS n_names, name AS unknown
FROM bare LEFT JOIN strays USING (p_partkey)"""
)
def unknown_references(t):
    """Names in code of any form of call, checked in the order in which the code runs."""
    codes = t.part.select("p_partkey", references.code_facts(F.expr(_pick(_REFERRING))).alias("facts"))
    known = F.array(*[F.lit(c) for c in _PART_COLUMNS])
    return codes.select(
        "p_partkey", F.size("facts.names").cast("long").alias("n_names"),
        references.unknown_reference(F.col("facts"), known).alias("unknown"),
    )


def _reason_sql(case):
    text, pattern, unknown, parses = case
    if text.startswith("'  '"):
        return "'empty'"
    if not parses:
        return "'syntax_error'"
    if "result" not in text:
        return "'missing_result_assignment'"
    if pattern:
        return f"'hallucinated_api: {_LABELS[pattern - 1]}'"
    if unknown:
        return f"'unknown_column: ''' || {unknown} || ''''"
    return "'ok'"


_REASONS = _pick([_reason_sql(c) for c in _CODES])


@query(f"SELECT p_partkey, reason, reason = 'ok' AS ok FROM (SELECT p_partkey, {_REASONS} AS reason FROM part)")
def code_screen(t):
    screened = screen.screen(_codes(t))
    # The parser's wording differs between Python versions.
    reason = F.regexp_replace("reason", "^(syntax_error): .*", "$1")
    return screened.select("p_partkey", reason.alias("reason"), "ok")


def _candidates(t):
    """Three candidates per part: its own code and those of the next two residues."""
    shifted = F.explode(F.sequence(F.lit(0), F.lit(2)))
    rows = t.part.withColumn("shift", shifted).withColumn("id", F.col("p_partkey"))
    rows = rows.withColumn("p_partkey", F.col("id") + F.col("shift") * 3)
    level = F.get(F.array(*[F.lit(x) for x in screen.LEVELS]), F.col("shift"))
    tables = F.array(F.struct(F.lit("part").alias("table")))
    return rows.select(
        "id",
        level.alias("level"),
        F.expr(_CODE).alias("code"),
        F.array(*[F.lit(c) for c in _PART_COLUMNS]).alias("valid_columns"),
        screen.default_code(tables).alias("default_code"),
    )


_CANDIDATES = f"""
candidates AS (SELECT id, shift, {_CODE} AS code, {_REASONS} AS reason FROM
  (SELECT p_partkey AS id, p_partkey + shift * 3 AS p_partkey, p_size, p_name, shift
   FROM part, (VALUES (0), (1), (2)) s(shift)))"""


@query(f"""WITH {_CANDIDATES},
best AS (SELECT id, min(shift) AS shift FROM candidates WHERE reason = 'ok' GROUP BY id)
SELECT f.id, coalesce(c.code, 'result = part') AS code,
  CASE b.shift WHEN 0 THEN 'fast' WHEN 1 THEN 'constrained' WHEN 2 THEN 'retry' ELSE 'fallback_default' END AS level,
  CASE WHEN b.shift IS NOT NULL THEN 'ok' ELSE f.reason END AS reason, f.code AS l1_code, f.reason AS l1_reason
FROM candidates f LEFT JOIN best b ON f.id = b.id LEFT JOIN candidates c ON c.id = b.id AND c.shift = b.shift
WHERE f.shift = 0""")
def choose_candidate(t):
    screened = screen.screen(_candidates(t))
    wording = F.regexp_replace("reason", "^(syntax_error): .*", "$1")
    return screen.choose_candidates(screened.withColumn("reason", wording))


@query(f"""WITH {_CANDIDATES}
SELECT id, arg_min(code, CASE shift WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS code FROM candidates GROUP BY id""")
def first_candidate(t):
    return screen.first_candidate(_candidates(t))


# --- error texts ------------------------------------------------------------------

_ERROR = (
    "CASE event_id % 7 WHEN 0 THEN 'ColumnNotFoundError: unable to find column \"' || event_type"
    " || '\"; valid columns: [\"event_id\", \"' || user_id || '\"]'"
    " WHEN 1 THEN 'DuplicateError: column ' || event_type || ' exists ' || repeat(props, 30)"
    " WHEN 2 THEN 'ColumnNotFoundError: ' || event_type || repeat(props, 30)"
    " WHEN 3 THEN 'SchemaError: ' || props || repeat(event_type, 60)"
    " WHEN 4 THEN 'AttributeError: ' || event_type || repeat(props, 40)"
    " WHEN 5 THEN '' ELSE 'ZeroDivisionError: ' || event_type || repeat(props, 60) END"
)
_CLASS = (
    "CASE event_id % 7 WHEN 0 THEN 'missing_column' WHEN 1 THEN 'DuplicateError' WHEN 2 THEN 'ColumnNotFoundError'"
    " WHEN 3 THEN 'SchemaError' WHEN 4 THEN 'AttributeError' WHEN 5 THEN 'empty' ELSE 'other' END"
)


@query(
    f"SELECT event_id, {_CLASS} AS error_class, CASE WHEN event_id % 7 = 0 THEN event_type END AS missing_column,"
    " CASE WHEN event_id % 7 = 0 THEN '\"event_id\", \"' || user_id || '\"' END AS valid_columns,"
    f" {_ERROR} AS message, CASE event_id % 7 WHEN 1 THEN left({_ERROR}, 200) WHEN 2 THEN left({_ERROR}, 200) WHEN 3 THEN left({_ERROR}, 250)"
    f" WHEN 4 THEN left({_ERROR}, 250) WHEN 6 THEN left({_ERROR}, 400) END AS excerpt FROM events"
)
def error_triage(t):
    messages = t.events.select("event_id", F.expr(_ERROR).alias("error"))
    return messages.select("event_id", errors.triage(F.col("error"), errors.EXCERPTS).alias("t")).select("event_id", "t.*")


@query(f"SELECT {_CLASS} AS error_class, count(*) AS n FROM events GROUP BY ALL")
def error_classes(t):
    return errors.class_counts(t.events.select(F.expr(_ERROR).alias("error")))


# --- schema texts -----------------------------------------------------------------


def _tables(first_rows="p_size"):
    """Nested tables of a part: one with two columns, one without rows, one without columns."""

    def columns(*pairs):
        return F.array(*[F.struct(n.alias("name"), F.lit(d).alias("dtype")) for n, d in pairs])

    named = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    no_columns = F.array().cast("array<struct<name:string,dtype:string>>")

    def table(name, rows, cols):
        return F.struct(name.alias("table"), rows.cast("bigint").alias("n_rows"), cols.alias("columns"))

    return F.array(
        table(F.lower("p_type"), F.col(first_rows), columns((named, "Utf8"), (F.lit("p_size"), "Int64"))),
        table(F.lit("empty"), F.lit(0), columns((F.lit("p_size"), "Int32"))),
        table(F.lit("bare"), F.lit(None), no_columns),
    )


_NAMED = "replace(p_name, ' ', '_')"


def _block_sql(header, bullet, gap, zero):
    first = f"'{header}{bullet}' || lower(p_type) || '{gap}(' || p_size || ' rows)'"
    empty = f"'{bullet}empty{gap + '(0 rows)' if zero else ''}'"
    return (
        f"{first} || chr(10) || '    ' || {_NAMED} || ': Utf8' || chr(10) || '    p_size: Int64' || chr(10) || {empty}"
        f" || chr(10) || '    p_size: Int32' || chr(10) || '{bullet}bare'"
    )


_DATASETS = "Datasets:' || chr(10) || '"
_CHAT_BLOCK = _block_sql(_DATASETS, "- ", " ", True)
_PLAN_BLOCK = _block_sql(_DATASETS, "- ", " ", False)
_CHECKED_BLOCK = _block_sql(_DATASETS, "  ", "  ", False)
_PLAIN_BLOCK = _block_sql("", "- ", "  ", True)
_REMINDER = (
    "'Available columns (any reference to a name NOT in this list will fail with ColumnNotFoundError):' || chr(10)"
    f" || '  ' || lower(p_type) || ': ' || {_NAMED} || ', p_size' || chr(10) || '  empty: p_size'"
)
_QUESTION = "'Which parts look like ' || p_name || '?'"


@query(
    f"SELECT p_partkey, {_CHAT_BLOCK} AS chat, {_PLAN_BLOCK} AS plan, {_CHECKED_BLOCK} AS checked,"
    f" {_PLAIN_BLOCK} AS plain FROM part"
)
def schema_blocks(t):
    return t.part.select("p_partkey", *[prompts.schema_block(_tables(), s).alias(s) for s in prompts.STYLES])


@query(f"SELECT p_partkey, {_REMINDER} AS reminder FROM part")
def column_reminder(t):
    return t.part.select("p_partkey", prompts.column_reminder(_tables()).alias("reminder"))


@query(
    f"SELECT p_partkey, {_CHAT_BLOCK} || chr(10) || chr(10) || 'Question: ' || {_QUESTION} AS turn,"
    f" {_CHAT_BLOCK} || chr(10) || chr(10) || 'Question: ' || {_QUESTION} || chr(10) || chr(10) || {_REMINDER} AS strict_turn,"
    f" 'Schema:' || chr(10) || {_PLAIN_BLOCK} || chr(10) || chr(10) || 'Question: ' || {_QUESTION} || chr(10) || chr(10)"
    " || 'Expected output columns (use these exact names, via .alias() when needed): [\"p_partkey\", \"p_size\"]'"
    " AS plain_turn FROM part"
)
def user_turns(t):
    question = F.expr(_QUESTION)
    wanted = F.array(F.lit("p_partkey"), F.lit("p_size"))
    return t.part.select(
        "p_partkey",
        prompts.user_turn(_tables(), question).alias("turn"),
        prompts.user_turn(_tables(), question, strict=True).alias("strict_turn"),
        prompts.plain_user_turn(_tables(), question, wanted).alias("plain_turn"),
    )


@query(
    "SELECT conv_id, turn, unnest(['system', 'user', 'assistant', 'user', 'assistant', 'user']) AS role,"
    " unnest(['Answer briefly.', 'Example?', 'An answer.', text, '> ' || text, 'Try again: ' || role]) AS content,"
    " unnest([0, 1, 2, 3, 4, 5]) AS position FROM conversations"
)
def chat_messages(t):
    messages = prompts.chat_messages("Answer briefly.", [("Example?", "An answer.")], F.col("text"))
    repaired = prompts.repair_messages(messages, F.concat(F.lit("> "), "text"), F.concat(F.lit("Try again: "), "role"))
    rows = t.conversations.select("conv_id", "turn", F.posexplode(repaired).alias("position", "m"))
    return rows.select("conv_id", "turn", "m.role", "m.content", "position")


@query(
    f"SELECT p_partkey, array_to_string(list_sort(['bare', 'empty', lower(p_type)]), ',') AS tables,"
    f" array_to_string(list_sort([{_NAMED}, 'p_size']), ',') AS columns FROM part"
)
def schema_names(t):
    names = t.part.select("p_partkey", prompts.schema_names(_tables()).alias("n"))
    return names.select(
        "p_partkey", F.array_join("n.tables", ",").alias("tables"), F.array_join("n.columns", ",").alias("columns")
    )


# --- corpora ------------------------------------------------------------------------

# Questions on two databases; both hold the given tables.
_QUESTIONS = (
    ("q_0000", "sales", "How many orders per status?",
     "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    ("q_0001", "sales", "Which orders cost nothing?", "SELECT o_orderkey FROM orders WHERE o_totalprice < 0"),
    ("q_0002", "sales", "What does each customer spend?",
     "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey"),
    ("q_0003", "sales", "Which column is wrong?", "SELECT o_price FROM orders"),
    ("q_0004", "stock", "Which parts sell?", "SELECT DISTINCT l_partkey FROM lineitem"),
    ("q_0005", "stock", "Is this SQL?", "SELEC l_partkey FROM lineitem"),
    ("q_0006", "stock", "How much is sold per flag?",
     "SELECT l_returnflag, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag"),
)
_DATABASES = {"sales": ["orders", "customer"], "stock": ["lineitem", "part"]}


def _question_corpus(t):
    questions = t.spark.createDataFrame(list(_QUESTIONS), "id string, db_id string, question string, sql string")
    return build.build_question_corpus(
        questions,
        lambda session, db_id: load_tables(session, t.folder, _DATABASES[db_id]),
        scratch_path(t.spark, "question-outputs"),
    )


def _corpus_sql():
    parts = []
    for qid, db_id, _, sql in _QUESTIONS:
        if "o_price" in sql or sql.startswith("SELEC "):
            parts.append(f"SELECT '{qid}' AS id, 'failed' AS status, CAST(NULL AS BIGINT) AS n_rows, '' AS columns")
            continue
        names = {"q_0000": "o_orderstatus,n", "q_0001": "o_orderkey", "q_0002": "o_custkey,spent",
                 "q_0004": "l_partkey", "q_0006": "l_returnflag,quantity"}[qid]
        parts.append(
            f"SELECT '{qid}' AS id, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) AS n_rows,"
            f" '{names}' AS columns FROM ({sql})"
        )
    return " UNION ALL ".join(parts)


_TABLES_OF = {
    "sales": "'customer=' || (SELECT count(*) FROM customer) || ',orders=' || (SELECT count(*) FROM orders)",
    "stock": "'lineitem=' || (SELECT count(*) FROM lineitem) || ',part=' || (SELECT count(*) FROM part)",
}


def _table_counts():
    """The tables of a record as text, ``name=rows``."""
    entries = F.transform(
        F.map_entries("tables"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["n_rows"].cast("string"))
    )
    return F.array_join(F.array_sort(entries), ",")


@query(f"SELECT id, status, n_rows, columns FROM ({_corpus_sql()})")
def question_outcomes(t):
    _, outcomes = _question_corpus(t)
    return outcomes.select("id", "status", "n_rows", F.coalesce(F.array_join("columns", ","), F.lit("")).alias("columns"))


@query(
    f"SELECT o.id, CASE WHEN o.id < 'q_0004' THEN 'sales' ELSE 'stock' END AS db_id, n_rows AS expected_n_rows,"
    f" CASE WHEN o.id < 'q_0004' THEN {_TABLES_OF['sales']} ELSE {_TABLES_OF['stock']} END AS tables,"
    f" 64 AS hash_length FROM ({_corpus_sql()}) o WHERE status = 'ok'"
)
def question_records(t):
    records, _ = _question_corpus(t)
    return records.select(
        "id", "db_id", "expected_n_rows", _table_counts().alias("tables"),
        F.length("expected_output_hash").alias("hash_length"),
    )


# The catalog queries that answer a reference question name the tables they use.
_REFERENCES = {name: q for name, q in QUERIES.items() if q.tables}


def _references_sql():
    return " UNION ALL ".join(
        f"SELECT '{name}' AS id, (SELECT count(*) FROM ({q.sql})) AS n_rows, "
        + " || ',' || ".join(f"'{x}=' || (SELECT count(*) FROM {x})" for x in sorted(q.tables))
        + " AS tables"
        for name, q in _REFERENCES.items()
    )


@query(_references_sql())
def reference_records(t):
    used = {name: q.tables for name, q in _REFERENCES.items()}
    tables = load_tables(t.spark, t.folder, sorted({x for names in used.values() for x in names}))
    catalog = {name: (lambda _, run=q.run: run(t)) for name, q in _REFERENCES.items()}
    records, _ = build.build_references(t.spark, catalog, tables, used, scratch_path(t.spark, "reference-outputs"))
    return records.select("id", F.col("expected_n_rows").alias("n_rows"), _table_counts().alias("tables"))
