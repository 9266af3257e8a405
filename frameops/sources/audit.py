"""What a SQL text would do, checked before any of it is done.

The text is parsed and its plan walked: nodes, functions and relations must be on lists of what a query over given
tables needs. Programs, reflection, files by path, commands and functions that nobody has listed are refused. Nothing
is analysed or run.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

# Parts of plans that only read, compute and combine.
NODES = frozenset(
    "Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit"
    " Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sort SubqueryAlias"
    " Tail Union Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases"
    " UnresolvedTableValuedFunction UnresolvedWith Window WithCTE WithWindowDefinition".split()
)
EXPRESSIONS = frozenset(
    "Add AggregateExpression Alias And AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen"
    " Cast Concat CreateNamedStruct CurrentRow$ Cube Descending$ Divide EqualNullSafe EqualTo Exists Extract"
    " GreaterThan GreaterThanOrEqual GroupingSets If ILike In InSubquery IntegralDivide IsNaN IsNotNull IsNull"
    " LambdaFunction LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal MultiAlias Multiply"
    " NamedExpression Not NotLikeAll NotLikeAny Or OuterReference Overlay RLike Remainder Rollup ScalarSubquery"
    " SortOrder SpecifiedWindowFrame Substring Subtract TimestampAdd TimestampDiff TryCast UnaryMinus UnaryPositive"
    " UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue"
    " UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedRegex"
    " UnresolvedStar UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition".split()
)
# Functions of values, rows and groups. None reads files, runs programs or looks at the session.
FUNCTIONS = frozenset(
    "abs acos any any_value approx_count_distinct approx_percentile array array_agg array_compact array_contains"
    " array_distinct array_except array_intersect array_join array_max array_min array_position array_remove"
    " array_repeat array_size array_sort array_union arrays_overlap arrays_zip ascii asin atan atan2 avg bit_and"
    " bit_count bit_length bit_or bit_xor bool_and bool_or bround btrim cardinality cast ceil ceiling char char_length"
    " character_length chr coalesce collect_list collect_set concat concat_ws contains corr cos count count_if"
    " covar_pop covar_samp crc32 cume_dist date date_add date_diff date_format date_from_unix_date date_part date_sub"
    " date_trunc dateadd datediff day dayofmonth dayofweek dayofyear decimal degrees dense_rank double e element_at"
    " elt endswith every exists exp explode explode_outer extract factorial filter find_in_set first first_value"
    " flatten float floor forall format_number format_string from_json get get_json_object greatest grouping"
    " grouping_id hash hex hour if ifnull ilike initcap inline instr int isnan isnotnull isnull kurtosis lag last"
    " last_day last_value lcase lead least left len length levenshtein like listagg ln locate log log10 log2 lower"
    " lpad ltrim make_date make_timestamp map map_concat map_entries map_from_arrays map_keys map_values max max_by"
    " md5 mean median min min_by minute mod mode month months_between named_struct negative next_day now nth_value"
    " ntile nullif nvl nvl2 octet_length overlay percent_rank percentile percentile_approx pi pmod posexplode"
    " position positive pow power quarter radians rank regexp regexp_count regexp_extract regexp_extract_all"
    " regexp_instr regexp_like regexp_replace regexp_substr regr_slope repeat replace reverse right rint rlike round"
    " row_number rpad rtrim second sequence sha sha1 sha2 shiftleft shiftright sign signum sin size skewness slice"
    " some sort_array split split_part sqrt stack startswith std stddev stddev_pop stddev_samp string string_agg"
    " struct substr substring substring_index sum tan timestamp timestampadd timestampdiff to_char to_date to_json"
    " to_number to_timestamp transform translate trim trunc try_add try_avg try_cast try_divide try_element_at"
    " try_subtract try_sum try_to_number try_to_timestamp typeof ucase unhex unix_date unix_timestamp upper"
    " var_pop var_samp variance weekday weekofyear when width_bucket xxhash64 year zip_with".split()
)
TABLE_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "posexplode", "inline", "stack"))


class RefusedError(Exception):
    """A text that asks for more than a query over its tables."""


def _nodes(part: object) -> Iterator[dict]:
    if isinstance(part, dict):
        if "class" in part:
            yield part
        for value in part.values():
            yield from _nodes(value)
    elif isinstance(part, list):
        for value in part:
            yield from _nodes(value)


def _names(text: object) -> list[str]:
    """The parts of a name, as the plan writes it."""
    return str(text).strip("[]").split(", ")


def refused(session: SparkSession, sql: str, tables: Iterable[str] | None = None, functions: Iterable[str] = ()) -> list[str]:
    """What the text asks for that is on no list, in the order of its plan; empty for a plain query.

    With ``tables``, only those, and what the text itself names, can be read; ``functions`` are admitted too. A text
    that is no query is a parse error.
    """
    plan = session._jsparkSession.sessionState().sqlParser().parseQuery(sql)
    nodes = list(_nodes(json.loads(plan.toJSON())))
    admitted = FUNCTIONS | {f.lower() for f in functions}
    own = {n["identifier"]["name"].lower() for n in nodes if isinstance(n.get("identifier"), dict) and "name" in n["identifier"]}
    known = None if tables is None else own | {t.lower() for t in tables}
    found = []
    for node in nodes:
        package, _, kind = node["class"].rpartition(".")
        if kind == "UnresolvedFunction":
            name = _names(node.get("nameParts"))
            if len(name) > 1 or name[0].lower() not in admitted:
                found.append(f"function {'.'.join(name)}")
        elif kind == "UnresolvedGenerator":
            name = str(node["name"].get("funcName") if isinstance(node["name"], dict) else node["name"])
            if name.lower() not in admitted:
                found.append(f"function {name}")
        elif kind == "UnresolvedTableValuedFunction":
            name = _names(node.get("name"))
            if len(name) > 1 or name[0].lower() not in TABLE_FUNCTIONS:
                found.append(f"function {'.'.join(name)}")
        elif kind == "UnresolvedRelation":
            name = _names(node.get("multipartIdentifier"))
            if len(name) > 1 or (known is not None and name[0].lower() not in known):
                found.append(f"relation {'.'.join(name)}")
        elif kind not in (EXPRESSIONS if "expressions" in package or kind in EXPRESSIONS else NODES):
            found.append(f"node {kind.rstrip('$')}")
    return list(dict.fromkeys(found))
