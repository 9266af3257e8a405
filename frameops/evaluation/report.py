"""Roll-up reports over a table of evaluation results.

A result row has ``id, tags, difficulty, generated_code`` and the outcome of each
step; :func:`tier_flags` turns outcomes into flags and the reports count them. All
groupings are partial aggregates over a handful of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.corpus.screen import strip

# Tiers from weakest to strongest.
TIERS = ("parses", "runs", "matches")
PLAN_TIERS = ("plan_valid", "converted", *TIERS)

# Order in which failure stages are listed.
STAGE_ORDER = (
    "invalid-plan", "convert-fail", "syntax", "crash",
    "empty_actual", "column_set", "row_count", "content", "wrong-output",
)


def _blank(code: Column) -> Column:
    return F.coalesce(strip(code) == "", F.lit(True))


def tier_flags(outcomes: DataFrame, from_plans: bool = False) -> DataFrame:
    """Flags ``parses``, ``runs``, ``matches`` and the ``error`` of the first step that failed.

    Reads ``generated_code``, ``generation_error``, ``syntax_error``, ``run_error``
    and ``comparison`` (struct with ``match``, ``reason``, ``summary``; null when there
    is nothing to compare with). ``from_plans`` adds ``plan_valid`` and ``converted``
    and reads ``json_plan``.
    """
    failed = F.col("generation_error").isNotNull()
    blank = _blank(F.col("generated_code"))
    parses = ~failed & ~blank & F.col("syntax_error").isNull()
    runs = parses & F.col("run_error").isNull()
    compared = F.col("comparison").isNotNull()
    matches = runs & F.coalesce(F.col("comparison.match"), F.lit(False))
    # Error texts of the steps.
    empty = "empty conversion" if from_plans else "empty generation"
    error = (
        F.when(failed, F.concat(F.lit("generation failed: "), "generation_error"))
        .when(blank, F.lit(empty))
        .when(~parses, F.concat(F.lit("SyntaxError: "), "syntax_error"))
        .when(~runs, F.col("run_error"))
        .when(~compared, F.lit("no expected parquet for this record"))
        .when(~matches, F.col("comparison.summary"))
    )
    flags = {"parses": parses, "runs": runs, "matches": matches, "error": error}
    if from_plans:
        flags = {
            "plan_valid": F.col("json_plan").isNotNull(),
            "converted": ~failed & ~blank,
            **flags,
        }
    return outcomes.withColumns(flags)


def stage(from_plans: bool = False) -> Column:
    """The stage a result got to: ``match`` or the reason it failed."""
    reached = (
        F.when(F.col("matches"), "match")
        .when(F.col("runs"), F.coalesce(F.col("comparison.reason"), F.lit("wrong-output")))
        .when(F.col("parses"), "crash")
    )
    if not from_plans:
        return reached.otherwise("syntax")
    return (
        reached.when(F.col("converted"), "syntax")
        .when(F.col("plan_valid"), "convert-fail")
        .otherwise("invalid-plan")
    )


def _hits() -> list[Column]:
    hits = F.count_if(F.col("matches"))
    total = F.count(F.lit(1))
    return [hits.alias("hits"), total.alias("total"), (hits / total * 100).alias("pct")]


def overall(results: DataFrame, tiers: Sequence[str] = TIERS) -> DataFrame:
    """Count and percentage per tier, number of results and mean latency (0 if unknown)."""
    total = F.count(F.lit(1))
    columns = [total.alias("n")]
    for tier in tiers:
        columns += [F.count_if(F.col(tier)).alias(tier), (F.count_if(F.col(tier)) / total * 100).alias(f"{tier}_pct")]
    columns.append(F.avg(F.coalesce(F.col("latency_sec"), F.lit(0.0))).alias("avg_latency"))
    return results.agg(*columns).where(F.col("n") > 0)


def by_tag(results: DataFrame) -> DataFrame:
    """Hit rate per tag; a result counts for each of its tags."""
    return results.select("matches", F.explode("tags").alias("tag")).groupBy("tag").agg(*_hits()).orderBy("tag")


def by_difficulty(results: DataFrame) -> DataFrame:
    return results.groupBy("difficulty").agg(*_hits()).orderBy("difficulty")


def by_stage(results: DataFrame, from_plans: bool = False) -> DataFrame:
    """Number of failures per stage, in display order; every stage is listed."""
    counted = (
        results.where(~F.col("matches"))
        .groupBy(stage(from_plans).alias("stage"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    place = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.col("stage"))
    position = F.when(place > 0, place).otherwise(F.lit(len(STAGE_ORDER) + 1))
    return counted.withColumn("position", position.cast("long")).orderBy("position", "stage")


def by_level(results: DataFrame, level: str = "cascade_level") -> DataFrame:
    """Results and hits per cascade level; rows without a level are left out."""
    return (
        results.where(F.col(level).isNotNull() & (F.col(level) != ""))
        .groupBy(level)
        .agg(*_hits())
        .orderBy(level)
    )


def failures(results: DataFrame, from_plans: bool = False) -> DataFrame:
    """Stage, id and error of every result that does not match."""
    return results.where(~F.col("matches")).select(stage(from_plans).alias("stage"), "id", "error")


def score(results: DataFrame, run: str = "run") -> DataFrame:
    """Score per run: matches / (total seconds * VRAM^0.1 * RAM^0.01).

    Reads ``matches``, ``latency_sec``, ``vram_gb`` and ``ram_gb``; the memory of a
    run is the largest it reports.
    """
    seconds = F.sum(F.coalesce(F.col("latency_sec"), F.lit(0.0)))
    summed = results.groupBy(run).agg(
        F.count_if(F.col("matches")).alias("n_correct"),
        seconds.alias("total_sec"),
        F.max("vram_gb").alias("vram_gb"),
        F.max("ram_gb").alias("ram_gb"),
    )
    cost = F.col("total_sec") * F.pow("vram_gb", F.lit(0.1)) * F.pow("ram_gb", F.lit(0.01))
    return summed.withColumn("score", F.when(cost != 0, F.col("n_correct") / cost))


def compare_runs(results: DataFrame, runs: Sequence[object], by: str | None = None, run: str = "run") -> DataFrame:
    """Hit rate of the named runs side by side, overall or per value of ``by``.

    The runs are named, so one pass of conditional counts does it.
    """
    columns = []
    for value in runs:
        here = F.col(run) == F.lit(value)
        total = F.count_if(here)
        columns += [
            total.alias(f"n_{value}"),
            F.when(total > 0, F.count_if(here & F.col("runs")) / total * 100).alias(f"runs_pct_{value}"),
            F.when(total > 0, F.count_if(here & F.col("matches")) / total * 100).alias(f"matches_pct_{value}"),
            F.avg(F.when(here, F.coalesce(F.col("latency_sec"), F.lit(0.0)))).alias(f"latency_{value}"),
        ]
    return (results.groupBy(by) if by else results).agg(*columns)
