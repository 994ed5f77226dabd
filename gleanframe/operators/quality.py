"""Data quality per column and per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT_LIMITS, Limits
from ..functions import scalar as S
from ..sources.tables import Table
from . import frequency as Q


def quality_columns(described: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Fill and uniqueness with issue flags, from structure rows."""
    rows, filled, levels, kind = (F.col(c) for c in ("rows", "non_null", "nunique", "kind"))
    base = described.filter(kind.isNotNull()).select(
        "table_id", "column", "ordinal", "kind", "rows", "non_null",
        (rows - filled).alias("missing"),
        S.percent(rows - filled, rows).alias("missing_pct"),
        "nunique",
        S.percent(levels, filled).alias("unique_pct"),
        "complete_rows",
    )
    missing, unique = F.col("missing_pct"), F.col("unique_pct")
    flags = {
        "high_missing": missing >= limits.high_missing_pct,
        "moderate_missing": (missing >= limits.moderate_missing_pct) & (missing < limits.high_missing_pct),
        "constant": (filled > 0) & (levels == 1),
        "near_unique": (filled > limits.near_unique_min_rows) & (unique >= limits.near_unique_pct)
        & (kind != "identifier"),
        "likely_identifier": kind == "identifier",
    }
    return base.withColumn("issues", F.array_compact(F.array(*[F.when(t, n) for n, t in flags.items()])))


def quality_score(avg_missing: Column, duplicate_pct: Column, high: Column, constant: Column,
                  near_unique: Column) -> Column:
    """0 to 100; halves round to even."""
    lost = (
        F.least(avg_missing * 0.6, F.lit(30.0)) + F.least(duplicate_pct * 0.5, F.lit(20.0))
        + F.least(high * 5.0, F.lit(15.0)) + F.least(constant * 3.0, F.lit(10.0))
        + F.least(near_unique * 2.0, F.lit(10.0))
    )
    return F.greatest(F.bround(F.lit(100.0) - lost, 0), F.lit(0.0)).cast("bigint")


def grade(score: Column) -> Column:
    return F.when(score >= 75, "good").when(score >= 50, "fair").otherwise("poor")


def quality_summary(columns: DataFrame, duplicates: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One row per table from its column rows and (table_id, duplicate_rows) rows."""
    def having(issue: str) -> Column:
        return F.count_if(F.array_contains("issues", issue))

    kinds = (
        columns.groupBy("table_id", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"))
        .groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("column_kinds"))
    )
    base = columns.groupBy("table_id").agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
        F.coalesce(F.round(F.avg("missing_pct"), 2), F.lit(0.0)).alias("avg_missing_pct"),
        having("high_missing").alias("high_missing_columns"),
        having("moderate_missing").alias("moderate_missing_columns"),
        having("constant").alias("constant_columns"),
        having("near_unique").alias("near_unique_columns"),
        having("likely_identifier").alias("identifier_columns"),
        F.max("complete_rows").alias("complete_rows"), F.sum("non_null").alias("filled_cells"),
        F.slice(
            F.array_sort(F.collect_list(F.when(F.col("missing_pct") > 0, F.struct(
                (-F.col("missing_pct")).alias("order"), "ordinal", "column", "missing_pct", "kind")))),
            1, limits.top_missing,
        ).alias("worst"),
    )
    joined = base.join(duplicates.select("table_id", "duplicate_rows"), "table_id").join(kinds, "table_id")
    rows = F.col("rows")
    pct = joined.withColumn("duplicate_pct", S.percent(F.col("duplicate_rows"), rows))
    scored = pct.withColumn(
        "score",
        quality_score(F.col("avg_missing_pct"), F.col("duplicate_pct"), F.col("high_missing_columns"),
                      F.col("constant_columns"), F.col("near_unique_columns")),
    )
    return scored.select(
        "table_id", "rows", "columns", "duplicate_rows", "duplicate_pct", "avg_missing_pct", "score",
        grade(F.col("score")).alias("grade"), "high_missing_columns", "moderate_missing_columns",
        "constant_columns", "near_unique_columns", "identifier_columns", "complete_rows",
        S.percent(F.col("complete_rows"), rows).alias("complete_pct"),
        (rows - F.col("complete_rows")).alias("rows_with_missing"),
        F.coalesce(F.round(F.try_divide(F.col("filled_cells") * 100.0, rows * F.col("columns")), 2),
                   F.lit(100.0)).alias("fill_rate_pct"),
        F.greatest(F.col("columns") - F.col("constant_columns") - F.col("identifier_columns"), F.lit(0)).alias(
            "usable_columns"),
        "column_kinds",
        F.transform("worst", lambda w: F.struct(w["column"].alias("column"), w["missing_pct"].alias("missing_pct"),
                                                w["kind"].alias("kind"))).alias("top_missing"),
    )


def table_duplicates(table: Table) -> DataFrame:
    return Q.duplicate_rows(table.df).select(F.lit(table.id).alias("table_id"), "rows", "duplicate_rows")


def top_missing(columns: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The columns with most gaps per table."""
    gaps = columns.filter(F.col("missing_pct") > 0).select("table_id", "column", "ordinal", "missing_pct", "kind")
    return Q.top_per_group(gaps, ["table_id"], [F.desc("missing_pct"), F.asc("ordinal")], limits.top_missing)


#: Levels that a chart of counts shows.
COUNTED_LEVELS = (2, 25)


def skipped_columns(described: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(table_id, column, analysis, levels, least, most, reason): the categories that an analysis leaves out, and why.

    ``described`` are structure rows; ``least`` is null where an analysis has no lower limit.
    """
    ranges = {
        "associations": (None, limits.max_category_levels), "concentration": (limits.core_min_categories, limits.core_max_categories),
        "group_profiles": (limits.group_min_levels, limits.group_max_levels), "category_counts": COUNTED_LEVELS,
    }
    rules = F.array(*[F.struct(F.lit(name).alias("analysis"), F.lit(low).cast("bigint").alias("least"), F.lit(high).cast("bigint").alias("most"))
                      for name, (low, high) in ranges.items()])
    categories = described.where(F.col("kind").isin("categorical", "boolean")).select(
        "table_id", "column", F.col("nunique").cast("bigint").alias("levels"), F.explode(rules).alias("rule")).select("table_id", "column", "levels", "rule.*")
    reason = F.when(F.col("levels") > F.col("most"), "too many levels").when(F.col("levels") < F.col("least"), "too few levels")
    return categories.withColumn("reason", reason).where("reason IS NOT NULL").select("table_id", "column", "analysis", "levels", "least", "most", "reason")
