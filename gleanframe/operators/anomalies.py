"""Outlying, implausible and misspelled values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT_LIMITS, Limits
from ..functions import scalar as S
from ..sources.literals import settled
from . import frequency as Q, order_stats as O
from .structure import Roles, ordered


def _out_of(low: str, high: str) -> Column:
    return F.coalesce((F.col("x") < F.col(low)) | (F.col("x") > F.col(high)), F.lit(False))


def _far_by_median(limits: Limits) -> Column:
    z = F.try_divide(limits.z_scale * (F.col("x") - F.col("median")), F.col("mad"))
    return F.coalesce((F.col("mad") > 0) & (F.abs(z) > limits.z_threshold), F.lit(False))


BOUNDS = ("min", "max", "mean", "median", "mad", "near_low", "near_high", "wide_low", "wide_high")


def outlier_bounds(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One row per testable column: its statistics, both fences and the median deviation.

    mad is the median distance from the median, and null where the column has too
    few levels for the median test.  Infinite values take no part in the bounds, so
    they lie beyond them.  The rows are computed at once: one per column.
    """
    rows = Q.number_rows(df, columns).filter(S.finite(F.col("x")).isNotNull())
    levels = Q.distinct_up_to(rows, ["column"], "x", limits.z_min_levels)
    base = rows.groupBy("column").agg(
        F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean")
    )
    cuts = O.quantile_columns(rows, ["column"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # every side has one row per column
    known = settled(
        base.join(F.broadcast(levels), "column").join(F.broadcast(cuts), "column")
        .filter((F.col("n") >= limits.outlier_min_rows) & (F.col("levels") >= limits.outlier_min_levels))
    )
    centre = known.filter(F.col("levels") >= limits.z_min_levels).select("column", "median")
    gaps = rows.join(F.broadcast(centre), "column").select("column", F.abs(F.col("x") - F.col("median")).alias("x"))
    mad = O.quantile_columns(gaps, ["column"], {"mad": 0.5})
    width = F.when(F.col("q3") > F.col("q1"), F.col("q3") - F.col("q1"))
    return settled(known.join(F.broadcast(mad), "column", "left").select(
        "column", "min", "max", "mean", "median", "mad",
        (F.col("q1") - limits.fence * width).alias("near_low"), (F.col("q3") + limits.fence * width).alias("near_high"),
        (F.col("q1") - limits.wide_fence * width).alias("wide_low"),
        (F.col("q3") + limits.wide_fence * width).alias("wide_high"),
    ))


def numeric_outliers(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(column, n_outliers, pct, fence, lower, upper, min, max, median, mean, mad) of columns with outliers.

    Values beyond the 1.5 IQR fence (3.0 where that would flag more than 12 % of all
    rows) or far from the median; both fences are counted in the same pass.
    """
    bounds = outlier_bounds(df, columns, limits)
    rows_total = df.agg(F.count(F.lit(1))).scalar()
    far = _far_by_median(limits)
    near, wide = _out_of("near_low", "near_high"), _out_of("wide_low", "wide_high")
    tested = Q.number_rows(df, columns).join(F.broadcast(bounds), "column")
    # the bounds depend on the column, so they may travel as grouping keys
    counts = tested.groupBy("column", *BOUNDS).agg(
        F.count_if(near).alias("n_near"), F.count_if(near | far).alias("with_near"),
        F.count_if(wide | far).alias("with_wide"),
    ).withColumn("rows", rows_total)
    use_wide = F.col("n_near") > limits.wide_fence_share * F.col("rows")
    found = counts.withColumn("use_wide", use_wide).withColumn(
        "n_outliers", F.when(F.col("use_wide"), F.col("with_wide")).otherwise(F.col("with_near"))
    )
    fenced = F.col("near_low").isNotNull()
    return found.filter("n_outliers > 0").select(
        "column", "n_outliers", S.percent(F.col("n_outliers"), F.col("rows"), None).alias("pct"),
        F.when(fenced, F.when(F.col("use_wide"), limits.wide_fence).otherwise(limits.fence)).alias("fence"),
        F.when(F.col("use_wide"), F.col("wide_low")).otherwise(F.col("near_low")).alias("lower"),
        F.when(F.col("use_wide"), F.col("wide_high")).otherwise(F.col("near_high")).alias("upper"),
        "min", "max", "median", "mean", "mad",
    )


def outlying_rows(df: DataFrame, found: DataFrame, columns: Sequence[str],
                  limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(column, x): every flagged value; ``found`` are rows of ``numeric_outliers``, one per column."""
    bounds = found.select("column", "lower", "upper", "median", "mad")
    rows = Q.number_rows(df, columns).join(F.broadcast(bounds), "column")
    return rows.filter(_out_of("lower", "upper") | _far_by_median(limits)).select("column", "x")


def outlier_examples(df: DataFrame, found: DataFrame, columns: Sequence[str],
                     limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(column, rank, value, count): the most frequent outlying values."""
    counts = outlying_rows(df, found, columns, limits).groupBy("column", "x").agg(F.count(F.lit(1)).alias("count"))
    top = Q.top_per_group(counts, ["column"], [F.desc("count"), F.asc("x")], limits.outlier_examples)
    return top.select("column", "rank", F.col("x").alias("value"), "count")


def outliers_with_examples(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    found = settled(numeric_outliers(df, columns, limits))
    return with_examples(found, outlier_examples(df, found, columns, limits))


def with_examples(found: DataFrame, examples: DataFrame) -> DataFrame:
    """Outlier rows with their examples as an array."""
    listed = examples.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
                    lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count"))).alias("examples")
    )
    return found.join(F.broadcast(listed), "column", "left").drop("mad")


def implausible(df: DataFrame, roles: Roles, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(column, issue, count, pct, detail): negative, zero, tiny_area and rare_level findings.

    A column named by several roles is reported once per issue.
    """
    columns = roles.measures()
    rows = Q.number_rows(df, columns)
    total = df.agg(F.count(F.lit(1))).scalar()
    signs = rows.groupBy("column").agg(
        F.count("x").alias("n"), F.count_if(F.col("x") < 0).alias("negative"),
        F.count_if(F.col("x") == 0).alias("zero"), F.count_if(F.col("x") == limits.tiny_value).alias("tiny"),
    )
    priced = F.col("column").isin(*ordered(roles.money, roles.area)) if roles.money or roles.area else F.lit(False)
    sized = F.col("column").isin(*roles.area) if roles.area else F.lit(False)
    enough = F.greatest(F.lit(float(limits.tiny_min_count)), limits.tiny_share * F.col("n"))
    issues = F.array_compact(F.array(
        F.when(F.col("negative") > 0, F.struct(F.lit("negative").alias("issue"), F.col("negative").alias("count"))),
        F.when(priced & (F.col("zero") > 0), F.struct(F.lit("zero").alias("issue"), F.col("zero").alias("count"))),
        F.when(sized & (F.col("tiny") >= enough), F.struct(F.lit("tiny_area").alias("issue"), F.col("tiny").alias("count"))),
    ))
    found = signs.select("column", F.explode(issues).alias("i")).select(
        "column", "i.issue", "i.count", F.lit(None).cast("string").alias("detail"))
    if roles.numeric:
        rare = rare_levels(df, roles.numeric, limits)
        summary = rare.groupBy("column").agg(
            F.sum("n").alias("count"),
            F.array_sort(F.collect_list(F.when(
                F.col("rank") <= limits.rare_level_listed,
                F.struct("rank", F.concat(F.col("x").cast("string"), F.lit("x"), F.col("n").cast("string")).alias("t")),
            ))).alias("listed"),
        )
        found = found.unionByName(summary.select(
            "column", F.lit("rare_level").alias("issue"), "count",
            F.concat_ws(", ", F.transform("listed", lambda e: e["t"])).alias("detail")))
    return found.withColumn("pct", S.percent(F.col("count"), total, None)).select(
        "column", "issue", "count", "pct", "detail")


def rare_levels(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(column, x, n, rank): scarce values of numeric columns with 3 to 12 levels, most frequent first."""
    rows = Q.number_rows(df, columns)
    levels = Q.distinct_up_to(rows, ["column"], "x", limits.rare_max_levels + 1)
    few = levels.filter(F.col("levels").between(limits.rare_min_levels, limits.rare_max_levels))
    counts = rows.join(F.broadcast(few), "column", "left_semi").groupBy("column", "x").agg(
        F.count(F.lit(1)).alias("n"))
    per_column = Window.partitionBy("column")      # at most 12 rows each
    cut = F.greatest(F.lit(limits.rare_level_floor), F.floor(limits.rare_level_share * F.sum("n").over(per_column)))
    rare = counts.withColumn("cut", cut).filter(F.col("n") <= F.col("cut")).drop("cut")
    order = per_column.orderBy(F.desc("n"), F.asc("x"))
    return rare.withColumn("rank", F.row_number().over(order).cast("bigint"))


def label_variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, canonical, value, count, variants, total): spellings that differ in case or outer blanks only."""
    counts = Q.value_counts(df, columns, stripped=True).withColumn("canonical", S.fold_case(F.col("value")))
    groups = counts.groupBy("column", "canonical").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("n").alias("total")
    ).filter("variants >= 2")
    return counts.join(groups, ["column", "canonical"]).select(
        "column", "canonical", "value", F.col("n").alias("count"), "variants", "total")


def label_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, canonical, variants array<struct<value,count>>, total)."""
    return label_variants(df, columns).groupBy("column", "canonical").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "value", "count"))),
            lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count")),
        ).alias("variants"),
        F.first("total").alias("total"),
    )
