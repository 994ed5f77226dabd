"""Core and periphery of categorical columns, and groups compared by a number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT_LIMITS, Limits
from ..functions import scalar as S
from ..sources.literals import literal_rows, settled
from ..sources.sinks import stored
from . import frequency as Q, order_stats as O


def concentration_values(df: DataFrame, columns: Sequence[str], geo: Sequence[str] = (),
                         limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(column, role, value, count, share_pct, script, majority_script, in_core, flags, rank).

    Columns with 3 to 400 values.  The core are values of at least 5 % of all rows, or,
    where those hold less than half of them, the most frequent values up to 80 %.
    """
    texts = Q.text_rows(df, columns, stripped=True)
    levels = Q.distinct_up_to(texts, ["column"], "value", limits.core_max_categories + 1)
    fitting = levels.filter(F.col("levels").between(limits.core_min_categories, limits.core_max_categories))
    counts = texts.join(F.broadcast(fitting), "column", "left_semi").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(F.lit(1))).scalar()

    # all windows below see at most 400 rows per column
    whole = Window.partitionBy("column")
    by_size = whole.orderBy(F.desc("n"), F.asc("value"))
    shares = (
        counts.withColumn("rows", rows)
        .withColumn("share", F.col("n") / F.col("rows"))
        .withColumn("script", S.script_of(F.col("value")))
        .withColumn("script_n", F.sum("n").over(Window.partitionBy("column", "script")))
        .withColumn("big", F.col("share") >= limits.core_min_share)
    )
    placed = (
        shares.withColumn("big_total", F.sum(F.when(F.col("big"), F.col("n"))).over(whole) / F.col("rows"))
        .withColumn("ahead", F.coalesce(
            F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.col("rows"))
        .withColumn("majority_script", F.first("script").over(
            whole.orderBy(F.desc("script_n"), F.asc("script"))
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("rank", F.row_number().over(by_size).cast("bigint"))
    )
    by_share = F.coalesce(F.col("big_total") >= limits.core_min_total, F.lit(False))
    in_core = F.when(by_share, F.col("big")).otherwise(F.col("ahead") < limits.core_coverage)
    rare_cut = F.least(
        F.greatest(F.lit(limits.rare_count_floor), F.floor(F.col("rows") * limits.rare_share)),
        F.lit(limits.rare_count_cap),
    )
    foreign = F.col("majority_script").isin("cyrillic", "latin") & ~F.col("script").isin("other", "mixed") & (
        F.col("script") != F.col("majority_script"))
    flags = F.array_compact(F.array(
        F.when(~F.col("in_core"), "periphery"), F.when(F.col("n") <= rare_cut, "rare"),
        F.when(foreign, "foreign_script"),
    ))
    role = F.when(F.col("column").isin(*geo), "geo").otherwise("categorical") if geo else F.lit("categorical")
    return placed.withColumn("in_core", in_core).select(
        "column", role.alias("role"), "value", F.col("n").alias("count"),
        (F.col("share") * 100).alias("share_pct"), "script", "majority_script", "in_core", flags.alias("flags"),
        "rank",
    )


def concentration_summary(values: DataFrame) -> DataFrame:
    """(column, role, n_categories, core_size, core_coverage_pct, majority_script) from value rows."""
    return values.groupBy("column", "role").agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.count_if(F.col("in_core")).alias("core_size"),
        F.coalesce(F.sum(F.when(F.col("in_core"), F.col("share_pct"))), F.lit(0.0)).alias("core_coverage_pct"),
        F.first("majority_script").alias("majority_script"),
    )


def _grouped_rows(df: DataFrame, categories: Sequence[str], numbers: Sequence[str],
                  null_label: str | None) -> DataFrame:
    """(cat, num, value, whole, x) of every category and number combination, and of ``whole`` groups: all rows of a number.

    Where missing categories form a group, a number has the same rows beside every category: its whole group has no
    category.  Otherwise there is one for each category.
    """
    types = Q.dtypes(df)
    slots = {c: f"__g{i}" for i, c in enumerate(categories)}
    keep = [S.label(c, types[c], null_label).alias(slot) for c, slot in slots.items()]
    long = Q.unpivot(df, {n: S.number(n, types[n]) for n in numbers}, "num", "x", keep).filter("x IS NOT NULL")

    def group(cat: str, value: Column, whole: bool) -> Column:
        return F.struct(F.lit(cat).alias("cat"), value.alias("value"), F.lit(whole).alias("whole"))

    groups = [group(c, F.col(slot), False) for c, slot in slots.items()]
    if null_label is not None:
        groups.append(group("", F.lit(""), True))
    else:
        groups += [group(c, F.when(F.col(slot).isNotNull(), ""), True) for c, slot in slots.items()]
    rows = long.select("num", "x", F.explode_outer(F.array(*groups)).alias("g")).select("g.cat", "num", "g.value", "g.whole", "x")
    other = F.col("whole") & (F.col("cat") == "") | (F.col("cat") != F.col("num"))
    return rows.filter(other & F.col("value").isNotNull() & S.finite(F.col("x")).isNotNull())


def group_profiles(df: DataFrame, categories: Sequence[str], numbers: Sequence[str],
                   limits: Limits = DEFAULT_LIMITS, null_label: str | None = "nan") -> DataFrame:
    """(cat, num, value, count, mean, min, max, median, overall_median, overall_mean, median_vs_overall, flags).

    Categories of 2 to 80 levels; of each pair the largest groups with at least 5 rows.
    Medians are exact and looked for in the kept groups only.  One pass stores the bins of all groups: sizes, means and
    extremes are their totals, and they say where medians lie.  The overall medians are those of whole groups.
    """
    labels = Q.text_rows(df, categories)
    levels = Q.distinct_up_to(labels, ["column"], "value", limits.group_max_levels + 1)
    fitting = levels.filter(F.col("levels").between(limits.group_min_levels, limits.group_max_levels)).select(
        F.col("column").alias("cat"))
    if null_label is not None:                     # "" stands for no category: whole groups
        fitting = fitting.filter("cat <> ''").unionByName(literal_rows(df.sparkSession, [("",)], "cat string"))
    group = ["cat", "num", "value", "whole"]
    rows = _grouped_rows(df, categories, numbers, null_label).join(F.broadcast(fitting), "cat", "left_semi")
    bins = stored(O.value_bins(rows, group), "group-bins")
    sizes = bins.filter(~F.col("whole")).groupBy("cat", "num", "value").agg(
        F.sum("__n").alias("count"), F.min("__low").alias("min"), F.max("__high").alias("max"), F.sum("__sum").alias("sum")
    ).withColumn("mean", F.col("sum") / F.col("count"))
    pair = Window.partitionBy("cat", "num")        # at most 81 rows each
    judged = (
        sizes.withColumn("pair_rows", F.sum("count").over(pair))
        .withColumn("pair_groups", F.count(F.lit(1)).over(pair))
        .withColumn("overall_mean", F.sum("sum").over(pair) / F.sum("count").over(pair))
        .filter((F.col("pair_rows") >= limits.group_min_rows) & (F.col("pair_groups") >= 2)
                & (F.col("count") >= limits.group_min_size))
        .withColumn("kept_groups", F.count(F.lit(1)).over(pair))
        .withColumn("rank", F.row_number().over(pair.orderBy(F.desc("count"), F.asc("value"))))
        .filter((F.col("kept_groups") >= 2) & (F.col("rank") <= limits.groups_kept))
    )
    # at most 20 groups per pair of columns: the list of kept groups is small
    kept = settled(judged.select("cat", "num", "value", "count", "mean", "min", "max", "overall_mean"))
    pairs = kept.select(F.lit("") if null_label is not None else F.col("cat"), "num").distinct()
    wanted = F.broadcast(kept.select("cat", "num", "value", F.lit(False).alias("whole")).union(
        pairs.select("*", F.lit(""), F.lit(True))))
    found = O.quantile_columns(rows.join(wanted, group, "left_semi"), group, {"median": 0.5},
                               bins=bins.join(wanted, group, "left_semi"))
    # at most 21 rows per pair of columns: stored once, read for the groups and for the whole
    found = settled(found)
    over = ["num"] if null_label is not None else ["cat", "num"]
    overall = found.filter("whole").select(*over, F.col("median").alias("overall_median"))
    medians = found.filter(~F.col("whole")).drop("whole")
    joined = kept.join(F.broadcast(medians), ["cat", "num", "value"]).join(F.broadcast(overall), over)
    ratio = F.try_divide(F.col("median"), F.nullif(F.col("overall_median"), F.lit(0.0)))
    flagged = joined.withColumn("median_vs_overall", ratio)
    far = (F.col("median_vs_overall") >= limits.group_far_high) | (F.col("median_vs_overall") <= limits.group_far_low)
    flags = F.array_compact(F.array(
        F.when(F.col("count") <= limits.small_sample, "small_sample"), F.when(far, "far_from_center")))
    return flagged.select("cat", "num", "value", "count", "mean", "min", "max", "median", "overall_median",
                          "overall_mean", "median_vs_overall", flags.alias("flags"))


def median_ranges(profiles: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(cat, num, high_group, high, low_group, low, ratio): groups of 10 rows count if there are two."""
    pair = Window.partitionBy("cat", "num")
    sized = profiles.withColumn("large", F.col("count") >= limits.group_range_size)
    sized = sized.withColumn("n_large", F.count_if(F.col("large")).over(pair))
    chosen = sized.filter(F.col("large") | (F.col("n_large") < 2))
    # of equal medians the larger group, then the smaller name, is named
    spread = chosen.groupBy("cat", "num").agg(
        F.min_by("value", F.struct(-F.col("median"), -F.col("count"), F.col("value"))).alias("high_group"),
        F.max("median").alias("high"),
        F.min_by("value", F.struct(F.col("median"), -F.col("count"), F.col("value"))).alias("low_group"),
        F.min("median").alias("low"),
        F.first("overall_median").alias("overall_median"), F.first("overall_mean").alias("overall_mean"),
    )
    return spread.withColumn("ratio", F.try_divide(F.col("high"), F.nullif(F.col("low"), F.lit(0.0))))
