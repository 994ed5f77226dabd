"""Pearson, Cramer's V, correlation ratio."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT_LIMITS, Limits
from ..functions import scalar as S
from ..sources.literals import literal_rows
from . import frequency as Q
from .structure import Facts, union_all

PAIRS_PER_PASS = 120


def numeric_candidates(facts: Facts) -> list[str]:
    return [c for c, f in facts.items() if f.kind == "numeric"]


def category_candidates(facts: Facts, limits: Limits = DEFAULT_LIMITS) -> list[str]:
    """The categorical columns with fewest levels."""
    fitting = [c for c, f in facts.items()
               if f.kind in ("categorical", "boolean") and f.nunique <= limits.max_category_levels]
    return sorted(fitting, key=lambda c: facts[c].nunique)[: limits.max_category_columns]


def pearson(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS,
            pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(col_a, col_b, stat, n) for every pair, over the rows where both are present.

    All pairs of a chunk are aggregated in one pass; each task sends one row.
    """
    types = Q.dtypes(df)
    pairs = list(pairs) if pairs is not None else list(combinations(columns, 2))

    def chunk(part: Sequence[tuple[str, str]]) -> DataFrame:
        used = list(dict.fromkeys(c for pair in part for c in pair))
        numbers = df.select(*[S.number(c, types[c]).alias(f"x{used.index(c)}") for c in used])
        sums = []
        for i, (a, b) in enumerate(part):
            xa, xb = F.col(f"x{used.index(a)}"), F.col(f"x{used.index(b)}")
            sums += [F.regr_count(xb, xa).alias(f"n{i}"), F.regr_sxy(xb, xa).alias(f"xy{i}"),
                     F.regr_sxx(xb, xa).alias(f"xx{i}"), F.regr_syy(xb, xa).alias(f"yy{i}")]
        entries = [
            F.struct(
                F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                F.when(
                    F.col(f"n{i}") >= limits.pearson_min_pairs,
                    S.finite(F.try_divide(F.col(f"xy{i}"), F.sqrt(f"xx{i}") * F.sqrt(f"yy{i}"))),
                ).alias("stat"),
                F.col(f"n{i}").alias("n"),
            )
            for i, (a, b) in enumerate(part)
        ]
        return numbers.agg(*sums).select(F.explode_outer(F.array(*entries)).alias("e")).select("e.*")

    if not pairs:
        raise ValueError("Pearson needs at least two numeric columns")
    return union_all([chunk(pairs[i: i + PAIRS_PER_PASS]) for i in range(0, len(pairs), PAIRS_PER_PASS)])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, stat) for all ordered pairs, the diagonal included."""
    half = pearson(df, columns, Limits(pearson_min_pairs=1)).select("col_a", "col_b", "stat")
    mirrored = half.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "stat")
    types = Q.dtypes(df)
    spread = df.select(*[S.number(c, types[c]).alias(f"x{i}") for i, c in enumerate(columns)]).agg(
        *[(F.min(f"x{i}") < F.max(f"x{i}")).alias(f"v{i}") for i in range(len(columns))]
    )
    own = [F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.when(F.col(f"v{i}"), 1.0).alias("stat"))
           for i, c in enumerate(columns)]
    diagonal = spread.select(F.explode_outer(F.array(*own)).alias("e")).select("e.*")
    return union_all([half, mirrored, diagonal])


def chi_square(cells: DataFrame) -> DataFrame:
    """(col_a, col_b, n, levels_a, levels_b, chi2) from joint counts.

    Only occupied cells are visited: N * (sum of n^2 / (row * column) - 1).
    """
    pair = ["col_a", "col_b"]
    with_margins = (
        cells.withColumn("row", F.sum("n").over(Window.partitionBy(*pair, "a")))
        .withColumn("column", F.sum("n").over(Window.partitionBy(*pair, "b")))
    )
    share = F.col("n").cast("double") * F.col("n") / (F.col("row").cast("double") * F.col("column"))
    return with_margins.groupBy(*pair).agg(
        F.sum("n").alias("n"),
        F.count_distinct("a").alias("levels_a"), F.count_distinct("b").alias("levels_b"),
        F.sum(share).alias("__s"),
    ).select(*pair, "n", "levels_a", "levels_b",
             F.greatest(F.col("n") * (F.col("__s") - 1), F.lit(0.0)).alias("chi2"))


def cramers_v(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS,
              pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(col_a, col_b, stat, n) for pairs of categories, rows with a missing side left out."""
    pairs = list(pairs) if pairs is not None else list(combinations(columns, 2))
    chi = chi_square(Q.contingency(df, pairs))
    smaller = F.least("levels_a", "levels_b") - 1
    usable = (F.col("n") >= limits.association_min_rows) & (smaller > 0)
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * smaller))
    return chi.filter(usable).select("col_a", "col_b", v.alias("stat"), "n")


def correlation_ratio(df: DataFrame, categories: Sequence[str], numbers: Sequence[str],
                      limits: Limits = DEFAULT_LIMITS, null_label: str | None = "nan") -> DataFrame:
    """(col_a category, col_b number, stat, n): eta of every combination from one grouped pass.

    Missing categories form a group of their own unless ``null_label`` is None.
    """
    types = Q.dtypes(df)

    def text(c: str) -> Column:
        value = S.present(c, types[c]).cast("string")
        return F.coalesce(value, F.lit(null_label)) if null_label is not None else value

    keep = [S.number(c, types[c]).alias(f"x{i}") for i, c in enumerate(numbers)]
    rows = Q.unpivot(df, {c: text(c) for c in categories}, "col_a", "group", keep).filter("group IS NOT NULL")
    groups = rows.groupBy("col_a", "group").agg(*[
        F.struct(F.count(f"x{i}").alias("n"), F.avg(f"x{i}").alias("mean"), F.var_pop(f"x{i}").alias("var"))
        .alias(f"g{i}") for i in range(len(numbers))
    ])
    entries = [F.struct(F.lit(c).alias("col_b"), F.col(f"g{i}").alias("g")) for i, c in enumerate(numbers)]
    long = groups.select("col_a", F.explode_outer(F.array(*entries)).alias("e")).select("col_a", "e.col_b", "e.g.*")
    long = long.filter("n > 0")
    # one row per pair of columns; the groups themselves meet as sums, combined in each task
    middles = long.groupBy("col_a", "col_b").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("middle"))
    parts = long.join(F.broadcast(middles), ["col_a", "col_b"]).withColumn("gap", F.pow(F.col("mean") - F.col("middle"), 2))
    totals = parts.groupBy("col_a", "col_b").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") * F.col("gap")).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    total = F.col("between") + F.col("within")
    usable = (F.col("n") >= limits.association_min_rows) & (F.col("groups") >= 2) & (total > 0)
    return totals.filter(usable).select(
        "col_a", "col_b", S.finite(F.sqrt(F.col("between") / total)).alias("stat"), "n"
    )


def graded(pairs: DataFrame, kind: str, strong: float, moderate: float, top: int,
           limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The strongest of the strong and moderate pairs, with labels and rank."""
    known = pairs.filter(F.col("stat").isNotNull()).select(
        F.lit(kind).alias("type"), "col_a", "col_b", "stat", "n",
        S.strength_of(F.round("stat", 12), strong, moderate, limits.weak).alias("strength"),
        (F.when(F.col("stat") > 0, "positive").otherwise("negative") if kind == "pearson"
         else F.lit(None).cast("string")).alias("direction"),
    )
    notable = known.filter(F.col("strength").isin("strong", "moderate"))
    order = [F.desc(F.abs(F.round("stat", 4))), F.asc("col_a"), F.asc("col_b")]
    return Q.top_per_group(notable, ["type"], order, top)


def associations(df: DataFrame, facts: Facts, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """All notable pairs of a table: type, col_a, col_b, stat, n, strength, direction, rank."""
    numbers, categories = numeric_candidates(facts), category_candidates(facts, limits)
    parts = []
    if len(numbers) >= 2:
        parts.append(graded(pearson(df, numbers, limits), "pearson", limits.pearson_strong,
                            limits.pearson_moderate, limits.top_pearson, limits))
    if len(categories) >= 2:
        parts.append(graded(cramers_v(df, categories, limits), "cramers_v", limits.effect_strong,
                            limits.effect_moderate, limits.top_cramers, limits))
    if numbers and categories:
        parts.append(graded(correlation_ratio(df, categories, numbers, limits), "eta", limits.effect_strong,
                            limits.effect_moderate, limits.top_eta, limits))
    if not parts:
        return literal_rows(
            df.sparkSession, [], "type string, col_a string, col_b string, stat double, n bigint, strength string, "
                "direction string, rank bigint")
    return union_all(parts)
