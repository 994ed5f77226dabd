"""Spearman's rho and the Kruskal-Wallis H on exact average ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT_LIMITS, Limits
from ..functions import scalar as S
from ..sources.literals import literal_rows
from ..sources.sinks import stored
from . import frequency as Q, order_stats as O
from .structure import Roles, union_all


def ranks(df: DataFrame, column: str) -> DataFrame:
    """(x, n, avg_rank) for every distinct value of a column."""
    return O.average_ranks(stored(Q.number_counts(df, [column]), "ranks"), ["column"]).select("x", "n", "avg_rank")


def _side(pairs: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """(keys..., value, pairs, rank) for the distinct values on one side of the pair counts."""
    counts = stored(pairs.groupBy(*keys, value).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs")), "ranks")
    ranked = O.average_ranks(counts, keys, x=value)
    return stored(ranked.select(*keys, value, "pairs", F.col("avg_rank").alias(rank)), "ranks")


def spearman(df: DataFrame, a: str, b: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One row (col_a, col_b, stat, n): Pearson of the average ranks over rows where both are present.

    The table is read once: counts of value pairs are stored, and all ranking works on these.
    """
    types = Q.dtypes(df)
    pairs = stored(
        df.select(S.number(a, types[a]).alias("a"), S.number(b, types[b]).alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL")
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs"
    )
    with_b = O.attach_unique(pairs, _side(pairs, [], "b", "rb"), ["b"], "pairs", ["rb"])
    # one row per value of a from here on: rank sums are linear in the rank of b
    by_a = with_b.groupBy("a").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rb")).alias("b1"),
        F.sum(F.col("n") * F.col("rb") * F.col("rb")).alias("b2"), F.count(F.lit(1)).alias("pairs"),
    )
    ra = _side(pairs, [], "a", "ra").select("a", "ra")
    joined = by_a.join(ra, "a")
    sums = joined.agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("ra") * F.col("b1")).alias("ab"),
        F.sum(F.col("n") * F.col("ra") * F.col("ra")).alias("a2"),
        F.sum("b2").alias("b2"),
    )
    # average ranks of n rows always have the mean (n + 1) / 2
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2, 2)
    rho = F.try_divide(F.col("ab") - centre, F.sqrt(F.col("a2") - centre) * F.sqrt(F.col("b2") - centre))
    return sums.select(
        F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
        F.when(F.col("n") >= limits.spearman_min_rows, S.finite(rho)).alias("stat"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )


def kruskal(df: DataFrame, categories: Sequence[str], numbers: Sequence[str],
            limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(col_a, col_b, stat, n): H of every category and number over rows with both, no tie correction.

    All combinations go through one chain of shuffles, keyed by the pair of columns.
    """
    types = Q.dtypes(df)
    pair = ["col_a", "col_b"]
    wide = df.select(*[S.present(c, types[c]).cast("string").alias(f"g{i}") for i, c in enumerate(categories)],
                     *[S.number(c, types[c]).alias(f"x{i}") for i, c in enumerate(numbers)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("col_a"), F.lit(x).alias("col_b"), F.col(f"g{i}").alias("g"), F.col(f"x{j}").alias("x"))
        for i, c in enumerate(categories) for j, x in enumerate(numbers) if c != x
    ])
    counts = stored(
        wide.select(F.explode_outer(cells).alias("c")).select("c.*")
        .filter("g IS NOT NULL AND x IS NOT NULL")
        .groupBy(*pair, "g", "x").agg(F.count(F.lit(1)).alias("n")), "pairs"
    )
    ranked = O.attach_unique(counts, _side(counts, pair, "x", "r"), [*pair, "x"], "pairs", ["r"])
    groups = ranked.groupBy(*pair, "g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r")).alias("r"))
    total = groups.groupBy(*pair).agg(
        F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.pow("r", F.lit(2.0)) / F.col("n")).alias("s"),
    )
    n = F.col("n")
    h = F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("s") - 3 * (n + 1)
    usable = (n >= limits.kruskal_min_rows) & (F.col("groups") >= 2)
    return total.select(*pair, F.when(usable, h).alias("stat"), n.cast("bigint").alias("n"))


def rank_tests(df: DataFrame, roles: Roles, notable: DataFrame | None = None,
               limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(type, col_a, col_b, stat, eta, n): Spearman of area and money, Kruskal-Wallis of groups.

    ``notable`` are association rows; the eta of a notable pair is attached.
    """
    money = roles.money or roles.numeric
    groups = (roles.geo or roles.categorical)[: limits.kruskal_categories]
    parts = []
    for a in roles.area:
        for m in money:
            if a != m:
                parts.append(spearman(df, a, m, limits).filter("stat IS NOT NULL")
                             .withColumn("type", F.lit("spearman")))
    numbers = money[: limits.kruskal_numbers]
    if any(c != m for c in groups for m in numbers):
        parts.append(kruskal(df, groups, numbers, limits).withColumn("type", F.lit("kruskal")))
    schema = "type string, col_a string, col_b string, stat double, eta double, n bigint"
    if not parts:
        return literal_rows(df.sparkSession, [], schema)
    tests = union_all(parts)
    if notable is None:
        return tests.select("type", "col_a", "col_b", "stat", F.lit(None).cast("double").alias("eta"), "n")
    eta = notable.filter(F.col("type") == "eta").select("col_a", "col_b", F.col("stat").alias("eta"))
    # at most top_eta rows
    joined = tests.join(F.broadcast(eta), ["col_a", "col_b"], "left")
    eta_known = F.when(F.col("type") == "kruskal", F.col("eta"))
    return (
        joined.select("type", "col_a", "col_b", "stat", eta_known.alias("eta"), "n")
        .filter("stat IS NOT NULL OR eta IS NOT NULL")
    )
