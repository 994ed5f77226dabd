"""Which charts are worth drawing, and the tables and caption numbers behind them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import charts as G
from ..operators.structure import Roles, union_all
from ..sources.literals import literal_rows

# Fixed values.  Charts of column pairs: kind, kind of relation, strongest pairs looked at, most charts, whether a chart
# has to bring a column that no earlier one of its kind has, points, most points for strength, points per strength.
PAIR_RULES = (
    ("scatter", "pearson", 12, 3, True, 70.0, 28.0, 35.0),
    ("mean_bar", "eta", 12, 4, False, 75.0, 22.0, 40.0),
    ("box", "eta", 6, 6, False, 63.0, 20.0, 30.0),
    ("crosstab", "cramers_v", 3, 3, False, 60.0, 18.0, 30.0),
)
# Charts of one column: kind, part of the column, most charts, points, points per importance.
COLUMN_RULES = (("count", "group", 4, 55.0, 0.5), ("histogram", "numeric", 2, 48.0, 0.4))
HEATMAP_POINTS, SERIES_POINTS, SERIES_PER_IMPORTANCE, MISSING_POINTS = 98.0, 72.0, 0.2, 45.0
# Charts of what the analyses discovered; core bars of places first, other core bars by the second number.
CORE_POINTS, CORE_LEAST = (96.0, 88.0), 3
OUTLIER_POINTS, PLACE_MEDIAN_POINTS, PLACE_RATIO_POINTS, AREA_MONEY_POINTS = 94.0, 93.0, 92.0, 90.0
#: Of equal points the earlier kind comes first.
KINDS = ("core", "outlier_box", "place_median", "place_ratio", "area_money", "heatmap", "scatter", "mean_bar", "box", "series", "count", "histogram", "missing", "crosstab")
CHART_BUDGET = 20


def _candidates(df: DataFrame, kind: str, columns: Column, score: Column, place: Column | None = None) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), columns.alias("columns"), score.cast("double").alias("score"),
                     (F.lit(1) if place is None else place).cast("bigint").alias("place"))


def _pair_charts(associations: DataFrame) -> DataFrame:
    """Each rule keeps the first of the pairs it looks at, in the order of their strength."""
    rules = literal_rows(associations.sparkSession, PAIR_RULES,
                         "kind string, type string, looked_at bigint, most bigint, fresh boolean, base double, cap double, per double")
    place = F.row_number().over(Window.partitionBy("type").orderBy("rank"))
    pairs = associations.select("type", F.array("col_a", "col_b").alias("columns"), F.abs("stat").alias("strength"), place.alias("place"))
    looked = pairs.join(F.broadcast(rules), "type").where("place <= looked_at")
    # at most ``looked_at`` pairs per rule
    listed = looked.groupBy("kind", "most", "fresh", "base", "cap", "per").agg(
        F.array_sort(F.collect_list(F.struct("place", "columns", "strength"))).alias("pairs"))

    def kept(held: Column, pair: Column) -> Column:
        known = F.size(F.array_except(pair["columns"], held["used"])) == 0
        full = F.size(held["taken"]) >= F.col("most")
        more = F.struct(F.array_union(held["used"], pair["columns"]).alias("used"), F.array_append(held["taken"], pair).alias("taken"))
        return F.when(full | (F.col("fresh") & known), held).otherwise(more)

    nothing = F.struct(F.array().cast("array<string>").alias("used"), F.slice("pairs", 1, 0).alias("taken"))
    taken = listed.select("kind", "base", "cap", "per", F.explode(F.aggregate("pairs", nothing, kept, lambda held: held["taken"])).alias("p"))
    return taken.select("kind", "p.columns", (F.col("base") + F.least("cap", F.col("p.strength") * F.col("per"))).alias("score"), "p.place")


def chart_plan(importance: DataFrame, associations: DataFrame, missing: DataFrame, discovered: DataFrame | None = None,
               budget: int = CHART_BUDGET) -> DataFrame:
    """(rank, kind, columns array<string>, score): the charts with most points, best first.

    ``importance`` are rows of ``column_importance``, ``associations`` of ``associations`` (which hands on pairs of
    moderate strength at least), ``missing`` of ``missing_counts`` and ``discovered`` of ``discovered_charts``: one row
    per column or notable pair, so all choosing is done over metadata.  Columns without importance are not charted.
    """
    part = F.when(F.col("kind").isin("categorical", "boolean"), "group").otherwise(F.col("kind"))
    weighed = importance.where("importance > 0").select(part.alias("part"), "column", "importance").withColumn(
        "place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("importance"), "column")))
    rules = literal_rows(importance.sparkSession, COLUMN_RULES, "kind string, part string, most bigint, base double, per double")
    single = weighed.join(F.broadcast(rules), "part").where("place <= most").select(
        "kind", F.array("column").alias("columns"), (F.col("base") + F.col("per") * F.col("importance")).alias("score"), F.col("place").cast("bigint").alias("place"))
    numbers = weighed.where("part = 'numeric'").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "column"))), lambda x: x["column"]).alias("all"))
    first = weighed.where("place = 1").agg(*[F.max(F.when(F.col("part") == p, F.col(c))).alias(n) for n, p, c in (
        ("day", "datetime", "column"), ("number", "numeric", "column"), ("weight", "numeric", "importance"))])
    offers = [
        _candidates(numbers.where(F.size("all") >= G.HEATMAP_LEAST), "heatmap", F.col("all"), F.lit(HEATMAP_POINTS)),
        _pair_charts(associations).withColumn("place", F.col("place").cast("bigint")),
        _candidates(first.where("day IS NOT NULL AND number IS NOT NULL"), "series", F.array("day", "number"),
                    F.lit(SERIES_POINTS) + SERIES_PER_IMPORTANCE * F.col("weight")),
        single,
        _candidates(missing.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "missing", F.array().cast("array<string>"), F.lit(MISSING_POINTS)),
        *([discovered] if discovered is not None else []),
    ]
    turn = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = Window.orderBy(F.desc(F.round("score", 9)), turn, "place")        # a few rows per column or pair
    return union_all(offers).withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= budget).select("rank", "kind", "columns", "score")


def discovered_charts(concentration: DataFrame | None, outliers: DataFrame | None, roles: Roles, ratios: Sequence[str], spark) -> DataFrame:
    """(kind, columns, score, place) of the charts that findings call for.

    ``concentration`` are rows of ``concentration_summary``, ``outliers`` of ``numeric_outliers``; places, money, areas
    and ``ratios`` are charted by the first column of each.
    """
    offers = []
    if concentration is not None:
        points = F.when(F.col("role") == "geo", CORE_POINTS[0]).otherwise(CORE_POINTS[1])
        offers.append(_candidates(concentration.where(F.col("n_categories") >= CORE_LEAST), "core", F.array("column"), points,
                                  F.row_number().over(Window.orderBy("column"))))
    if outliers is not None:
        offers.append(_candidates(outliers, "outlier_box", F.array("column"), F.lit(OUTLIER_POINTS), F.row_number().over(Window.orderBy("column"))))
    geo, money, area, ratio = (tuple(x)[:1] for x in (roles.geo, roles.money, roles.area, ratios))
    known = (("place_median", geo + money, PLACE_MEDIAN_POINTS), ("place_ratio", geo + ratio, PLACE_RATIO_POINTS), ("area_money", area + money, AREA_MONEY_POINTS))
    rows = [(kind, *columns, score) for kind, columns, score in known if len(columns) == 2]
    named = literal_rows(spark, rows, "kind string, a string, b string, score double")
    offers.append(named.select("kind", F.array("a", "b").alias("columns"), "score", F.lit(1).cast("bigint").alias("place")))
    return union_all(offers)


def _median_bars(df: DataFrame, a: str, b: str) -> DataFrame:
    return G.median_by_group(df, a, b)


#: How the table of a chart with one or two columns is made of the rows.
TABLES: Mapping[str, Callable[..., DataFrame]] = {
    "scatter": lambda df, a, b: G.scatter_trend(df, [(a, b)]), "mean_bar": G.mean_by_category, "box": G.box_stats, "series": G.time_series,
    "crosstab": lambda df, a, b: G.crosstab(df, a, b).select(F.col("a").cast("string"), F.col("b").cast("string"), "n"),
    "count": lambda df, a: G.category_counts(df, [a]).drop("column"), "histogram": lambda df, a: G.histogram(df, [a]).drop("column"),
    "outlier_box": lambda df, a: G.box_stats(df, None, a), "place_median": _median_bars, "place_ratio": _median_bars, "area_money": G.scatter_points,
}
#: The numbers that a chart's caption states.
CAPTIONS: Mapping[str, Callable[..., DataFrame]] = {
    "mean_bar": G.caption_extremes, "box": G.caption_medians, "place_median": G.caption_medians, "place_ratio": G.caption_medians,
    "series": G.split_trend, "count": lambda df, a: G.caption_counts(df, [a]).drop("column"),
    "histogram": lambda df, a: G.caption_shape(df, [a]).drop("column"),
}


def chart_tables(df: DataFrame, plan: DataFrame, core: DataFrame | None = None) -> dict[str, DataFrame]:
    """The aggregate behind each kind of chart in the plan, one table per kind, with the ``columns`` of the chart.

    ``core`` are rows of ``concentration_values``, if core bars may be in the plan.  ``captions`` has for every chart
    whose caption states numbers its rank, kind, columns and the numbers as JSON.  The plan's rows, at most its budget,
    come to the driver: they say which queries to write.
    """
    charts: dict[str, list[tuple[int, list[str]]]] = {}
    for r in plan.orderBy("rank").collect():
        charts.setdefault(r["kind"], []).append((r["rank"], r["columns"]))

    def named(part: DataFrame, columns: Sequence[str]) -> DataFrame:
        return part.select(F.array(*map(F.lit, columns)).cast("array<string>").alias("columns"), "*")

    out = {f"chart_{kind}": union_all([named(build(df, *c), c) for _, c in charts[kind]]) for kind, build in TABLES.items() if kind in charts}
    if "heatmap" in charts:
        out["chart_heatmap"] = G.heatmap(df, charts["heatmap"][0][1])
    if "missing" in charts:
        out["chart_missing"] = G.missing_counts(df)
    if "core" in charts and core is not None:
        wanted = [c for _, (c,) in charts["core"]]
        out["chart_core"] = G.core_bars(core.where(F.col("column").isin(*wanted))).withColumn("columns", F.array("column"))

    def caption(kind: str, rank: int, columns: Sequence[str], numbers: DataFrame) -> DataFrame:
        return numbers.select(F.lit(rank).cast("bigint").alias("rank"), F.lit(kind).alias("kind"), F.array(*map(F.lit, columns)).cast("array<string>").alias("columns"),
                              F.to_json(F.struct("*")).alias("numbers"))

    captions = [caption(kind, rank, c, build(df, *c)) for kind, build in CAPTIONS.items() for rank, c in charts.get(kind, [])]
    if "missing" in charts:
        captions.append(caption("missing", charts["missing"][0][0], [], G.caption_missing(df)))
    if captions:
        out["captions"] = union_all(captions)
    return out
