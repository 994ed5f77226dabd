"""The aggregates behind each chart, and the numbers its caption states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT_LIMITS, Limits
from ..functions import names as N, scalar as S
from ..sources.sinks import stored
from . import associations as A, frequency as Q, order_stats as O
from .structure import union_all

# Fixed values of the chart rules.
TREND_MIN, TREND_PAIRS = 0.35, 3
BAR_TOP, BAR_MIN_ETA, BAR_CHARTS = 10, 0.15, 4
BOX_TOP, BOX_MIN_ETA, WHISKER = 8, 0.2, 1.5
COUNT_TOP, COUNT_LEVELS = 12, (2, 25)
HIST_BINS, HIST_MIN_ROWS, HIST_MIN_LEVELS = (8, 25), 5, 3
MISSING_TOP, MISSING_FLOOR, MISSING_SHARE = 15, 3, 0.03
CROSS_TOP, CROSS_MIN_V, CROSS_CHARTS = 6, 0.2, 3
CORE_TOP, GEO_TOP = 20, 16
WEEKLY_ABOVE, SERIES_MIN_ROWS = 60, 4
HEATMAP_LEAST = 3
TREND_BAND, SHAPE_BAND = 0.05, 0.15


def heatmap(df: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """G1: correlation matrix of all columns, or of the first ``most``."""
    chosen = list(columns)[:most]
    if len(chosen) < HEATMAP_LEAST:
        raise ValueError("a heat map needs three numeric columns")
    return A.correlation_matrix(df, chosen)


def _pair(df: DataFrame, a: str, b: str) -> DataFrame:
    types = Q.dtypes(df)
    return df.select(S.number(a, types[a]).alias("x"), S.number(b, types[b]).alias("y")).filter(
        "x IS NOT NULL AND y IS NOT NULL")


def scatter_points(df: DataFrame, a: str, b: str) -> DataFrame:
    """All complete (x, y) points."""
    return _pair(df, a, b)


def scatter_trend(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_x, col_y, n, slope, intercept, r) of the linear trend per pair, in one pass."""
    types = Q.dtypes(df)
    sums, entries = [], []
    for i, (a, b) in enumerate(pairs):
        x, y = S.number(a, types[a]), S.number(b, types[b])
        sums += [F.regr_count(y, x).alias(f"n{i}"), F.regr_sxy(y, x).alias(f"xy{i}"), F.regr_sxx(y, x).alias(f"xx{i}"),
                 F.regr_syy(y, x).alias(f"yy{i}"), F.regr_avgx(y, x).alias(f"mx{i}"), F.regr_avgy(y, x).alias(f"my{i}")]
        slope = F.try_divide(F.col(f"xy{i}"), F.col(f"xx{i}"))
        entries.append(F.struct(
            F.lit(a).alias("col_x"), F.lit(b).alias("col_y"), F.col(f"n{i}").alias("n"), slope.alias("slope"),
            (F.col(f"my{i}") - slope * F.col(f"mx{i}")).alias("intercept"),
            F.try_divide(F.col(f"xy{i}"), F.sqrt(f"xx{i}") * F.sqrt(f"yy{i}")).alias("r"),
        ))
    return df.agg(*sums).select(F.explode_outer(F.array(*entries)).alias("e")).select("e.*")


def _group_rows(df: DataFrame, category: str, number: str) -> DataFrame:
    """(g, x) of rows where both are present."""
    types = Q.dtypes(df)
    return df.select(S.present(category, types[category]).cast("string").alias("g"),
                     S.number(number, types[number]).alias("x")).filter("g IS NOT NULL AND x IS NOT NULL")


def _largest(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` groups with most rows."""
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy(F.desc("n"), F.asc("g")).limit(k)


def mean_by_category(df: DataFrame, category: str, number: str, top: int = BAR_TOP) -> DataFrame:
    """(group, n, mean) of the largest categories; one aggregation gives sizes and means."""
    groups = _group_rows(df, category, number).groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    kept = groups.orderBy(F.desc("n"), F.asc("g")).limit(top)
    return kept.select(F.col("g").alias("group"), "n", "mean")


def median_by_group(df: DataFrame, category: str, number: str, top: int = GEO_TOP) -> DataFrame:
    """(group, n, median) of the groups with the highest medians; group names are stripped."""
    rows = _group_rows(df, category, number).withColumn("g", S.strip(F.col("g")))
    medians = O.exact_quantiles(rows, ["g"], [0.5], bounded_keys=O.few_groups(rows, ["g"]))
    return medians.orderBy(F.desc("quantile"), F.asc("g")).limit(top).select(
        F.col("g").alias("group"), "n", F.col("quantile").alias("median"))


def box_stats(df: DataFrame, category: str | None, number: str, top: int = BOX_TOP) -> DataFrame:
    """(group, n, q1, median, q3, low, high, fliers); whiskers end at the last value within 1.5 IQR."""
    if category is None:
        types = Q.dtypes(df)
        rows = df.select(F.lit(number).alias("g"), S.number(number, types[number]).alias("x")).filter("x IS NOT NULL")
    else:
        rows = _group_rows(df, category, number)
        # at most ``top`` rows
        rows = rows.join(F.broadcast(_largest(rows, top).select("g")), "g", "left_semi")
    cuts = O.quantile_columns(rows, ["g"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    joined = rows.join(F.broadcast(cuts), "g")
    return joined.groupBy("g").agg(
        F.count("x").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"),
        F.count_if(~inside).alias("fliers"),
    ).withColumnRenamed("g", "group")


def _dated(df: DataFrame, date: str, number: str) -> DataFrame:
    types = Q.dtypes(df)
    return df.select(S.moment(date, types[date]).alias("t"), S.number(number, types[number]).alias("x")).filter(
        "t IS NOT NULL AND x IS NOT NULL")


def time_series(df: DataFrame, date: str, number: str) -> DataFrame:
    """(period, n, mean): weeks ending on Sunday if there are over 60 distinct times, else months.

    Periods without rows are listed with a null mean.
    """
    rows = _dated(df, date, number).withColumn("key", F.lit(0))
    levels = Q.distinct_up_to(rows.select("key", "t"), ["key"], "t", WEEKLY_ABOVE + 1)
    weekly = levels.agg(F.max(F.col("levels") > WEEKLY_ABOVE)).scalar()
    # calendar days first: the rest of the plan sees one row per day
    days = rows.groupBy(F.to_date("t").alias("day")).agg(F.count("x").alias("n"), F.sum("x").alias("s"))
    week_end = F.next_day(F.date_sub("day", 1), "SU")
    period = F.when(F.col("weekly"), week_end).otherwise(F.last_day("day"))
    totals = days.withColumn("weekly", weekly).groupBy(period.alias("period")).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    span = totals.agg(F.min("period").alias("start"), F.max("period").alias("end"), F.sum("n").alias("rows")).filter(
        F.col("rows") >= SERIES_MIN_ROWS).withColumn("weekly", weekly)
    steps = F.when(F.col("weekly"), F.sequence("start", "end", F.expr("interval 7 days"))).otherwise(
        F.transform(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month")), F.last_day))
    calendar = span.select(F.explode(steps).alias("period"))
    return calendar.join(totals, "period", "left").select(
        "period", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.try_divide("s", "n").alias("mean"))


def split_trend(df: DataFrame, date: str, number: str) -> DataFrame:
    """One row (n, first_mean, second_mean, trend): means of the earlier and the later half of the rows.

    Rows are ordered by date, then value.  The date in the middle is found from counts
    per date; how its own rows divide is found by an exact rank within that date, so
    neither the rows of a date nor those of the table are brought together.
    """
    rows = _dated(df, date, number)
    # counted from a moment without zone, so that no clock change moves or merges dates
    dates = rows.withColumn("x2", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("t").cast("timestamp_ntz")).cast("double"))
    # positions of the dates themselves, by the exact distributed ranking
    counts = stored(dates.groupBy("x2").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s")), "dates")
    ranked = O.average_ranks(counts, [], x="x2").withColumn(
        "before", (F.col("avg_rank") - (F.col("n") + 1) / 2).cast("bigint"))
    ranked = stored(ranked, "dates")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    placed = ranked.withColumn("half", F.floor(total / 2).cast("bigint"))
    sides = placed.agg(
        F.sum(F.when(F.col("before") + F.col("n") <= F.col("half"), F.col("s"))).alias("s1"),
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("half").alias("half"),
    )
    middle = placed.filter((F.col("before") < F.col("half")) & (F.col("before") + F.col("n") > F.col("half"))).select(
        "x2", (F.col("half") - F.col("before")).alias("take"))
    inside = dates.join(F.broadcast(middle), "x2")          # a single date
    cut = O.average_ranks(stored(inside.groupBy("x", "take").agg(F.count(F.lit(1)).alias("n")), "dates"), [])
    start = F.col("avg_rank") - (F.col("n") + 1) / 2
    taken = F.greatest(F.least(F.col("n"), F.col("take") - start), F.lit(0))
    part = cut.agg(F.coalesce(F.sum(F.col("x") * taken), F.lit(0.0))).scalar()
    means = sides.withColumn("first_sum", F.coalesce("s1", F.lit(0.0)) + part).select(
        "n", F.try_divide("first_sum", "half").alias("first_mean"),
        F.try_divide(F.col("s") - F.col("first_sum"), F.col("n") - F.col("half")).alias("second_mean"))
    first, second = F.col("first_mean"), F.col("second_mean")
    trend = (F.when(second > first * (1 + TREND_BAND), "up").when(second < first * (1 - TREND_BAND), "down")
             .otherwise("flat"))
    return means.filter(F.col("n") >= SERIES_MIN_ROWS).withColumn("trend", trend)


def category_counts(df: DataFrame, columns: Sequence[str], top: int = COUNT_TOP,
                    null_label: str | None = "nan") -> DataFrame:
    """(column, rank, value, n) of the most frequent values of columns with 2 to 25 levels."""
    texts = Q.text_rows(df, columns)
    levels = Q.distinct_up_to(texts, ["column"], "value", COUNT_LEVELS[1] + 1)
    fitting = levels.filter(F.col("levels").between(*COUNT_LEVELS))
    rows = Q.text_rows(df, columns, null_label=null_label).join(F.broadcast(fitting), "column", "left_semi")
    counts = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return Q.top_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], top).select(
        "column", "rank", "value", "n")


def histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, bin, low, high, n): equal bins, a third as many as levels but 8 to 25; empty bins included.

    Infinite values have no place between finite bounds and take no part."""
    rows = Q.number_rows(df, columns).filter(S.finite(F.col("x")).isNotNull())
    levels = Q.distinct_up_to(rows, ["column"], "x", 3 * HIST_BINS[1] + 1)
    span = rows.groupBy("column").agg(F.count("x").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    bins = F.least(F.lit(HIST_BINS[1]), F.greatest(F.lit(HIST_BINS[0]), F.floor(F.col("levels") / 3))).cast("int")
    layout = (
        span.join(F.broadcast(levels), "column")
        .filter((F.col("rows") >= HIST_MIN_ROWS) & (F.col("levels") >= HIST_MIN_LEVELS))
        .select("column", "lo", "hi", bins.alias("bins"))
    )
    # one row per column
    placed = rows.join(F.broadcast(layout), "column")
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
    counts = placed.groupBy("column", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = layout.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return frame.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def missing_counts(df: DataFrame, top: int = MISSING_TOP) -> DataFrame:
    """(column, missing) of the emptiest columns, if any of them is worth a chart."""
    gaps = Q.column_fill(df).withColumn("missing", F.col("rows") - F.col("non_null"))
    worst = Window.partitionBy("rows")             # one row per column of the table
    shown = gaps.withColumn("most", F.max("missing").over(worst)).filter(
        (F.col("missing") > 0) & (F.col("most") >= F.greatest(F.lit(MISSING_FLOOR), MISSING_SHARE * F.col("rows"))))
    return shown.orderBy(F.desc("missing"), F.asc("ordinal")).limit(top).select("column", "missing")


def crosstab(df: DataFrame, a: str, b: str, top: int = CROSS_TOP) -> DataFrame:
    """(a, b, n) over the most frequent values of both columns; rows are read once."""
    cells = Q.contingency(df, [(a, b)]).select("a", "b", "n")

    def most(side: str) -> DataFrame:
        sizes = cells.groupBy(side).agg(F.sum("n").alias("size"))
        return sizes.orderBy(F.desc("size"), F.asc(side)).limit(top).select(side)

    return cells.join(F.broadcast(most("a")), "a", "left_semi").join(F.broadcast(most("b")), "b", "left_semi").select(
        "a", "b", "n")


def core_bars(values: DataFrame, top: int = CORE_TOP) -> DataFrame:
    """(column, value, count, in_core) of the most frequent values, from concentration rows."""
    return values.filter(F.col("rank") <= top).select("column", "value", "count", "in_core")


def column_importance(described: DataFrame, spread: DataFrame) -> DataFrame:
    """(table_id, column, kind, importance) from structure rows and (column, mean, std) rows."""
    lowered = F.lower("column")

    def mentions(words: Sequence[str]) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(lowered, F.lit(word))
        return test

    kind, levels = F.col("kind"), F.col("nunique")
    filled = F.greatest(F.col("non_null"), F.lit(1))
    grouped = kind.isin("categorical", "boolean")
    useless = (
        mentions(N.UNCHARTED_WORDS) | (kind == "identifier") | (levels <= 1) | (grouped & (levels > 25))
        | ((kind == "numeric") & (F.col("mean").isNull() | (levels >= 0.95 * filled)))
    )
    size = F.abs(F.col("mean"))
    variation = F.when(size > 1e-9, F.least(F.lit(25.0), F.col("std") / size * 15.0)).when(F.col("std") > 0, 10.0)
    points = (
        F.lit(10.0) + F.when(mentions(N.BUSINESS_WORDS), 35.0).otherwise(0.0)
        + F.when(grouped & levels.between(2, 12), 20.0).when(grouped & (levels <= 20), 10.0).otherwise(0.0)
        + F.when(kind == "numeric", F.coalesce(variation, F.lit(0.0))).otherwise(0.0)
        + F.when(kind == "datetime", 15.0).otherwise(0.0)
    )
    known = described.filter(kind.isNotNull()).join(F.broadcast(spread.select("column", "mean", "std")), "column", "left")
    return known.select("table_id", "column", "kind", F.when(useless, 0.0).otherwise(points).alias("importance"))


def caption_extremes(df: DataFrame, category: str, number: str) -> DataFrame:
    """One row (best, best_mean, worst_mean, worst): best and worst mean of the ten largest groups, and the
    group of the lowest mean of all."""
    groups = _group_rows(df, category, number).groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    worst = groups.agg(F.min_by("g", F.struct(F.col("mean"), F.col("g")))).scalar()
    largest = groups.orderBy(F.desc("n"), F.asc("g")).limit(BAR_TOP)
    return largest.agg(
        F.min_by("g", F.struct(-F.col("mean"), F.col("g"))).alias("best"), F.max("mean").alias("best_mean"),
        F.min("mean").alias("worst_mean"),
    ).withColumn("worst", worst)


def caption_medians(df: DataFrame, category: str, number: str) -> DataFrame:
    """One row (best, worst): the groups of the highest and the lowest median."""
    rows = _group_rows(df, category, number)
    medians = O.exact_quantiles(rows, ["g"], [0.5], bounded_keys=O.few_groups(rows, ["g"]))
    return medians.agg(F.min_by("g", F.struct(-F.col("quantile"), F.col("g"))).alias("best"),
                       F.min_by("g", F.struct(F.col("quantile"), F.col("g"))).alias("worst"))


def caption_counts(df: DataFrame, columns: Sequence[str], null_label: str | None = "nan") -> DataFrame:
    """(column, categories, top, top_n, share_pct) of the dominating value."""
    counts = Q.value_counts(df, columns, null_label=null_label)
    top = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("categories"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("top_n"), F.sum("n").alias("total"))
    return top.select("column", "categories", "top", "top_n", (100.0 * F.col("top_n") / F.col("total")).alias("share_pct"))


def caption_shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, median, std, shape): whether the mean leaves the median by 0.15 deviations."""
    rows = Q.number_rows(df, columns)
    base = rows.groupBy("column").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    cuts = O.quantile_columns(rows, ["column"], {"median": 0.5})
    shape = (F.when(F.abs(F.col("mean") - F.col("median")) < SHAPE_BAND * F.col("std"), "symmetric")
             .when(F.col("mean") > F.col("median"), "right").otherwise("left"))
    # one row per column
    return base.join(F.broadcast(cuts), "column").select("column", "mean", "median", "std", shape.alias("shape"))


def caption_missing(df: DataFrame) -> DataFrame:
    """One row (columns_with_gaps, worst, worst_missing, worst_pct)."""
    gaps = Q.column_fill(df).withColumn("missing", F.col("rows") - F.col("non_null")).filter("missing > 0")
    return gaps.agg(
        F.count(F.lit(1)).alias("columns_with_gaps"),
        F.min_by("column", F.struct(-F.col("missing"), F.col("ordinal"))).alias("worst"),
        F.max("missing").alias("worst_missing"), F.max(F.col("missing") * 100.0 / F.col("rows")).alias("worst_pct"))
