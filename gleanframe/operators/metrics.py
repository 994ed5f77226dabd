"""Per-column metrics, as long rows (column, metric, value_double, value_string, value_array)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S
from ..sources.literals import literal_rows
from ..sources.sinks import stored
from . import frequency as Q, order_stats as O
from .structure import Facts, union_all

NUMERIC = ("count", "mean", "median", "mode", "std", "var", "min", "max", "quantile_25", "quantile_75",
           "quantile_90", "quantile_95", "skew", "kurtosis", "mad", "iqr")
CATEGORICAL = ("count", "nunique", "mode", "mode_count", "mode_rel_freq")
DATETIME = ("count", "min_date", "max_date", "date_range_days", "unique_dates", "dates_per_month")
IDENTIFIER = ("count", "nunique")
QUANTILES = {"quantile_25": 0.25, "median": 0.5, "quantile_75": 0.75, "quantile_90": 0.90, "quantile_95": 0.95}

Extra = Mapping[str, Callable[[Column], Column]]


def default_plan(facts: Facts) -> dict[str, list[str]]:
    """The metrics that suit each column's kind."""
    chosen = {"numeric": NUMERIC, "datetime": DATETIME, "identifier": IDENTIFIER}
    return {c: list(chosen.get(f.kind, CATEGORICAL)) for c, f in facts.items() if f.kind is not None}


def family_of(wanted: Sequence[str]) -> str:
    """Which family a list of metric names belongs to."""
    only_dates = set(DATETIME) - {"count"}
    only_numbers = set(NUMERIC) - {"count", "mode", "min", "max"}
    if only_dates & set(wanted):
        return "datetime"
    return "numeric" if only_numbers & set(wanted) else "categorical"


def _long(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Unpivot metrics of a one-row-per-column frame."""
    def entry(name: str, value: Column, kind: str) -> Column:
        slots = {
            "value_double": F.lit(None).cast("double"),
            "value_string": F.lit(None).cast("string"),
            "value_array": F.lit(None).cast("array<bigint>"),
        }
        slots[kind] = value
        return F.struct(F.lit(name).alias("metric"), *[v.alias(k) for k, v in slots.items()])

    entries = []
    for name, value in values.items():
        if name in ("mode_text", "min_date", "max_date"):
            entries.append(entry("mode" if name == "mode_text" else name, value, "value_string"))
        elif name == "dates_per_month":
            entries.append(entry(name, value, "value_array"))
        else:
            entries.append(entry(name, value.cast("double"), "value_double"))
    return df.select("column", F.explode_outer(F.array(*entries)).alias("m")).select("column", "m.*")


def moments(rows: DataFrame) -> DataFrame:
    """(column, count, mean, std, var, min, max, skew, kurtosis) of (column, x) rows."""
    n = F.col("count").cast("double")
    base = rows.groupBy("column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.var_samp("x").alias("var"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
    )
    constant = F.col("min") == F.col("max")
    skew = F.when(n >= 3, F.when(constant, 0.0).otherwise(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)))
    kurtosis = F.when(
        n >= 4,
        F.when(constant, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)),
    )
    shape = base.select("column", "count", "mean", "std", "var", "min", "max",
                        skew.alias("skew"), kurtosis.alias("kurtosis"))
    return shape.select("column", "count", *[S.finite(F.col(c)).alias(c) for c in shape.columns[2:]])


def weighted_moments(values: DataFrame, bins: DataFrame) -> DataFrame:
    """(column, count, mean, std, var, min, max, skew, kurtosis, mad) of (column, x, n) rows and their ``value_bins``.

    Counts, extremes and means come from the bins; the powers of the distances from the mean, and the distances
    themselves (``mad`` is their mean), from one pass over the values.
    """
    totals = bins.groupBy("column").agg(F.sum("__n").alias("count"), F.min("__low").alias("min"), F.max("__high").alias("max"),
                                        (F.sum("__sum") / F.sum("__n")).alias("mean"))
    gap = F.col("x") - F.col("mean")
    # one row per column
    central = values.join(F.broadcast(totals.select("column", "mean")), "column").groupBy("column").agg(
        *[F.sum(F.col("n") * part).alias(name) for name, part in (
            ("m1", F.abs(gap)), ("m2", gap * gap), ("m3", gap * gap * gap), ("m4", gap * gap * gap * gap))])
    n, constant = F.col("count").cast("double"), F.col("min") == F.col("max")
    var = F.when(n > 1, F.when(constant, 0.0).otherwise(F.col("m2") / (n - 1)))
    g1 = F.try_divide(F.sqrt(n) * F.col("m3"), F.pow("m2", F.lit(1.5)))
    g2 = F.try_divide(n * F.col("m4"), F.col("m2") * F.col("m2")) - 3
    skew = F.when(n >= 3, F.when(constant, 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))
    kurtosis = F.when(n >= 4, F.when(constant, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))
    shape = totals.join(F.broadcast(central), "column").select(
        "column", "count", "mean", F.sqrt(var).alias("std"), var.alias("var"), "min", "max", skew.alias("skew"), kurtosis.alias("kurtosis"),
        F.when(constant, 0.0).otherwise(F.col("m1") / n).alias("mad"))
    return shape.select("column", "count", *[S.finite(F.col(c)).alias(c) for c in shape.columns[2:]])


def numeric_metrics(df: DataFrame, columns: Sequence[str], wanted: Sequence[str] = NUMERIC,
                    extra: Extra | None = None) -> DataFrame:
    """M1-M16.  The table is read once: the mode needs every distinct value with its count, and what else is asked for
    follows from these.  Without the mode nothing is shuffled but totals, and rows take the values' place.
    """
    rows, wanted = Q.number_rows(df, columns), set(wanted)
    values = stored(Q.number_counts(df, columns), "values") if "mode" in wanted else rows.withColumn("n", F.lit(1).cast("bigint"))
    bins = stored(O.value_bins(values, ["column"], weight="n"), "bins")
    parts = []
    simple = [m for m in ("count", "mean", "std", "var", "min", "max", "skew", "kurtosis", "mad") if m in wanted]
    if simple:
        parts.append(_long(weighted_moments(values, bins), {m: F.col(m) for m in simple}))
    if "mode" in wanted:
        common = values.groupBy("column").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias("mode"))
        parts.append(_long(common, {"mode": S.finite(F.col("mode"))}))
    asked = {m: p for m, p in QUANTILES.items() if m in wanted or ("iqr" in wanted and p in (0.25, 0.75))}
    if asked:
        cuts = O.quantile_columns(values, ["column"], asked, weight="n", bins=bins)
        found = {m: S.finite(F.col(m)) for m in asked if m in wanted}
        if "iqr" in wanted:
            found["iqr"] = S.finite(F.col("quantile_75") - F.col("quantile_25"))
        parts.append(_long(cuts, found))
    if extra:
        own = rows.groupBy("column").agg(*[build(F.col("x")).alias(m) for m, build in extra.items()])
        parts.append(_long(own, {m: F.col(m) for m in extra}))
    return _complete(union_all(parts), df, columns, [m for m in NUMERIC if m in wanted])


def categorical_metrics(df: DataFrame, columns: Sequence[str], wanted: Sequence[str] = CATEGORICAL) -> DataFrame:
    """M17-M21 and M28 from one table of value counts; shares refer to all rows of the table."""
    wanted = set(wanted)
    counts = Q.value_counts(df, columns)
    top = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("nunique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode_text"),
        F.max("n").alias("mode_count"),
    )
    rows = df.agg(F.count(F.lit(1))).scalar()
    top = top.withColumn("mode_rel_freq", F.col("mode_count") / rows)
    names = [m for m in ("count", "nunique", "mode", "mode_count", "mode_rel_freq") if m in wanted]
    values = {("mode_text" if m == "mode" else m): F.col("mode_text" if m == "mode" else m) for m in names}
    return _complete(_long(top, values), df, columns, names, zero=("count", "nunique"))


def identifier_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and number of distinct values; long texts are compared by digest."""
    fill = Q.column_fill(df, columns).select("column", F.col("non_null").alias("count"))
    both = fill.join(F.broadcast(Q.distinct_counts(df, columns)), "column", "left")
    return _long(both, {"count": F.col("count"), "nunique": F.coalesce("nunique", F.lit(0))})


def days_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, day, n, first, last): at most one row per calendar day."""
    types = Q.dtypes(df)
    rows = Q.unpivot(df, {c: S.moment(c, types[c]) for c in columns}, "column", "t").filter("t IS NOT NULL")
    return rows.groupBy("column", F.to_date("t").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last")
    )


def months_of(days: DataFrame) -> DataFrame:
    """(column, month, n): counts per month end, months without rows as 0, columns of at least 2 rows."""
    counted = days.groupBy("column", F.last_day("day").alias("month")).agg(F.sum("n").alias("n"))
    span = days.groupBy("column").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.sum("n").alias("total")
    ).filter("total >= 2")
    calendar = span.select(
        "column",
        F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))).alias("m"),
    ).select("column", F.last_day("m").alias("month"))
    return calendar.join(counted, ["column", "month"], "left").select(
        "column", "month", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def datetime_metrics(df: DataFrame, columns: Sequence[str], wanted: Sequence[str] = DATETIME) -> DataFrame:
    """M22-M27 from counts per calendar day."""
    wanted = set(wanted)
    days = days_of(df, columns)
    summary = days.groupBy("column").agg(
        F.sum("n").alias("count"), F.min("first").alias("low"), F.max("last").alias("high"),
        F.count(F.lit(1)).alias("unique_dates"),
    )

    def iso(c: str) -> Column:
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(c, "SSSSSS")
        return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))

    span = F.timestamp_diff("MICROSECOND", F.col("low"), F.col("high"))
    available = {
        "count": F.col("count"), "min_date": iso("low"), "max_date": iso("high"),
        "date_range_days": F.when(F.col("count") >= 2, F.floor(span / F.lit(86_400_000_000))),
        "unique_dates": F.col("unique_dates"),
    }
    picked = {m: v for m, v in available.items() if m in wanted}
    parts = [_long(summary, picked)] if picked else []
    if "dates_per_month" in wanted:
        series = months_of(days).groupBy("column").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("month", "n"))), lambda s: s["n"]).alias("series")
        )
        parts.append(_long(series, {"dates_per_month": F.col("series")}))
    return _complete(union_all(parts), df, columns, [m for m in DATETIME if m in wanted], zero=("count",))


def _complete(metrics: DataFrame, df: DataFrame, columns: Sequence[str], names: Sequence[str],
              zero: Sequence[str] = ()) -> DataFrame:
    """Add the null (or 0) metrics of columns that hold no value at all."""
    wanted = literal_rows(
        df.sparkSession, [(c, m, 0.0 if m in zero else None) for c in columns for m in names],
        "column string, metric string, fallback double",
    )
    return (
        wanted.join(metrics, ["column", "metric"], "full")
        .select("column", "metric", F.coalesce("value_double", F.when(
            F.col("value_string").isNull(), F.col("fallback"))).alias("value_double"),
            "value_string", "value_array")
    )


def metrics(df: DataFrame, plan: Mapping[str, Sequence[str]], extra: Extra | None = None) -> DataFrame:
    """All metrics of a plan {column: [metric, ...]}; columns with the same list share their passes."""
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for c, wanted in plan.items():
        if c in df.columns and wanted:
            groups.setdefault((family_of(wanted), tuple(wanted)), []).append(c)
    parts = []
    for (family, wanted), columns in groups.items():
        if family == "numeric":
            parts.append(numeric_metrics(df, columns, wanted, extra))
        elif family == "datetime":
            parts.append(datetime_metrics(df, columns, wanted))
        elif set(wanted) <= set(IDENTIFIER):
            parts.append(identifier_metrics(df, columns).filter(F.col("metric").isin(*wanted)))
        else:
            parts.append(categorical_metrics(df, columns, wanted))
    if not parts:
        raise ValueError("the plan names no column of the table")
    return union_all(parts)
