"""Ratios of money to area and their summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S
from ..sources.literals import literal_rows
from . import frequency as Q, order_stats as O
from .structure import Roles


def ratio_pairs(money: Sequence[str], area: Sequence[str]) -> dict[str, tuple[str, str]]:
    return {f"{m} / {a}": (m, a) for m in money for a in area if m != a}


def with_ratios(df: DataFrame, roles: Roles) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """The table with one column per money and area pair; division by zero gives null."""
    types = Q.dtypes(df)
    pairs = ratio_pairs(roles.money, roles.area)
    ratios = [S.safe_divide(S.number(m, types[m]), S.number(a, types[a])).alias(name)
              for name, (m, a) in pairs.items()]
    return df.select("*", *ratios), pairs


def ratio_summary(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(name, numerator, denominator, count, mean, median, min, max, p90) per ratio column with values."""
    rows = Q.number_rows(df, list(pairs))
    base = rows.groupBy("column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    cuts = O.quantile_columns(rows, ["column"], {"median": 0.5, "p90": 0.9})
    sides = literal_rows(
        df.sparkSession, [(name, m, a) for name, (m, a) in pairs.items()], "column string, numerator string, denominator string"
    )
    # one row per ratio on every side
    joined = base.join(F.broadcast(cuts), "column").join(F.broadcast(sides), "column")
    return joined.select(F.col("column").alias("name"), "numerator", "denominator", "count", "mean", "median",
                         "min", "max", "p90")
