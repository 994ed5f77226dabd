"""Registration and comparison helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gleanframe.sources.tables import Table, tidy

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """The test tables of one scale."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> Table:
        return Table(name, name, tidy(getattr(self, name)))

    def tables(self, *names: str) -> list[Table]:
        return [self.table(n) for n in names]


def query(name: str, sql: str | None = None):
    """Register a function of the tables; every double it returns is rounded for comparison."""
    def register(build: Callable[[Data], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(Data(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


#: Before rounding, values are moved by this share of themselves on both sides: a value that lies halfway between two
#: decimals (as means of cents often do) is then no longer decided by the order of floating-point additions.
NUDGE = 1.00000000001


def settle(c: Column) -> Column:
    """Rounding to seven digits or more, which leaves room for the order of floating-point additions."""
    size, c = F.abs(c), c * NUDGE
    return (F.when(size < 1e4, F.round(c, 6)).when(size < 1e8, F.round(c, 2)).when(size < 1e12, F.round(c / 1e2, 0) * 1e2)
            .otherwise(F.round(c / 1e6, 0) * 1e6)) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    def out(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return (settle(c) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name)

    return df.select(*[out(f) for f in df.schema.fields])


def r(expr: str, name: str) -> str:
    """The same rounding in SQL."""
    moved = f"({expr}) * CAST({NUDGE!r} AS DOUBLE)"
    return (f"CASE WHEN abs({expr}) < 1e4 THEN round({moved}, 6) WHEN abs({expr}) < 1e8 THEN round({moved}, 2) "
            f"WHEN abs({expr}) < 1e12 THEN round({moved} / 1e2, 0) * 1e2 ELSE round({moved} / 1e6, 0) * 1e6 END + 0.0 AS {name}")


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)
