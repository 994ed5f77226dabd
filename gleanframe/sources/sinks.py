"""Writing results and prepared tables, and reading the latter back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder
from .tables import Table


def save_results(results: Mapping[str, DataFrame], folder: str, fmt: str = "json",
                 mode: str = "overwrite") -> None:
    """One dataset per result table: ``folder/name``."""
    for name, df in results.items():
        df.write.format(fmt).mode(mode).save(f"{folder}/{name}")


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table once to the shared folder, so that what follows reads it instead of its sources."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_tables(tables: Sequence[Table], folder: str, mode: str = "overwrite") -> None:
    """The prepared tables as Parquet: ``folder/table_id``."""
    for table in tables:
        table.df.write.mode(mode).parquet(f"{folder}/{table.id}")


def reload_tables(spark: SparkSession, folder: str, ids: Sequence[str]) -> list[Table]:
    return [Table(i, i, spark.read.parquet(f"{folder}/{i}")) for i in ids]
