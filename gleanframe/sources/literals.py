"""Small frames from values the driver holds (metadata, bounds), as literal rows of the plan."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TYPES = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of a schema such as ``"name string, n bigint"``; sent by Arrow, so no Python worker is started for them."""
    columns = [part.strip().split(" ") for part in schema.split(",")]
    data = {
        name: pa.array([row[i] for row in rows], TYPES[kind]) for i, (name, kind) in enumerate(columns)
    }
    return spark.createDataFrame(pa.table(data))


def settled(df: DataFrame) -> DataFrame:
    """A frame of a few rows per column (bounds, kept groups) computed now and held as literal rows.

    Only for frames whose size is bounded by the schema: what uses them several times
    neither plans nor runs their computation again.
    """
    return df.sparkSession.createDataFrame(df.toArrow())
