"""Long forms, value counts, distinct counts, duplicates.

Values are unpivoted to (column, value) rows, so that one shuffle serves all
columns and no multi-distinct Expand is planned.  Spark combines equal values
before the shuffle, so a value held by a third of all rows travels as one row
per map task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import scalar as S

# Arrays of one struct per column are unfolded with explode_outer throughout: for a plain
# explode the optimizer derives conditions that mention all columns, and copying those
# through the aliases of a wide table takes time exponential in its width.

# Text longer than this is counted by its SHA-256, so that whole documents are
# compared while 71 characters of each are shuffled.
DIGEST_ABOVE = 64


def dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {field.name: field.dataType for field in df.schema.fields}


def flat_columns(df: DataFrame) -> list[str]:
    """Columns that hold single values (arrays, maps, structs and bytes are not profiled)."""
    return [name for name, dtype in dtypes(df).items() if not S.is_nested(dtype)]


def unpivot(df: DataFrame, values: dict[str, Column], name: str, value: str,
            keep: Sequence[Column] = ()) -> DataFrame:
    """(keep..., name, value) rows for expressions of one type, nulls included."""
    wide = df.select(*keep, *[expr.alias(label) for label, expr in values.items()])
    kept = wide.columns[: len(keep)]
    return wide.unpivot([S.col(k) for k in kept], [S.col(v) for v in values], name, value)


def number_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x): every non-missing number of the given columns."""
    types = dtypes(df)
    long = unpivot(df, {c: S.number(c, types[c]) for c in columns}, "column", "x")
    return long.filter(F.col("x").isNotNull())


def text_rows(df: DataFrame, columns: Sequence[str], stripped: bool = False,
              null_label: str | None = None) -> DataFrame:
    """(column, value): every value as text."""
    types = dtypes(df)

    def as_text(c: str) -> Column:
        if stripped:
            return S.label(c, types[c], null_label)
        text = S.present(c, types[c]).cast("string")
        return F.coalesce(text, F.lit(null_label)) if null_label is not None else text

    long = unpivot(df, {c: as_text(c) for c in columns}, "column", "value")
    return long.filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str], stripped: bool = False,
                 null_label: str | None = None) -> DataFrame:
    """(column, value, n) for all columns in one shuffle."""
    rows = text_rows(df, columns, stripped, null_label)
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def number_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x, n) for all numeric columns in one shuffle."""
    return number_rows(df, columns).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))


def fingerprint(c: Column, dtype: T.DataType) -> Column:
    """The value itself where it is short, else its digest (which is never short)."""
    if not isinstance(dtype, T.StringType):
        return c
    return F.when(F.length(c) > DIGEST_ABOVE, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def carrier(dtype: T.DataType) -> str:
    """The type in which values of a column are told apart: two of them differ there as their texts do.

    Numbers and moments travel as such, since writing each as text costs more than counting it.
    """
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DateType)):
        return dtype.simpleString()
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp_ntz"
    return "string" if isinstance(dtype, T.StringType) else "text"


def carried_rows(columns: Sequence[tuple[int, DataFrame, str]]) -> dict[str, DataFrame]:
    """Per carrier the (id, value) rows of numbered columns, missing values left out; ``text`` are values written as text.

    Text is parted into ``string`` and ``long`` (above DIGEST_ABOVE): code that handles both in one loop grows too large
    for the virtual machine to compile.
    """
    wanted: dict[str, dict[int, tuple[DataFrame, dict[str, Column]]]] = {}
    for i, df, name in columns:
        dtype = df.schema[name].dataType
        kind = carrier(dtype)
        value = S.present(name, dtype).cast("string" if kind == "text" else kind)
        wanted.setdefault(kind, {}).setdefault(id(df), (df, {}))[1][str(i)] = value
    is_long = F.length("value") > DIGEST_ABOVE

    def rows(frames: Sequence[tuple[DataFrame, dict[str, Column]]], kept: Column) -> DataFrame:
        parts = [unpivot(df, values, "id", "value") for df, values in frames]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.filter(F.col("value").isNotNull() & kept).select(F.col("id").cast("int").alias("id"), "value")

    out = {}
    for kind, found in wanted.items():
        frames = list(found.values())
        out[kind] = rows(frames, ~is_long if kind == "string" else F.lit(True))
        if kind == "string":
            holding = [(df.filter(F.greatest(F.lit(0), *[F.length(v) for v in values.values()]) > DIGEST_ABOVE), values) for df, values in frames]
            out["long"] = rows(holding, is_long)
    return out


def level_counts(columns: Sequence[tuple[int, DataFrame, str]], tests: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(id, nunique, and the rows each test holds for): exact numbers of distinct non-missing values of numbered columns.

    Tests apply to the values of text columns: once per distinct value of short texts, once per row of long ones, which
    travel as digests.  Columns without a value have no row.
    """
    tests = tests or {}
    value = F.col("value")
    parts = []
    for kind, rows in carried_rows(columns).items():
        if kind in ("string", "long"):
            tested = [test(value).alias(name) for name, test in tests.items()]
            one = F.count(F.lit(1)).alias("n")
            if kind == "string":
                levels = rows.groupBy("id", "value").agg(one).select("id", "n", *tested)
            else:
                digests = rows.select("id", fingerprint(value, T.StringType()).alias("value"), *tested)
                levels = digests.groupBy("id", "value", *tests).agg(one)
            held = [F.sum(F.when(F.col(name), F.col("n")).otherwise(0)).alias(name) for name in tests]
        else:
            levels, held = rows.distinct(), [F.lit(None).cast("bigint").alias(name) for name in tests]
        parts.append(levels.groupBy("id").agg(F.count(F.lit(1)).alias("nunique"), *held))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # short and long texts of a column have one row each
    return out.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("nunique", *tests)])


def looked_up(entries: Sequence[str], position: Column) -> Column:
    """The entry of a list of the driver at a position: no join, whose derived conditions would spread over wide tables."""
    return F.get(F.array(*[F.lit(e) for e in entries]), position)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nunique): exact number of distinct non-missing values per column."""
    counts = level_counts([(i, df, c) for i, c in enumerate(columns)])
    return counts.select(looked_up(columns, F.col("id")).alias("column"), "nunique")


def distinct_up_to(rows: DataFrame, keys: Sequence[str], value: str, limit: int) -> DataFrame:
    """(keys..., levels): the exact number of distinct values, or ``limit`` if there are more.

    The many-valued keys are told apart by the number of occupied hash slots: that
    needs one bounded row per slot instead of a shuffle of all values.  Only keys
    whose slots stay below ``limit`` are then counted value by value.
    """
    slots = rows.select(*keys, F.pmod(F.xxhash64(value), F.lit(64 * limit)).alias("__slot")).distinct()
    occupied = slots.groupBy(*keys).agg(F.count(F.lit(1)).alias("__occupied"))
    many = occupied.filter(F.col("__occupied") >= limit)
    few = occupied.filter(F.col("__occupied") < limit).select(*keys)
    counted = (
        rows.select(*keys, value)
        .join(F.broadcast(few), list(keys), "left_semi")
        .distinct()
        .groupBy(*keys)
        .agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("levels"))
    )
    return counted.unionByName(many.select(*keys, F.lit(limit).cast("bigint").alias("levels")))


def all_filled(tests: Sequence[Column]) -> Column:
    """Whether every test holds, as one flat expression: a long chain of ANDs takes the optimizer too long."""
    return F.least(*tests) if len(tests) > 1 else tests[0]


def column_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, column, rows, non_null, complete_rows) from a single pass without a shuffle of rows."""
    types = dtypes(df)
    columns = list(columns) if columns is not None else df.columns
    if not columns:
        raise ValueError("no columns to describe")
    filled = {c: S.present(c, types[c]).isNotNull() for c in columns}
    complete = all_filled(list(filled.values()))
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(complete).alias("complete_rows"),
        *[F.count_if(test).alias(f"__f{i}") for i, test in enumerate(filled.values())],
    )
    entries = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"__f{i}").alias("non_null"))
        for i, c in enumerate(columns)
    ]
    return one.select("rows", "complete_rows", F.explode_outer(F.array(*entries)).alias("e")).select(
        "e.ordinal", "e.column", "rows", "e.non_null", "complete_rows"
    )


def row_groups(df: DataFrame) -> DataFrame:
    """(n): one row per distinct row of the table with its number of copies; nulls are equal.

    Rows meet by a digest of 32 bytes: every value is written with its length before it, a null as a mark without
    one, so that no two different rows are written alike.
    """
    def written(c: str, t: T.DataType) -> Column:
        text = F.to_json(F.struct(S.col(c))) if S.is_nested(t) else S.present(c, t).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    digest = F.unhex(F.sha2(F.concat(F.lit(""), *[written(c, t) for c, t in dtypes(df).items()]), 256))
    return df.select(digest.alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n")).select("n")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row (rows, duplicate_rows): rows beyond the first of their kind."""
    return row_groups(df).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, a, b, n): joint counts of the column pairs, missing values left out."""
    types = dtypes(df)
    text = {c: S.present(c, types[c]).cast("string") for pair in pairs for c in pair}
    cells = {
        str(i): F.when(
            text[a].isNotNull() & text[b].isNotNull(),
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), text[a].alias("a"), text[b].alias("b")),
        )
        for i, (a, b) in enumerate(pairs)
    }
    rows = unpivot(df, cells, "pair", "cell").filter(F.col("cell").isNotNull())
    return rows.groupBy("cell.col_a", "cell.col_b", "cell.a", "cell.b").agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps k rows per task before it shuffles."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= k)

