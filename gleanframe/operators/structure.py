"""Column kinds and roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import DEFAULT_LIMITS, Limits
from ..functions import names as N, scalar as S
from ..sources.literals import settled
from ..sources.tables import Table
from . import frequency as Q


# What a text looks like, tested on its distinct values.
TEXT_TESTS = {
    "dates": lambda value: S.text_to_timestamp(value).isNotNull(),
    "plain": lambda value: value.rlike(S.PLAIN_NUMBER),
    "numbers": lambda value: S.text_to_number(value).isNotNull(),
}


def _counts(table: Table) -> DataFrame:
    """One row per column of a table with its counts and name hints, from one pass over the rows."""
    df, types = table.df, Q.dtypes(table.df)
    position = {c: i for i, c in enumerate(df.columns)}
    filled = {c: S.present(c, types[c]).isNotNull() for c in df.columns}
    complete = Q.all_filled(list(filled.values()))

    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(complete).alias("complete_rows"),
        *[F.count_if(test).alias(f"f{position[c]}") for c, test in filled.items()],
    )

    def entry(c: str) -> Column:
        i, dtype = position[c], types[c]

        family = (
            "nested" if S.is_nested(dtype) else "boolean" if isinstance(dtype, T.BooleanType)
            else "datetime" if S.is_datetime(dtype) else "number" if S.is_numeric(dtype) else "text"
        )
        return F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(family).alias("family"),
            F.lit(dtype.simpleString()).alias("dtype"), F.col(f"f{i}").alias("non_null"),
            F.lit(N.mentions(c, N.ID_WORDS)).alias("id_name"),
            F.lit(N.mentions(c, N.MEASURE_WORDS)).alias("measure_name"),
        )

    entries = F.explode_outer(F.array(*[entry(c) for c in df.columns]))
    return counts.select("rows", "complete_rows", entries.alias("e")).select(
        F.lit(table.id).alias("table_id"), "rows", "complete_rows", "e.*")


def structures(tables: Sequence[Table], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One row per column: table_id, column, ordinal, kind, dtype, rows, non_null, nunique, complete_rows,
    is_datetime_candidate.  Nested columns are listed without kind.

    The distinct values of all tables are counted in one shuffle per type.  The result is computed
    at once, since kinds decide what is computed next: one row per column, never more.
    """
    described = union_all([_counts(t) for t in tables])
    columns = [(t, c) for t in tables for c in Q.flat_columns(t.df)]
    # appended and merged instead of joined: a join would make the optimizer derive
    # conditions from every expression of a wide table
    if columns:
        levels = Q.level_counts([(i, t.df, c) for i, (t, c) in enumerate(columns)], TEXT_TESTS)
        levels = levels.select(
            Q.looked_up([t.id for t, _ in columns], F.col("id")).alias("table_id"),
            Q.looked_up([c for _, c in columns], F.col("id")).alias("column"), "nunique", *TEXT_TESTS)
        described = described.unionByName(levels, allowMissingColumns=True)
    else:
        described = described.withColumns({c: F.lit(None).cast("bigint") for c in ("nunique", *TEXT_TESTS)})
    merged = described.groupBy("table_id", "column").agg(
        *[F.max(c).alias(c) for c in described.columns if c not in ("table_id", "column", *TEXT_TESTS)],
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in TEXT_TESTS])
    joined = merged.withColumn(
        "nunique", F.when(F.col("family") != "nested", F.coalesce("nunique", F.lit(0)))
    )
    return settled(joined.select(
        "table_id", "column", "ordinal", kind_of(limits).alias("kind"), "dtype",
        "rows", "non_null", "nunique", "complete_rows",
        ((F.col("family") == "datetime") | ((F.col("family") == "text") & _dated(limits))).alias(
            "is_datetime_candidate"
        ),
    ))


def structure(table: Table, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The structure rows of one table."""
    return structures([table], limits)


def _dated(limits: Limits) -> Column:
    share = F.try_divide(F.col("dates"), F.col("non_null"))
    plain = F.try_divide(F.col("plain"), F.col("non_null"))
    return F.coalesce((share >= limits.date_parse_ratio) & ~(plain > limits.date_number_ratio), F.lit(False))


def kind_of(limits: Limits = DEFAULT_LIMITS) -> Column:
    """The kind from counts and name hints; the first rule that holds decides, none for nested columns.

    The rules stand in an array rather than in one CASE: a filter on a CASE of this
    size would be rewritten into conjunctions that grow exponentially.
    """
    family, filled, levels = F.col("family"), F.col("non_null"), F.col("nunique")
    number, text = family == "number", family == "text"
    identifies = F.col("id_name") & (filled > 0) & (levels >= limits.identifier_ratio * filled)
    few = F.least(
        F.lit(limits.category_levels),
        F.greatest(F.lit(limits.category_min_levels), F.floor(limits.category_share * filled)),
    )
    castable = F.col("numbers") >= limits.numeric_text_ratio * F.greatest(filled, F.lit(1))
    distinct = (levels > limits.text_unique_ratio * filled) & (levels > limits.text_min_unique)
    rules = (
        (family.isin("boolean", "datetime"), family),
        (text & _dated(limits), F.lit("datetime")),
        ((number | text) & identifies, F.lit("identifier")),
        (number & F.col("measure_name"), F.lit("numeric")),
        (number & (filled > 0) & (levels <= few), F.lit("categorical")),
        (number | (text & castable), F.lit("numeric")),
        (text & distinct, F.lit("textual")),
        (text, F.lit("categorical")),
    )
    return F.get(F.array_compact(F.array(*[F.when(holds, kind) for holds, kind in rules])), F.lit(0))


@dataclass(frozen=True)
class ColumnFacts:
    """What the driver keeps about a column."""

    name: str
    kind: str | None
    dtype: str
    rows: int
    non_null: int
    nunique: int
    is_datetime_candidate: bool


Facts = Mapping[str, ColumnFacts]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def collect_facts(described: DataFrame) -> dict[str, dict[str, ColumnFacts]]:
    """Facts per table from structure rows: one row per column comes to the driver."""
    facts: dict[str, dict[str, ColumnFacts]] = {}
    for r in described.orderBy("table_id", "ordinal").collect():
        facts.setdefault(r["table_id"], {})[r["column"]] = ColumnFacts(
            r["column"], r["kind"], r["dtype"], r["rows"], r["non_null"], r["nunique"] or 0,
            r["is_datetime_candidate"],
        )
    return facts


def table_facts(tables: Sequence[Table], limits: Limits = DEFAULT_LIMITS) -> dict[str, dict[str, ColumnFacts]]:
    """Facts of several tables from one job."""
    return collect_facts(structures(tables, limits))


def with_dates(table: Table, columns: Sequence[str], day_first: bool = False) -> Table:
    """The table with the given columns as timestamps, invalid values as null."""
    types = Q.dtypes(table.df)
    wanted = [c for c in columns if isinstance(types.get(c), T.StringType)]
    parsed = {c: S.moment(c, types[c], day_first) for c in wanted}
    fixed = table.df.select(*[parsed.get(c, S.col(c)).alias(c) for c in table.df.columns])
    return Table(table.id, table.name, fixed, table.filename, table.sheet)


@dataclass(frozen=True)
class Roles:
    """Columns by meaning.  Given explicitly, or read from names and kinds."""

    geo: tuple[str, ...] = ()
    money: tuple[str, ...] = ()
    currency: tuple[str, ...] = ()
    area: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    datetime: tuple[str, ...] = ()
    identifier: tuple[str, ...] = ()

    def labels(self) -> tuple[str, ...]:
        return ordered(self.geo, self.categorical)

    def concentrations(self) -> tuple[str, ...]:
        return ordered(self.geo, self.currency, self.categorical)

    def measures(self) -> tuple[str, ...]:
        return ordered(self.money, self.area, self.numeric)

    def profile_groups(self) -> tuple[str, ...]:
        return ordered(self.geo, self.currency, self.categorical)

    def profile_numbers(self, derived: Sequence[str] = ()) -> tuple[str, ...]:
        return ordered(self.money, derived, self.numeric)


def ordered(*groups: Sequence[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(c for group in groups for c in group))


ROLE_RULES = {
    "geo": (("categorical", "textual"), N.GEO_WORDS),
    "money": (("numeric",), N.MONEY_WORDS),
    "currency": (("categorical", "textual"), N.CURRENCY_WORDS),
    "area": (("numeric",), N.AREA_WORDS),
}
KIND_ROLES = {
    "numeric": ("numeric",),
    "categorical": ("categorical", "boolean"),
    "datetime": ("datetime",),
    "identifier": ("identifier",),
}


def roles_of(facts: Facts) -> Roles:
    named = {
        role: tuple(c for c, f in facts.items() if f.kind in kinds and N.mentions(c, words))
        for role, (kinds, words) in ROLE_RULES.items()
    }
    by_kind = {role: tuple(c for c, f in facts.items() if f.kind in kinds) for role, kinds in KIND_ROLES.items()}
    return Roles(**named, **by_kind)


def role_table(described: DataFrame) -> DataFrame:
    """(table_id, column, role) rows from structure rows, without visiting the driver."""
    lowered = F.lower("column")

    def mentions(words: Sequence[str]) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(lowered, F.lit(word))
        return test

    tests = {role: F.col("kind").isin(*kinds) & mentions(words) for role, (kinds, words) in ROLE_RULES.items()}
    tests |= {role: F.col("kind").isin(*kinds) for role, kinds in KIND_ROLES.items()}
    found = F.array_compact(F.array(*[F.when(test, role) for role, test in tests.items()]))
    return described.select("table_id", "column", F.explode(found).alias("role"))
