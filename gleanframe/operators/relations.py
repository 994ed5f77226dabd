"""Keys that may join tables, and tables that may be appended."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import DEFAULT_LIMITS, Limits
from ..functions import names as N, scalar as S
from ..sources.literals import literal_rows
from ..sources.tables import Table
from . import frequency as Q
from .structure import ColumnFacts, Facts, table_facts, union_all

LINKS = ("kind string, left_table string, left_column string, right_table string, right_column string, "
         "score double, jaccard double, coverage_left double, coverage_right double, matched bigint, "
         "left_unique bigint, right_unique bigint, cardinality string, name_score double")


def is_key_candidate(f: ColumnFacts, limits: Limits = DEFAULT_LIMITS) -> bool:
    """Whether a column may serve as a key at all."""
    keyed = N.mentions(f.name, N.KEY_WORDS)
    unsuited = (
        f.kind is None
        or f.nunique <= 1
        or f.kind == "boolean"
        or (f.kind == "datetime" and not keyed)
        or (f.kind == "numeric" and N.mentions(f.name, N.KEY_MEASURE_WORDS) and not keyed)
        or (f.kind == "textual" and f.nunique > limits.near_unique_text_ratio * f.rows and not keyed)
    )
    return not unsuited


def key_columns(tables: Sequence[Table], facts: Mapping[str, Facts],
                limits: Limits = DEFAULT_LIMITS) -> list[tuple[int, Table, ColumnFacts]]:
    """(number, table, column) of every candidate, numbered in table order."""
    found = [(t, f) for t in tables for f in facts[t.id].values() if is_key_candidate(f, limits)]
    return [(i, t, f) for i, (t, f) in enumerate(found)]


BITS = 62


def key_values(candidates: Sequence[tuple[int, Table, ColumnFacts]], whole: bool = False) -> DataFrame:
    """(value, m0, m1, ...): every canonical value with bit masks of the columns that hold it.

    Each column's values are made distinct in their own types, and only then written as keys: numbers and short texts
    once per distinct value instead of once per row.  All columns of all tables then meet in one shuffle, before which
    masks are combined.  Long values travel as digests unless they are asked for ``whole``.
    """
    types = {t.id: Q.dtypes(t.df) for _, t, _ in candidates}

    def written(c: str, dtype: T.DataType) -> Column:
        key = S.canonical_key(c, dtype)
        return key if whole else Q.fingerprint(key, T.StringType())

    parts, direct = [], {}
    for i, t, f in candidates:
        if Q.carrier(types[t.id][f.name]) == "text":     # a key that depends on the column's type is written per row
            direct.setdefault(t.id, (t, {}))[1][str(i)] = written(f.name, types[t.id][f.name])
    for t, keys in direct.values():
        parts.append(Q.unpivot(t.df, keys, "id", "value").select(F.col("id").cast("int").alias("id"), "value"))
    carried = Q.carried_rows([(i, t.df, f.name) for i, t, f in candidates if Q.carrier(types[t.id][f.name]) != "text"])
    for kind, rows in carried.items():
        key = written("value", rows.schema["value"].dataType)
        if kind != "long":                               # a long text is written before its one shuffle
            rows = rows.groupBy("id", "value").agg(F.count(F.lit(1)).alias("n"))
            # depends on n, so that the filter on keys is not pushed below the grouping and run for every row
            key = F.when(F.col("n") > 0, key)
        parts.append(rows.select("id", key.alias("value")))
    rows = union_all(parts).filter("value IS NOT NULL")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("id") % BITS)

    def mask(k: int) -> Column:
        return F.bit_or(F.when(F.floor(F.col("id") / BITS) == k, bit).otherwise(F.lit(0).cast("bigint")))

    return rows.groupBy("value").agg(*[mask(k).alias(f"m{k}") for k in range(len(candidates) // BITS + 1)])


def _members(values: DataFrame) -> Column:
    """The column numbers encoded in the masks, ascending."""
    def decoded(k: int) -> Column:
        ids = F.sequence(F.lit(BITS * k), F.lit(BITS * (k + 1) - 1))
        return F.filter(ids, lambda i: F.call_function("bit_get", F.col(f"m{k}"), i - BITS * k) == 1)

    masks = [c for c in values.columns if c not in ("value", "n")]
    return F.flatten(F.array(*[decoded(k) for k in range(len(masks))]))


def _pairs(columns: str, with_self: bool = False) -> Column:
    """The pairs a < b (or a <= b) of an array of column numbers: its length is bounded by the schemas."""
    def later(a: Column) -> Column:
        return F.filter(columns, lambda b: (b >= a) if with_self else (b > a))

    return F.flatten(F.transform(
        columns, lambda a: F.transform(later(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def column_overlaps(values: DataFrame) -> DataFrame:
    """(a, b, matched, size_a, size_b) of column numbers with shared values.

    Values are first counted per set of columns; pairs are formed from those few sets.
    """
    masks = [c for c in values.columns if c != "value"]
    sets = values.groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))
    sets = sets.select(_members(sets).alias("columns"), "n")
    pairs = sets.select(F.explode(_pairs("columns", with_self=True)).alias("p"), "n")
    counts = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("matched"))
    # the pair of a column with itself tells its size; per column there is one row per other column
    own = F.when(F.col("a") == F.col("b"), F.col("matched"))
    sized = counts.withColumn("size_a", F.max(own).over(Window.partitionBy("a"))).withColumn(
        "size_b", F.max(own).over(Window.partitionBy("b")))
    return sized.filter("a <> b")


def _pair_facts(candidates: Sequence[tuple[int, Table, ColumnFacts]]) -> list[tuple]:
    """Metadata of column pairs of different tables."""
    out = []
    for (i, t, f), (j, u, g) in combinations(candidates, 2):
        if t.id == u.id:
            continue
        similar = N.name_similarity(N.ColumnName(t.id, f.name), N.ColumnName(u.id, g.name))
        keyed = N.mentions(f.name, N.KEY_WORDS) or N.mentions(g.name, N.KEY_WORDS)
        out.append((i, j, t.id, f.name, u.id, g.name, similar, keyed, f.kind == g.kind == "datetime",
                    f.nunique, g.nunique, f.nunique / max(f.non_null, 1), g.nunique / max(g.non_null, 1)))
    return out


def join_links(tables: Sequence[Table], facts: Mapping[str, Facts] | None = None,
               limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Probable keys, best first within each table pair; all values take part."""
    spark = tables[0].df.sparkSession
    facts = facts if facts is not None else table_facts(tables, limits)
    candidates = key_columns(tables, facts, limits)
    pairs = _pair_facts(candidates)
    if not pairs:
        return literal_rows(spark, [], LINKS)
    known = literal_rows(
        spark, pairs, "a int, b int, left_table string, left_column string, right_table string, right_column string, "
               "name_score double, keyed boolean, both_dates boolean, left_unique bigint, right_unique bigint, "
               "left_ratio double, right_ratio double")
    overlaps = column_overlaps(key_values(candidates))
    # overlaps: at most one row per pair of candidate columns
    joined = overlaps.join(F.broadcast(known), ["a", "b"]).filter(F.col("matched") >= limits.min_shared_values)
    measured = joined.select(
        "*",
        (F.col("matched") / (F.col("size_a") + F.col("size_b") - F.col("matched"))).alias("jaccard"),
        (F.col("matched") / F.col("size_a")).alias("cover_a"), (F.col("matched") / F.col("size_b")).alias("cover_b"),
    ).withColumn("overlap", 0.5 * F.col("jaccard") + 0.5 * F.greatest("cover_a", "cover_b"))
    name, overlap = F.col("name_score"), F.col("overlap")
    unlikely = (
        ((name < 0.4) & (overlap < 0.55)) | ((name < 0.15) & (overlap < 0.7)) | ((name < 0.85) & (overlap < 0.18))
        | (F.col("both_dates") & (name < 0.9))
    )
    bonus = F.when(F.col("keyed"), limits.id_bonus).otherwise(0.0)
    score = F.least(limits.name_weight * name + limits.overlap_weight * overlap + bonus, F.lit(1.0))
    links = measured.filter(~unlikely).withColumn("score", score).filter(F.col("score") >= limits.join_score)
    links = links.select(
        F.lit("join").alias("kind"), "left_table", "left_column", "right_table", "right_column", "score", "jaccard",
        (F.col("cover_a") * 100).alias("coverage_left"), (F.col("cover_b") * 100).alias("coverage_right"),
        "matched", "left_unique", "right_unique",
        cardinality(F.col("left_ratio"), F.col("right_ratio"), limits).alias("cardinality"), "name_score", "a", "b",
    )
    best = Q.top_per_group(links, ["left_table", "right_table"],
                           [F.desc(F.round("score", 4)), F.asc("a"), F.asc("b")], limits.links_per_table_pair)
    return best.orderBy(F.desc(F.round("score", 4)), "a", "b").limit(limits.links_total).drop("rank", "a", "b")


def cardinality(left: Column, right: Column, limits: Limits = DEFAULT_LIMITS) -> Column:
    one_left, one_right = left >= limits.unique_side_ratio, right >= limits.unique_side_ratio
    return (
        F.when(one_left & one_right, "1:1").when(one_left, "1:N").when(one_right, "N:1").otherwise("N:M")
    )


def link_examples(tables: Sequence[Table], facts: Mapping[str, Facts], links: DataFrame,
                  limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(left_table, left_column, right_table, right_column, rank, value): the first shared values of each link.

    Only columns of the given links (metadata rows) are read.  The first values are found per set of columns that hold
    them, of which every task keeps the first ones before they are shuffled; links then choose among those few.
    """
    spark = tables[0].df.sparkSession
    keys = ["left_table", "left_column", "right_table", "right_column"]
    known = {(t.id, f.name): (t, f) for _, t, f in key_columns(tables, facts, limits)}
    wanted = [tuple(r) for r in links.select(*keys).distinct().collect() if r[:2] in known and r[2:] in known]
    if not wanted:
        return literal_rows(spark, [], ", ".join(f"{k} string" for k in keys) + ", rank int, value string")
    sides = list(dict.fromkeys(side for link in wanted for side in (link[:2], link[2:])))
    values = key_values([(i, *known[side]) for i, side in enumerate(sides)], whole=True)

    def held(side: tuple[str, str]) -> Column:
        i = sides.index(side)
        return F.call_function("bit_get", F.col(f"m{i // BITS}"), F.lit(i % BITS)) == 1

    tests = [F.when(held(link[:2]) & held(link[2:]), F.lit(k)) for k, link in enumerate(wanted)]
    masks = [c for c in values.columns if c != "value"]
    several = reduce(add, [F.bit_count(m) for m in masks]) > 1
    values = Q.top_per_group(values.filter(several), masks, [F.asc("value")], limits.link_examples)
    shared = values.select("value", F.explode(F.array_compact(F.array(*tests))).alias("link"))
    first = Q.top_per_group(shared, ["link"], [F.asc("value")], limits.link_examples)
    named = literal_rows(spark, [(k, *link) for k, link in enumerate(wanted)],
                         "link int, " + ", ".join(f"{k} string" for k in keys))
    return first.join(F.broadcast(named), "link").select(*keys, "rank", "value")


def union_links(tables: Sequence[Table], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Table pairs whose column names mostly coincide (metadata only)."""
    found = []
    for left, right in combinations(tables, 2):
        a, b = ({c.lower() for c in t.df.columns} for t in (left, right))
        shared = len(a & b)
        jaccard = shared / max(len(a | b), 1)
        if jaccard >= limits.union_jaccard and shared >= limits.union_min_shared:
            found.append(("union", left.id, None, right.id, None, jaccard, jaccard, 100.0, 100.0, shared,
                          None, None, "union", 1.0))
    return literal_rows(tables[0].df.sparkSession, found, LINKS)


def relations(tables: Sequence[Table], facts: Mapping[str, Facts] | None = None,
              limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Join and union links together."""
    if len(tables) < 2:
        return literal_rows(tables[0].df.sparkSession, [], LINKS)
    return join_links(tables, facts, limits).unionByName(union_links(tables, limits))


def relation_counts(links: DataFrame) -> DataFrame:
    """(kind, n, best_score) of the links."""
    return links.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best_score"))


def verify_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row on what a join would do: rows on both sides, unmatched rows, joined rows, largest fan-out.

    Both sides are reduced to counts per key first, so a hot key is one row on each side.
    """
    lt, rt = Q.dtypes(left), Q.dtypes(right)
    a = left.select(S.canonical_key(left_key, lt[left_key]).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("na"))
    b = right.select(S.canonical_key(right_key, rt[right_key]).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("nb"))
    both = a.join(b, "key", "full")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return both.agg(
        F.coalesce(F.sum(na), F.lit(0)).alias("left_rows"), F.coalesce(F.sum(nb), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.when(nb == 0, na)), F.lit(0)).alias("left_unmatched"),
        F.coalesce(F.sum(F.when(na == 0, nb)), F.lit(0)).alias("right_unmatched"),
        F.coalesce(F.sum(na.cast("decimal(19,0)") * nb.cast("decimal(19,0)")), F.lit(0)).alias("joined_rows"),
        F.coalesce(F.max(F.when(na > 0, nb)), F.lit(0)).alias("largest_fan_out"),
    )


def verify_union(tables: Sequence[Table]) -> DataFrame:
    """(rows, duplicate_rows) of the appended tables, the source not taking part in the comparison."""
    return Q.duplicate_rows(appended(tables).drop("_source_table"))


def appended(tables: Sequence[Table]) -> DataFrame:
    """All rows of tables of similar schema with their ``_source_table``."""
    frames = [t.df.withColumn("_source_table", F.lit(t.id)) for t in tables]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
