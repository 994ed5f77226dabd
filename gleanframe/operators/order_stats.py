"""Exact ranks and quantiles without gathering a column in one task.

Values are cut into cells by a rule that preserves their order and depends on
the values alone, so every attempt of a task cuts alike: first by the logarithm
of the magnitude, then evenly between the smallest and largest value seen in
that bin.  Cell totals are few; running sums over them say which cell holds a
wanted rank, and only that cell is looked into value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BINS_PER_E = 64          # bins per factor e: at most ~190 000 bins over all doubles
BIN_OFFSET = 50_000      # keeps the bins of positive numbers positive
INFINITE_BIN = 200_000
SLOTS_PER_BIN = 4096     # even slots inside a bin that holds a wanted rank
SLOTS_TOTAL = 16_384     # even slots over all bins when every value is ranked
BROADCAST_ROWS = 500_000  # cell totals (some 60 bytes each) above this are joined by a shuffle


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _listed(names: Sequence[str]) -> str:
    return "".join(_quoted(n) + ", " for n in names)


def magnitude_bin(x: str) -> str:
    """SQL for an integer that never decreases while x grows; never null for a number."""
    level = (f"CASE WHEN {x} = 0 THEN 0 WHEN abs({x}) = double('inf') THEN {INFINITE_BIN} "
             f"ELSE CAST(floor(ln(abs({x})) * {BINS_PER_E}) AS INT) + {BIN_OFFSET} END")
    return f"coalesce(CAST(signum({x}) AS INT) * {level}, 0)"


def even_slot(x: str, low: str, high: str, slots: str | int) -> str:
    """SQL for the number of the even slot of x between low and high; halves keep the width from overflowing."""
    share = f"try_divide({x} / 2 - {low} / 2, {high} / 2 - {low} / 2)"
    return (f"coalesce(CASE WHEN {low} = {high} OR isnan({share}) THEN 0 "
            f"ELSE CAST(least(floor({share} * {slots}), {slots} - 1) AS INT) END, 0)")


def _before(n: str, partition: Sequence[str], order: str) -> str:
    """SQL for the running sum of n over the rows before the current one."""
    by = ", ".join(_quoted(c) for c in partition)
    return (f"coalesce(sum({n}) OVER ({'PARTITION BY ' + by if by else ''} ORDER BY {order} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")


def _binned(rows: DataFrame, keys: Sequence[str], x: str, weight: str | None) -> DataFrame:
    return rows.selectExpr(*[_quoted(c) for c in keys], f"{_quoted(x)} AS __x", f"{magnitude_bin(_quoted(x))} AS __bin",
                           f"{_quoted(weight) if weight else '1L'} AS __w").filter("__x IS NOT NULL")


def value_bins(rows: DataFrame, keys: Sequence[str], x: str = "x", weight: str | None = None) -> DataFrame:
    """(keys..., __bin, __n, __low, __high, __sum): totals of the values of equal magnitude, combined before the shuffle.

    ``weight`` names the column that says how often a value occurs; without it every row counts once.  The table is
    small, so it may be stored and serve means, extremes and quantiles alike.
    """
    return _binned(rows, keys, x, weight).groupBy(*keys, "__bin").agg(
        F.expr("sum(__w) AS __n"), F.expr("min(__x) AS __low"), F.expr("max(__x) AS __high"), F.expr("sum(__x * __w) AS __sum"))


def _ranked_values(rows: DataFrame, keys: list[str], probabilities: Sequence[float], x: str,
                   bounded_keys: bool, weight: str | None = None, bins: DataFrame | None = None) -> DataFrame:
    """(keys..., __at, n): per key a map from each rank next to a wanted quantile to its value.

    Expressions are SQL text: the plan is long, and text is parsed in one call each.
    """
    hint = F.broadcast if bounded_keys else (lambda d: d)
    k = _listed(keys)
    by_key = f"PARTITION BY {k[:-2]}" if keys else ""
    data = _binned(rows, keys, x, weight)
    bins = (value_bins(rows, keys, x, weight) if bins is None else bins).select(*keys, "__bin", "__n", "__low", "__high")
    bins = bins.selectExpr("*", f"{_before('__n', keys, '__bin')} AS __before", f"sum(__n) OVER ({by_key}) AS __total")

    # ranks from 0 next to each wanted place, and those of them within a cell of __n values after __before others
    places = ", ".join(f"CAST({side}({float(p)!r}D * (__total - 1)) AS BIGINT)" for p in probabilities for side in ("floor", "ceil"))
    held = f"filter(array_distinct(array({places})), r -> r >= __before AND r < __before + __n)"

    hit_bins = bins.filter(f"size({held}) > 0").selectExpr(
        *[_quoted(c) for c in keys], "__bin", "__low", "__high", "__total", "__before AS __base")
    # __base and __total depend on the bin: as grouping keys they travel along without a second join
    inside = data.join(hint(hit_bins), [*keys, "__bin"]).selectExpr(
        *[_quoted(c) for c in keys], "__bin", f"{even_slot('__x', '__low', '__high', SLOTS_PER_BIN)} AS __slot",
        "__x", "__w", "__base", "__total")
    slots = inside.groupBy(*keys, "__bin", "__slot", "__base", "__total").agg(F.expr("sum(__w) AS __n"))
    hit_slots = (
        slots.selectExpr("*", f"__base + {_before('__n', [*keys, '__bin'], '__slot')} AS __before")
        .filter(f"size({held}) > 0")
        .selectExpr(*[_quoted(c) for c in keys], "__bin", "__slot", "__before AS __start")
    )
    values = (
        inside.join(hint(hit_slots), [*keys, "__bin", "__slot"])
        .groupBy(*keys, "__bin", "__slot", "__x", "__start", "__total")
        .agg(F.expr("sum(__w) AS __n"))
    )
    return (
        values.selectExpr("*", f"__start + {_before('__n', [*keys, '__bin', '__slot'], '__x')} AS __before")
        .selectExpr(*[_quoted(c) for c in keys], "__x", "__total", f"explode({held}) AS __rank")
        .groupBy(*keys)
        .agg(F.expr("map_from_entries(collect_list(struct(__rank, __x))) AS __at"), F.expr("max(__total) AS n"))
    )


def _interpolated(p: str) -> str:
    place = f"({p} * (n - 1))"
    left, right = f"__at[CAST(floor({place}) AS BIGINT)]", f"__at[CAST(ceil({place}) AS BIGINT)]"
    return f"CASE WHEN {left} = {right} THEN {left} ELSE {left} + ({right} - {left}) * ({place} - floor({place})) END"


def exact_quantiles(rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float],
                    x: str = "x", bounded_keys: bool = True) -> DataFrame:
    """(keys..., p, quantile, n): linearly interpolated quantiles of the non-null ``x`` per key.

    ``rows`` is read three times and never shuffled as such: what is shuffled are
    cell totals and the distinct values of the few cells that hold a wanted rank.
    With ``bounded_keys`` (column names, capped group lists) there are at most two
    wanted ranks per key and probability, and that list is broadcast.
    """
    found = _ranked_values(rows, list(keys), probabilities, x, bounded_keys)
    wanted = ", ".join(f"{float(p)!r}D" for p in probabilities)
    own = [_quoted(c) for c in keys]
    return found.selectExpr(*own, "__at", "n", f"explode(array({wanted})) AS p").selectExpr(
        *own, "p", f"{_interpolated('p')} AS quantile", "n")


def few_groups(rows: DataFrame, keys: Sequence[str], limit: int = 50_000) -> bool:
    """Whether ``rows`` have at most ``limit`` different keys: one small job that ends when more are seen."""
    return rows.select(*keys).distinct().limit(limit + 1).count() <= limit


def quantile_columns(rows: DataFrame, keys: Sequence[str], names: dict[str, float], x: str = "x", bounded_keys: bool = True,
                     weight: str | None = None, bins: DataFrame | None = None) -> DataFrame:
    """(keys..., one column per named quantile); ``bins`` are the rows' ``value_bins``, where they are known already."""
    found = _ranked_values(rows, list(keys), sorted(set(names.values())), x, bounded_keys, weight, bins)
    return found.selectExpr(*[_quoted(c) for c in keys],
                            *[f"{_interpolated(f'{float(p)!r}D')} AS {_quoted(name)}" for name, p in names.items()])


def _attached(rows: DataFrame, cells: DataFrame, keys: Sequence[str], columns: Sequence[str], limit: int) -> DataFrame:
    """``rows`` with columns of their cell; ``cells`` have one row per key and ``__d`` values in each.

    The cells are counted, and broadcast up to ``limit`` of them.  Beyond it only cells with many of the values are, and
    the others meet their rows by a shuffle.
    """
    if cells.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(cells.select(*keys, *columns)), list(keys))
    return attach_unique(rows, cells, keys, "__d", columns)


def average_ranks(counts: DataFrame, keys: Sequence[str], x: str = "x", n: str = "n", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``counts`` (keys..., x, n; one row per distinct x) with ``avg_rank``, ties averaged, from 1.

    Cell totals grow with the number of keys (per key at most 190 000 bins and 16 384 more slots), so they are broadcast
    only up to ``limit`` rows; for that they are counted by a small job, and ``counts`` should be a stored table.
    """
    keys = list(keys)
    k = [_quoted(c) for c in keys]
    by_key = f"PARTITION BY {', '.join(k)}" if keys else ""
    x, n = _quoted(x), _quoted(n)
    data = counts.selectExpr("*", f"{magnitude_bin(x)} AS __bin")
    bins = data.groupBy(*keys, "__bin").agg(
        F.expr(f"sum({n}) AS __n"), F.expr("count(1) AS __d"), F.expr(f"min({x}) AS __low"), F.expr(f"max({x}) AS __high"))
    bins = bins.selectExpr(
        *k, "__bin", "__d", "__low", "__high", f"{_before('__n', keys, '__bin')} AS __base",
        f"greatest(1, CAST(floor({SLOTS_TOTAL}D * __d / sum(__d) OVER ({by_key})) AS INT)) AS __slots")
    placed = _attached(data, bins, [*keys, "__bin"], ["__low", "__high", "__base", "__slots"], limit).selectExpr(
        *[_quoted(c) for c in counts.columns], "__bin", f"{even_slot(x, '__low', '__high', '__slots')} AS __slot", "__base")
    slots = placed.groupBy(*keys, "__bin", "__slot", "__base").agg(F.expr(f"sum({n}) AS __n"), F.expr("count(1) AS __d"))
    slots = slots.selectExpr(*k, "__bin", "__slot", "__d", f"__base + {_before('__n', [*keys, '__bin'], '__slot')} AS __start")
    own = [_quoted(c) for c in counts.columns]
    return _attached(placed.drop("__base"), slots, [*keys, "__bin", "__slot"], ["__start"], limit).selectExpr(
        *own, f"__start + {_before(n, [*keys, '__bin', '__slot'], x)} + ({n} + 1) / 2 AS avg_rank")


def attach_unique(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str, columns: Sequence[str],
                  hot_parts: int = 1024) -> DataFrame:
    """Inner join of ``rows`` to a lookup with one row per key, safe under hot keys.

    ``lookup[weight]`` says how many rows a key has.  Keys above 1/``hot_parts`` of all
    rows are at most ``hot_parts`` many: they are broadcast.  The others are spread by
    an ordinary shuffle join, where none of them can fill a task.
    """
    keys = list(keys)
    lookup = lookup.select(*keys, weight, *columns)
    total = lookup.agg(F.coalesce(F.sum(weight), F.lit(0))).scalar()
    is_hot = F.col(weight) * hot_parts > total
    hot = lookup.filter(is_hot).select(*keys, *columns, F.lit(True).alias("__hot"))
    cold = lookup.filter(~is_hot).select(*keys, *columns)
    tagged = rows.join(F.broadcast(hot), keys, "left")
    easy = tagged.filter(F.col("__hot")).drop("__hot")
    rest = tagged.filter(F.col("__hot").isNull()).select(*rows.columns).join(cold, keys)
    return easy.unionByName(rest)
