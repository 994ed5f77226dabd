"""Findings put into words: highlights, hypotheses, recommendations.

Everything here works on result tables of the operators.  Each rule selects rows of
one table; rules are appended in a fixed order and the first ones are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT_LIMITS, Limits
from ..operators.structure import Roles, union_all

HYPOTHESIS_COLUMNS = ("kind", "title", "statement", "rationale", "columns", "verification", "priority")
SPEARMAN_SHOWN, SPEARMAN_ASSUMED, ETA_SHOWN = 0.3, 0.25, 0.3
GROUP_RATIO, GROUP_HYPOTHESES = 1.8, 2
CURRENCY_CORE_PCT = 80.0


def _position(c: Column, names: Sequence[str]) -> Column:
    """The place of a column name in an ordered list."""
    if not names:
        return F.lit(0)
    return F.array_position(F.array(*[F.lit(n) for n in names]), c).cast("int")


def _num(c: str | Column, digits: int = 2) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.bround(c, digits).cast("string"), F.lit("-"))


def _names(entries: str | Column, k: int | None = None, counted: bool = False) -> Column:
    """'a, b, c' or 'a (3), b (2)' from an array of (value, count)."""
    entries = F.col(entries) if isinstance(entries, str) else entries
    chosen = F.slice(entries, 1, k) if k else entries

    def shown(e: Column) -> Column:
        return F.concat(e["value"], F.lit(" ("), e["count"].cast("string"), F.lit(")")) if counted else e["value"]

    return F.concat_ws(", ", F.transform(chosen, shown))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def concentration_lists(values: DataFrame) -> DataFrame:
    """One row per column with its core, periphery, rare and foreign values, most frequent first."""
    entry = F.struct("rank", "value", "count")
    outside = ~F.col("in_core")

    def listed(test: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(test, entry)))

    return values.groupBy("column", "role").agg(
        F.count_if(F.col("in_core")).alias("core_size"),
        F.sum(F.when(F.col("in_core"), F.col("share_pct"))).alias("coverage"),
        F.first("majority_script").alias("majority_script"),
        listed(F.col("in_core")).alias("core"), listed(outside).alias("periphery"),
        listed(outside & F.array_contains("flags", "rare")).alias("rare"),
        listed(outside & F.array_contains("flags", "foreign_script")).alias("foreign"),
    )


def highlights(results: Mapping[str, DataFrame], roles: Roles, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(id, kind, severity, title, detail, columns): the first 16 findings of one table.

    ``results`` may hold concentration_values, outliers, implausible,
    label_duplicates, tests and derived.
    """
    parts: list[DataFrame] = []

    def rule(df: DataFrame, block: int, place: Column, sub: int, kind: str | Column, severity: str | Column,
             title: Column, detail: Column, columns: Column) -> None:
        parts.append(df.select(
            F.lit(block).alias("block"), place.alias("place"), F.lit(sub).alias("sub"), title.alias("title"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            detail.alias("detail"), columns.alias("columns"),
        ))

    column, own = F.col("column"), F.array("column")
    if "concentration_values" in results:
        lists = concentration_lists(results["concentration_values"])
        place = _position(column, roles.concentrations())
        geo = F.col("role") == "geo"
        rule(lists.filter(geo & (F.size("periphery") > 0)), 1, place, 0, "geo_outlier", "high",
             _text("Values of ", column, " outside the core area"),
             _text("The core (", F.col("core_size").cast("string"), " values) covers ", _num("coverage"),
                   " % of rows; outside: ", _names("periphery", 8)), own)
        rule(lists.filter(F.size("foreign") > 0), 1, place, 1, "geo_outlier", "high",
             _text("Values of ", column, " in another script"),
             _text("They differ from the prevailing script: ", _names("foreign")), own)
        rule(lists.filter(~geo & (F.size("rare") > 0)), 1, place, 2, "rare_category", "medium",
             _text("Rare categories in ", column), _names("rare", 6, counted=True), own)
    if "outliers" in results:
        rule(results["outliers"].filter("n_outliers > 0"), 2, _position(column, roles.measures()), 0, "numeric_outlier",
             F.when(F.round("pct", 2) >= 1, "high").otherwise("medium"), _text("Outliers in ", column),
             _text(F.col("n_outliers").cast("string"), " values (", _num("pct"), " %), range ", _num("min"), " to ",
                   _num("max"), ", median ", _num("median")), own)
    if "implausible" in results:
        late = F.when(F.col("issue") == "tiny_area", 1000).when(F.col("issue") == "rare_level", 2000).otherwise(0)
        rule(results["implausible"], 3, _position(column, roles.measures()) + late, 0, "implausible", "high",
             _text("Suspicious values: ", column), _implausible_text(), own)
    if "label_duplicates" in results:
        rule(results["label_duplicates"], 4, _position(column, roles.labels()), 0, "quality", "medium",
             _text("Several spellings in ", column), _names("variants", counted=True), own)
    if "tests" in results:
        pair = F.array("col_a", "col_b")
        rule(results["tests"].filter((F.col("type") == "kruskal") & (F.col("eta") >= ETA_SHOWN)), 5, F.lit(1), 0,
             "group_difference", "high", _text("Groups differ statistically"), _test_text(), pair)
        rule(results["tests"].filter((F.col("type") == "spearman") & (F.abs("stat") >= SPEARMAN_SHOWN)), 5, F.lit(0), 0,
             "correlation", "medium", _text("Monotonic relation of two numbers"), _test_text(), pair)
    if "derived" in results:
        rule(results["derived"], 6, F.lit(0), 0, "derived", "medium", _text("Derived metric ", F.col("name")),
             _text("Median ", _num("median"), ", mean ", _num("mean"), ", range ", _num("min"), " to ", _num("max")),
             F.array("numerator", "denominator"))
    if not parts:
        raise ValueError("no result tables to highlight")
    order = ["block", "place", "sub", "title", "detail"]
    kept = union_all(parts).orderBy(*order).limit(limits.highlights)
    # at most 16 rows from here
    return kept.withColumn("id", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select(
        "id", "kind", "severity", "title", "detail", "columns")


def _implausible_text() -> Column:
    issue, count, pct = F.col("issue"), F.col("count").cast("string"), _num("pct")
    return (
        F.when(issue == "negative", _text("Negative values in ", F.col("column"), ": ", count, " (", pct, " %)"))
        .when(issue == "zero", _text("Zeros in ", F.col("column"), ": ", count, " (", pct, " %)"))
        .when(issue == "tiny_area", _text("The value 1 occurs ", count, " times (", pct, " %) in ", F.col("column"),
                                          ": often a wrong unit or test data"))
        .otherwise(_text("Scarce levels of ", F.col("column"), ": ", F.coalesce("detail", F.lit(""))))
    )


def _test_text() -> Column:
    pair = _text(F.col("col_a"), " and ", F.col("col_b"))
    return F.when(F.col("type") == "spearman", _text("Spearman rho ", _num("stat", 4), " between ", pair)).otherwise(
        _text("Differences of ", F.col("col_b"), " by ", F.col("col_a"), ": Kruskal-Wallis H ", _num("stat", 3),
              ", eta ", _num("eta", 4)))


def _hypotheses(parts: Sequence[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """Append rule results, keep the first ones and number them."""
    order = ["block", "place", "sub", "title", "statement"]
    rows = union_all([df.withColumn("block", F.lit(block)) for block, df in parts])
    kept = rows.orderBy(*order).limit(limit)
    numbered = kept.withColumn("id", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return numbered.select("id", *HYPOTHESIS_COLUMNS, F.lit("rules").alias("source"))


def _rule(df: DataFrame, place: Column, sub: int, kind: str | Column, title: Column, statement: Column,
          rationale: Column, columns: Column, verification: str, priority: str | Column) -> DataFrame:
    def as_column(v: str | Column) -> Column:
        return F.lit(v) if isinstance(v, str) else v

    return df.select(
        place.cast("int").alias("place"), F.lit(sub).alias("sub"), as_column(kind).alias("kind"), title.alias("title"),
        statement.alias("statement"), rationale.alias("rationale"), columns.alias("columns"),
        F.lit(verification).alias("verification"), as_column(priority).alias("priority"),
    )


def hypotheses(results: Mapping[str, DataFrame], roles: Roles, derived_names: Sequence[str] = (),
               limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(id, kind, title, statement, rationale, columns, verification, priority, source): up to 14 per table.

    ``results`` may hold concentration_values, label_duplicates, outliers, implausible,
    group_ranges, tests and derived.
    """
    parts: list[tuple[int, DataFrame]] = []
    column, own = F.col("column"), F.array("column")
    place = _position(column, roles.concentrations())
    lists = concentration_lists(results["concentration_values"]) if "concentration_values" in results else None
    geo = (F.col("role") == "geo") | (column.isin(*roles.geo) if roles.geo else F.lit(False))
    if lists is not None:
        outside = lists.filter(F.size("periphery") > 0)
        parts.append((1, _rule(
            outside, place, 0, F.when(geo, "geo_outlier").otherwise("concentration"),
            F.when(geo, _text(column, ": values outside the core area")).otherwise(_text("Concentration of ", column)),
            _text("If the core of ", column, " (", F.col("core_size").cast("string"), " values, ", _num("coverage"),
                  " % of rows: ", _names("core"), ") is the main area, then ", F.size("periphery").cast("string"),
                  " values do not belong to it: ", _names("periphery", 10)),
            _text("Coverage rule; periphery: ", _names("periphery", 10)), own,
            "Compare the frequencies of core and tail; check whether rare values are input errors or another market.",
            F.when(geo, "high").otherwise("medium"))))
        parts.append((1, _rule(
            outside.filter(geo & (F.size("foreign") > 0)), place, 1, "geo_outlier",
            _text("Places in another script in ", column),
            _text("If the main market is written in ", F.col("majority_script"), " script, then ", _names("foreign"),
                  " are foreign and should not be mixed with it"),
            _text("Majority script: ", F.col("majority_script"), "; others: ", _names("foreign")), own,
            "Filter the rows with values in another script and compare their metrics with the core.", "high")))
    if "label_duplicates" in results:
        parts.append((2, _rule(
            results["label_duplicates"], _position(column, roles.labels()), 0, "quality",
            _text("One object, several spellings: ", column),
            _text("If ", _names("variants", counted=True), " mean one category, then the number of categories of ",
                  column, " is overstated and frequencies are understated"),
            _text("Equal without regard to case, ", F.col("total").cast("string"), " rows in all"), own,
            "Normalise case and blanks, then count frequencies and group medians again.", "medium")))
    if "outliers" in results:
        found = results["outliers"]
        examples = (
            F.concat_ws(", ", F.transform(F.slice("examples", 1, 5), lambda e: F.concat(
                F.bround(e["value"], 2).cast("string"), F.lit("x"), e["count"].cast("string"))))
            if "examples" in found.columns else F.lit("-"))
        parts.append((3, _rule(
            found, _position(column, (*roles.measures(), *derived_names)), 0, "numeric_outlier",
            _text("Outliers of ", column, " distort its mean"),
            _text("If ", F.col("n_outliers").cast("string"), " outliers (", _num("pct"), " %) of ", column,
                  " are cut, the mean moves towards the median ", _num("median"), " (mean now ", _num("mean"),
                  ", max ", _num("max"), ")"),
            _text("IQR and median distance: bounds ", _num("lower"), " to ", _num("upper"), ". Examples: ", examples,
                  ". min=", _num("min")), own,
            "Box plot and mean against median with and without outliers; check the minimum separately.", "high")))
    if "implausible" in results:
        late = F.when(F.col("issue") == "tiny_area", 1000).when(F.col("issue") == "rare_level", 2000).otherwise(0)
        parts.append((4, _rule(
            results["implausible"], _position(column, roles.measures()) + late, 0, "implausible",
            _text("Suspicious scale of ", column),
            _text(_implausible_text(), ": such values are probably not comparable with the rest"),
            _implausible_text(), own,
            "Check units, filter by the value, and look at its influence on derived metrics.", "high")))
    if lists is not None:
        parts.append((5, _rule(
            lists.filter((F.col("role") != "geo") & (F.size("rare") > 0)), place, 0, "rare_category",
            _text("Rare values of ", column),
            _text("If the core of ", column, " (", _num("coverage"), " % of rows) are the working categories, then ",
                  _names("rare", 6, counted=True), " are noise or a segment of their own"),
            _text("Rare: ", _names("rare", 6, counted=True)), own,
            "Group the tail as other and compare the metrics of core and tail.", "medium")))
    if "group_ranges" in results:
        cats, nums = roles.profile_groups(), roles.profile_numbers(derived_names)
        order = _position(F.col("cat"), cats) * (len(nums) + 1) + _position(F.col("num"), nums)
        wide = results["group_ranges"].filter(F.round("ratio", 2) >= GROUP_RATIO).withColumn("order", order)
        wide = wide.orderBy("order", "cat", "num").limit(GROUP_HYPOTHESES)
        parts.append((6, _rule(
            wide, F.col("order"), 0, "group_difference", _text(F.col("cat"), " determines the level of ", F.col("num")),
            _text("Segmented by ", F.col("cat"), ", the medians of ", F.col("num"), " differ ", _num("ratio"),
                  " times: ", F.col("high_group"), " ", _num("high"), " against ", F.col("low_group"), " ", _num("low"),
                  " (overall median ", _num("overall_median"), ")"),
            _text("Group medians; overall mean ", _num("overall_mean")), F.array("cat", "num"),
            "Kruskal-Wallis test and comparison of medians; box plot by group.", "high")))
    if "tests" in results:
        monotone = results["tests"].filter((F.col("type") == "spearman") & (F.abs("stat") >= SPEARMAN_ASSUMED))
        parts.append((7, _rule(
            monotone, F.lit(0), 0, "correlation", _text("Relation of ", F.col("col_a"), " and ", F.col("col_b")),
            _text("If ", F.col("col_a"), " grows, ", F.col("col_b"),
                  F.when(F.col("stat") > 0, " grows").otherwise(" falls"), " (Spearman rho ", _num("stat", 4), ")"),
            _test_text(), F.array("col_a", "col_b"), "Scatter plot and Spearman; check stability without outliers.",
            "medium")))
    if "derived" in results:
        times = F.try_divide(F.bround("max", 2), F.nullif(F.bround("median", 2), F.lit(0.0)))
        parts.append((8, _rule(
            results["derived"], F.lit(0), 0, "derived", _text("Normalised metric ", F.col("name")),
            _text("Compared by ", F.col("name"), " instead of the numerator the spread stays high: median ",
                  _num("median"), ", max ", _num("max"), " (", _num(times, 1), " times the median)"),
            _text("mean ", _num("mean"), ", p90 ", _num("p90"), ", n ", F.col("count").cast("string")),
            F.array("numerator", "denominator"),
            "Compute the metric on all rows, box plot by place or category, outliers of the denominator apart.", "high")))
    if lists is not None and roles.money and roles.currency:
        money, currency = roles.money[0], roles.currency[0]
        mixed = lists.filter((column == currency) & (F.bround("coverage", 2) >= CURRENCY_CORE_PCT)
                             & (F.size("periphery") > 0))
        parts.append((9, _rule(
            mixed, F.lit(0), 0, "quality", _text(f"Mixed currencies break comparisons of {money}"),
            _text("If ", _names("core"), " is the working currency (", _num("coverage"), " % of rows), amounts in ",
                  _names("periphery", 6, counted=True), " cannot be compared without conversion"),
            _text("The currency core covers ", _num("coverage"), " % of rows"),
            F.array(F.lit(money), F.lit(currency)),
            f"Split {money} by {currency} and repeat the outlier search within the main currency.", "high")))
    if not parts:
        raise ValueError("no result tables to draw hypotheses from")
    return _hypotheses(parts, limits.hypotheses)


def relation_hypotheses(links: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Hypotheses on the six best join links and two union links."""
    best = Window.partitionBy("kind").orderBy(F.desc("score"), "left_table", "left_column", "right_table", "right_column")
    ranked = links.withColumn("place", F.row_number().over(best))     # at most 40 links and the table pairs
    joins = ranked.filter((F.col("kind") == "join") & (F.col("place") <= 6))
    unions = ranked.filter((F.col("kind") == "union") & (F.col("place") <= 2))
    left = _text(F.col("left_table"), ".", F.col("left_column"))
    right = _text(F.col("right_table"), ".", F.col("right_column"))
    unmatched = 100 - F.least("coverage_left", "coverage_right")
    parts = [
        (1, _rule(
            joins, F.col("place"), 0, "table_relation", _text("Key ", left, " = ", right),
            _text("If ", F.col("left_table"), " and ", F.col("right_table"), " describe one domain, they can be joined by ",
                  F.col("left_column"), " and ", F.col("right_column"), " (", F.col("cardinality"), ", ",
                  F.col("matched").cast("string"), " shared values, coverage up to ",
                  _num(F.greatest("coverage_left", "coverage_right")), " %)"),
            _text("Unmatched keys: ", _num(unmatched, 1), " %"), F.array("left_column", "right_column"),
            "Check inner and left join and the share of unmatched keys; compare aggregates before and after.",
            F.when(F.round("score", 4) >= 0.7, "high").otherwise("medium"))),
        (2, _rule(
            unions, F.col("place"), 0, "table_relation",
            _text("Same schema: ", F.col("left_table"), " and ", F.col("right_table")),
            _text("If ", F.col("left_table"), " and ", F.col("right_table"), " are parts of one sample, they can be appended (",
                  _num(F.col("jaccard") * 100, 0), " % of columns shared)"),
            _text(F.col("matched").cast("string"), " shared columns"), F.array().cast("array<string>"),
            "Check the appended table, its duplicates and the _source_table column.", "medium")),
    ]
    return _hypotheses(parts, limits.relation_hypotheses)


def merge_hypotheses(of_relations: DataFrame | None, of_tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Relation hypotheses first, then those of each table in order; titles carry the table when there are several."""
    several = len(of_tables) > 1
    parts = [] if of_relations is None else [of_relations.select(F.lit(0).alias("part"), "*")]
    for i, (name, df) in enumerate(of_tables, 1):
        title = F.concat(F.lit(f"{name}: "), F.col("title")) if several else F.col("title")
        parts.append(df.withColumn("title", title).select(F.lit(i).alias("part"), *df.columns))
    # at most 8 rows of relations and 14 per table
    order = Window.orderBy("part", "id")
    return union_all(parts).withColumn("new", F.row_number().over(order).cast("bigint")).select(
        F.col("new").alias("id"), *HYPOTHESIS_COLUMNS, "source")


def recommendations(summary: DataFrame, counts: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(table_id, place, code, detail): up to 6 tips per table.

    ``summary`` are quality_summary rows, ``counts`` (table_id, column, ordinal, count) the filled values per column.
    """
    def tip(df: DataFrame, order: int, code: str, detail: Column) -> DataFrame:
        return df.select("table_id", F.lit(order).alias("order"), F.lit(code).alias("code"), detail.alias("detail"))

    sparse = (
        counts.join(F.broadcast(summary.select("table_id", "rows")), "table_id")
        .filter(F.col("count") < F.col("rows") * 0.7)
        .groupBy("table_id").agg(F.min_by(F.struct("column", "count", "rows"), "ordinal").alias("s"))
    )
    parts = [
        tip(sparse, 1, "sparse_column", _text(F.col("s.column"), ": ", F.col("s.count").cast("bigint").cast("string"), "/",
                                              F.col("s.rows").cast("string"), " filled")),
        tip(summary.filter("duplicate_pct > 5"), 2, "duplicate_rows", _text(_num("duplicate_pct"), " % of rows are duplicates")),
        tip(summary.filter("score < 50"), 3, "low_quality", F.lit("Treat conclusions with care until the data are cleaned")),
        tip(summary, 4, "check_missing", F.lit("Check columns with many gaps: fill or drop them")),
        tip(summary, 5, "compare_distributions", F.lit("Compare distributions of numbers with outliers on box plots")),
        tip(summary, 6, "group_rare", F.lit("Group rare values of categories with many levels")),
        tip(summary.filter("columns > 20"), 7, "select_features", F.lit("With many columns, select the key ones")),
    ]
    order = Window.partitionBy("table_id").orderBy("order")           # at most 7 rows per table
    return union_all(parts).withColumn("place", F.row_number().over(order).cast("bigint")).filter(
        F.col("place") <= limits.recommendations).select("table_id", "place", "code", "detail")
