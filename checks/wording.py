"""Highlights, hypotheses, recommendations, full profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gleanframe.operators import (
    anomalies as X, associations as A, charts as G, concentration as C, frequency as Q, metrics as M, quality as L, rank_tests as R, relations as J, structure as K,
)
from gleanframe.operators.structure import Roles
from gleanframe.plans import charts as V, findings as W
from gleanframe.plans.profile import profile
from gleanframe.sources.tables import Table

from .base import LABELLED, LABELLED_SCHEMA, SCHEMA, labelled, quality_rows, quality_sql, structure_sql, summary_sql
from .charts import NUMERIC_LINE
from .findings import (
    LINKED, LINKS_SQL, concentration_sql, cramers_sql, eta_sql, outlier_summary_sql, pearson_sql, profiles_sql,
)
from .registry import ORACLES, Data, query, r, union

EVENTS = Roles(geo=("props",), numeric=("value",), categorical=("event_type",))
EVENT_VALUES = union(
    f"SELECT * FROM {concentration_sql('events', c, role)}" for c, role in (("props", "geo"), ("event_type", "categorical")))
EVENT_OUTLIERS = outlier_summary_sql("events", "value")


def event_results(d: Data):
    df = d.events
    return {
        "concentration_values": C.concentration_values(df, EVENTS.concentrations(), EVENTS.geo),
        "outliers": X.outliers_with_examples(df, ["value"]),
        "implausible": X.implausible(df, EVENTS),
        "label_duplicates": X.label_duplicates(df, EVENTS.labels()),
        "tests": R.rank_tests(df, EVENTS, A.correlation_ratio(df, ["props"], ["value"]).withColumn("type", F.lit("eta"))),
    }


@query("highlights_events", f"""
WITH v AS ({EVENT_VALUES}), o AS ({EVENT_OUTLIERS}),
h AS (
  SELECT 10 AS place, 'geo_outlier' AS kind, 'high' AS severity, 'Values of props outside the core area' AS title, 'props' AS columns
  WHERE EXISTS (FROM v WHERE column_name = 'props' AND NOT in_core)
  UNION ALL SELECT 11, 'rare_category', 'medium', 'Rare categories in event_type', 'event_type'
  WHERE EXISTS (FROM v WHERE column_name = 'event_type' AND NOT in_core AND flags LIKE '%rare%')
  UNION ALL SELECT 20, 'numeric_outlier', CASE WHEN pct >= 1 THEN 'high' ELSE 'medium' END, 'Outliers in value', 'value' FROM o
  UNION ALL SELECT 30, 'implausible', 'high', 'Suspicious values: value', 'value' WHERE EXISTS (FROM events WHERE value < 0)
  UNION ALL SELECT 50, 'group_difference', 'high', 'Groups differ statistically', 'props,value' FROM ({eta_sql('events', ['props'], ['value'])}) WHERE s >= 0.3)
SELECT row_number() OVER (ORDER BY place) AS id, kind, severity, title, columns FROM h ORDER BY id LIMIT 16""")
def highlights_events(d: Data):
    return W.highlights(event_results(d), EVENTS).select("id", "kind", "severity", "title", F.concat_ws(",", "columns").alias("columns"))


@query("hypotheses_events", f"""
WITH v AS ({EVENT_VALUES}), o AS ({EVENT_OUTLIERS}),
p AS (SELECT *, max(med) OVER () / nullif(min(med) OVER (), 0) AS ratio FROM {profiles_sql('events', 'event_type', 'value')}),
h AS (
  SELECT 10 AS place, 'geo_outlier' AS kind, 'props: values outside the core area' AS title, 'props' AS columns, 'high' AS priority
  WHERE EXISTS (FROM v WHERE column_name = 'props' AND NOT in_core)
  UNION ALL SELECT 11, 'concentration', 'Concentration of event_type', 'event_type', 'medium' WHERE EXISTS (FROM v WHERE column_name = 'event_type' AND NOT in_core)
  UNION ALL SELECT 30, 'numeric_outlier', 'Outliers of value distort its mean', 'value', 'high' FROM o
  UNION ALL SELECT 40, 'implausible', 'Suspicious scale of value', 'value', 'high' WHERE EXISTS (FROM events WHERE value < 0)
  UNION ALL SELECT 50, 'rare_category', 'Rare values of event_type', 'event_type', 'medium'
  WHERE EXISTS (FROM v WHERE column_name = 'event_type' AND NOT in_core AND flags LIKE '%rare%')
  UNION ALL SELECT 60, 'group_difference', 'event_type determines the level of value', 'event_type,value', 'high' WHERE EXISTS (FROM p WHERE ratio >= 1.8))
SELECT row_number() OVER (ORDER BY place) AS id, kind, title, columns, priority, 'rules' AS source FROM h ORDER BY id LIMIT 14""")
def hypotheses_events(d: Data):
    results = event_results(d)
    results["group_ranges"] = C.median_ranges(C.group_profiles(d.events, ["event_type"], ["value"]))
    found = W.hypotheses(results, EVENTS)
    return found.select("id", "kind", "title", F.concat_ws(",", "columns").alias("columns"), "priority", "source")


@query("relation_hypotheses", f"""{LINKS_SQL}
SELECT row_number() OVER (ORDER BY score DESC, lt, lc, rt, rc) AS id, 'table_relation' AS kind, 'Key ' || lt || '.' || lc || ' = ' || rt || '.' || rc AS title,
  lc || ',' || rc AS columns, CASE WHEN round(score, 4) >= 0.7 THEN 'high' ELSE 'medium' END AS priority FROM links QUALIFY id <= 6""")
def relation_hypotheses(d: Data):
    found = W.relation_hypotheses(J.relations(d.tables(*LINKED)))
    return found.select("id", "kind", "title", F.concat_ws(",", "columns").alias("columns"), "priority")


@query("relation_counts", f"""{LINKS_SQL}
SELECT 'join' AS kind, count(*) AS n, {r('CAST(max(score) AS DOUBLE)', 'best_score')} FROM links""")
def relation_counts(d: Data):
    return J.relation_counts(J.join_links(d.tables(*LINKED)))


@query("recommendations_documents", f"""
WITH s AS ({summary_sql('documents', LABELLED, LABELLED_SCHEMA)}),
c AS ({union(f"SELECT '{c}' AS c, {i} AS i, count({c}) AS n, count(*) AS rows FROM {LABELLED}" for i, c in enumerate(LABELLED_SCHEMA))}),
t AS (SELECT 1 AS o, 'sparse_column' AS code, c || ': ' || n || '/' || rows || ' filled' AS detail FROM (SELECT * FROM c WHERE n < rows * 0.7 ORDER BY i LIMIT 1)
  UNION ALL SELECT 2, 'duplicate_rows', duplicate_pct || ' % of rows are duplicates' FROM s WHERE duplicate_pct > 5
  UNION ALL SELECT 3, 'low_quality', 'Treat conclusions with care until the data are cleaned' FROM s WHERE score < 50
  UNION ALL SELECT 4, 'check_missing', 'Check columns with many gaps: fill or drop them'
  UNION ALL SELECT 5, 'compare_distributions', 'Compare distributions of numbers with outliers on box plots'
  UNION ALL SELECT 6, 'group_rare', 'Group rare values of categories with many levels'
  UNION ALL SELECT 7, 'select_features', 'With many columns, select the key ones' FROM s WHERE columns > 20)
SELECT 'documents' AS table_id, row_number() OVER (ORDER BY o) AS place, code, detail FROM t QUALIFY place <= 6""")
def recommendations_documents(d: Data):
    table = Table("documents", "documents", labelled(d))
    columns = L.quality_columns(K.structure(table))
    summary = L.quality_summary(columns, L.table_duplicates(table))
    counts = columns.select("table_id", "column", "ordinal", F.col("non_null").alias("count"))
    return W.recommendations(summary, counts)


def skipped_sql(table: str) -> str:
    rules = (("associations", None, 40), ("concentration", 3, 400), ("group_profiles", 2, 80), ("category_counts", 2, 25))
    return union(f"""
SELECT table_id, column_name, '{name}' AS analysis, nunique AS levels, CAST({'NULL' if low is None else low} AS BIGINT) AS least, CAST({high} AS BIGINT) AS most,
  CASE WHEN nunique > {high} THEN 'too many levels' ELSE 'too few levels' END AS reason
FROM ({structure_sql(table)}) WHERE kind IN ('categorical', 'boolean') AND (nunique > {high} OR nunique < {0 if low is None else low})""" for name, low, high in rules)


@query("skipped_columns", union(f"SELECT * FROM ({skipped_sql(t)})" for t in ("part", "lineitem", "customer", "documents")))
def skipped_columns(d: Data):
    return L.skipped_columns(K.structures(d.tables("part", "lineitem", "customer", "documents"))).withColumnRenamed("column", "column_name")


@query("profile_customers", union(f"SELECT * FROM ({quality_sql(t, t, SCHEMA[t])})" for t in ("nation", "customer")))
def profile_customers(d: Data):
    """The quality of the columns of two tables, as the whole chain gives it."""
    return quality_rows(profile(d.tables("nation", "customer"))["quality_columns"])


def chart_plan_sql(table: str, numbers, groups, weights: str) -> str:
    """``weights``: SQL for (column_name, kind, importance); pairs are taken in the order of their strength."""
    pairs = list(combinations(numbers, 2))
    both = list(combinations(groups, 2))
    return f"""
WITH w AS (SELECT * FROM ({weights}) WHERE importance > 0),
num AS (SELECT *, row_number() OVER (ORDER BY importance DESC, column_name) AS i FROM w WHERE kind = 'numeric'),
cat AS (SELECT *, row_number() OVER (ORDER BY importance DESC, column_name) AS i FROM w WHERE kind IN ('categorical', 'boolean')),
day AS (SELECT *, row_number() OVER (ORDER BY importance DESC, column_name) AS i FROM w WHERE kind = 'datetime'),
p AS (SELECT *, row_number() OVER (ORDER BY round(abs(s), 4) DESC, col_a, col_b) AS i FROM ({pearson_sql(table, pairs)}) WHERE round(abs(s), 12) >= 0.4),
e AS (SELECT *, row_number() OVER (ORDER BY round(abs(s), 4) DESC, col_a, col_b) AS i FROM ({eta_sql(table, groups, numbers)}) WHERE round(abs(s), 12) >= 0.3),
v AS (SELECT *, row_number() OVER (ORDER BY round(abs(s), 4) DESC, col_a, col_b) AS i FROM ({cramers_sql(table, both)}) WHERE round(abs(s), 12) >= 0.3),
c AS (SELECT 1 AS o, 1 AS i, 'heatmap' AS kind, string_agg(column_name, ',' ORDER BY i) AS columns, 98.0 AS score FROM num HAVING count(*) >= 3
  UNION ALL SELECT 2, i, 'scatter', col_a || ',' || col_b, 70 + least(28, abs(s) * 35) FROM p WHERE i <= 3
  UNION ALL SELECT 3, i, 'mean_bar', col_a || ',' || col_b, 75 + least(22, s * 40) FROM e WHERE i <= 4
  UNION ALL SELECT 4, i, 'box', col_a || ',' || col_b, 63 + least(20, s * 30) FROM e WHERE i <= 6
  UNION ALL SELECT 5, 1, 'series', day.column_name || ',' || num.column_name, 72 + 0.2 * num.importance FROM day, num WHERE day.i = 1 AND num.i = 1
  UNION ALL SELECT 6, i, 'count', column_name, 55 + 0.5 * importance FROM cat WHERE i <= 4
  UNION ALL SELECT 7, i, 'histogram', column_name, 48 + 0.4 * importance FROM num WHERE i <= 2
  UNION ALL SELECT 9, i, 'crosstab', col_a || ',' || col_b, 60 + least(18, s * 30) FROM v WHERE i <= 3)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, o, i) AS rank, kind, columns, {r('score', 'score')} FROM c QUALIFY rank <= 20"""


def planned(d: Data, name: str, numbers):
    table = d.table(name)
    described = K.structure(table)
    facts = K.collect_facts(described)[name]
    importance = G.column_importance(described, M.moments(Q.number_rows(table.df, numbers)))
    plan = V.chart_plan(importance, A.associations(table.df, facts), G.missing_counts(table.df))
    return plan.withColumn("columns", F.concat_ws(",", "columns"))


PLANNED_GROUPS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]


@query("chart_plan_lineitem", chart_plan_sql(
    "lineitem", [c for c in NUMERIC_LINE if c not in PLANNED_GROUPS], PLANNED_GROUPS, ORACLES["column_importance_lineitem"]))
def chart_plan_lineitem(d: Data):
    return planned(d, "lineitem", NUMERIC_LINE)
