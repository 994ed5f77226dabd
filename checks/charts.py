"""Chart aggregates and caption numbers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gleanframe.functions.names import BUSINESS_WORDS, UNCHARTED_WORDS
from gleanframe.operators import charts as G, concentration as C, metrics as M, structure as K

from .base import LINE_NUMBERS, labelled, structure_sql
from .findings import PRICES, PAIRS, concentration_sql, pearson_sql
from .registry import Data, query, r, union


@query("chart_heatmap", f"""
SELECT col_a, col_b, {r('s', 'stat')} FROM ({pearson_sql('lineitem', [(a, b) for a in LINE_NUMBERS for b in LINE_NUMBERS])})""")
def chart_heatmap(d: Data):
    return G.heatmap(d.lineitem, LINE_NUMBERS)


def trend_sql(table: str, pairs) -> str:
    return union(f"""SELECT '{a}' AS col_x, '{b}' AS col_y, CAST(regr_count({b}, {a}) AS BIGINT) AS n, {r(f'regr_slope({b}, {a})', 'slope')},
  {r(f'regr_intercept({b}, {a})', 'intercept')}, {r(f'corr({b}, {a})', 'r')} FROM {table}""" for a, b in pairs)


@query("chart_scatter_trend", trend_sql("lineitem", [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]))
def chart_scatter_trend(d: Data):
    return G.scatter_trend(d.lineitem, [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])


@query("chart_scatter_points", f"SELECT {r('l_quantity', 'x')}, {r('l_extendedprice', 'y')} FROM lineitem")
def chart_scatter_points(d: Data):
    return G.scatter_points(d.lineitem, "l_quantity", "l_extendedprice")


@query("chart_mean_bars", f"""
WITH g AS (SELECT p_brand AS grp, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1 ORDER BY n DESC, grp LIMIT 10)
SELECT grp AS "group", n, {r('m', 'mean')} FROM g""")
def chart_mean_bars(d: Data):
    return G.mean_by_category(d.part, "p_brand", "p_retailprice")


def box_sql(source: str, category: str, number: str, top: int) -> str:
    return f"""
WITH v AS (SELECT CAST({category} AS VARCHAR) AS g, CAST({number} AS DOUBLE) AS x FROM {source} WHERE {category} IS NOT NULL AND {number} IS NOT NULL),
t AS (SELECT g FROM v GROUP BY g ORDER BY count(*) DESC, g LIMIT {top}),
q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM v JOIN t USING (g) GROUP BY g),
w AS (SELECT v.g, x, q1, q2, q3, x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) AS ok FROM v JOIN q USING (g))
SELECT g AS "group", count(*) AS n, {r('any_value(q1)', 'q1')}, {r('any_value(q2)', 'median')}, {r('any_value(q3)', 'q3')},
  {r('min(CASE WHEN ok THEN x END)', 'low')}, {r('max(CASE WHEN ok THEN x END)', 'high')}, count(CASE WHEN NOT ok THEN 1 END) AS fliers FROM w GROUP BY g"""


@query("chart_boxes_events", box_sql("events", "event_type", "value", 8))
def chart_boxes_events(d: Data):
    return G.box_stats(d.events, "event_type", "value")


@query("chart_outlier_box", box_sql("(SELECT 'value' AS g0, value FROM events)", "g0", "value", 8))
def chart_outlier_box(d: Data):
    return G.box_stats(d.events, None, "value")


def series_sql(source: str, date: str, number: str) -> str:
    return f"""
WITH v AS (SELECT CAST({date} AS DATE) AS day, {date} AS t, CAST({number} AS DOUBLE) AS x FROM {source} WHERE {date} IS NOT NULL AND {number} IS NOT NULL),
f AS (SELECT count(DISTINCT t) > 60 AS weekly, count(*) AS rows FROM v),
p AS (SELECT CASE WHEN weekly THEN day + CAST((7 - isodow(day)) AS INTEGER) ELSE last_day(day) END AS period, x, weekly FROM v, f),
g AS (SELECT period, count(*) AS n, avg(x) AS m FROM p GROUP BY period),
b AS (SELECT min(period) AS a, max(period) AS z, any_value(weekly) AS weekly FROM p),
cal AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS period FROM b WHERE weekly
  UNION ALL SELECT last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)) AS DATE)) FROM b WHERE NOT weekly)
SELECT strftime(cal.period, '%Y-%m-%d') AS period, CAST(coalesce(n, 0) AS BIGINT) AS n, {r('m', 'mean')} FROM cal LEFT JOIN g ON cal.period = g.period"""


def series_rows(df):
    return df.withColumn("period", F.col("period").cast("string"))


@query("chart_series_events", series_sql("events", "ts", "value"))
def chart_series_events(d: Data):
    return series_rows(G.time_series(d.events, "ts", "value"))


FEW_DAYS = "(SELECT * REPLACE (CASE WHEN day(o_orderdate) = 15 AND month(o_orderdate) IN (1, 6) THEN o_orderdate END AS o_orderdate) FROM orders)"


@query("chart_series_months", series_sql(FEW_DAYS, "o_orderdate", "o_totalprice"))
def chart_series_months(d: Data):
    chosen = (F.dayofmonth("o_orderdate") == 15) & F.month("o_orderdate").isin(1, 6)
    few = d.orders.withColumn("o_orderdate", F.when(chosen, F.col("o_orderdate")))
    return series_rows(G.time_series(few, "o_orderdate", "o_totalprice"))


def split_sql(table: str, date: str, number: str) -> str:
    return f"""
WITH v AS (SELECT {number} AS x, row_number() OVER (ORDER BY {date}, {number}) AS i, count(*) OVER () AS n FROM {table} WHERE {date} IS NOT NULL AND {number} IS NOT NULL),
s AS (SELECT any_value(n) AS n, avg(CASE WHEN i <= n // 2 THEN x END) AS a, avg(CASE WHEN i > n // 2 THEN x END) AS b FROM v)
SELECT n, {r('a', 'first_mean')}, {r('b', 'second_mean')}, CASE WHEN b > a * 1.05 THEN 'up' WHEN b < a * 0.95 THEN 'down' ELSE 'flat' END AS trend FROM s"""


@query("trend_halves_orders", split_sql("orders", "o_orderdate", "o_totalprice"))
def trend_halves_orders(d: Data):
    return G.split_trend(d.orders, "o_orderdate", "o_totalprice")


@query("trend_halves_events", split_sql("events", "ts", "value"))
def trend_halves_events(d: Data):
    return G.split_trend(d.events, "ts", "value")


@query("chart_category_counts", union(f"""
(SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c} AS value, count(*) AS n
FROM {t} GROUP BY {c} QUALIFY rank <= 12)""" for t, c in (("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"))))
def chart_category_counts(d: Data):
    counts = G.category_counts(d.lineitem, ["l_returnflag", "l_linestatus", "l_partkey"])
    return counts.withColumnRenamed("column", "column_name")


def histogram_sql(table: str, column: str) -> str:
    return f"""
(WITH v AS (SELECT CAST({column} AS DOUBLE) AS x FROM {table} WHERE {column} IS NOT NULL),
s AS (SELECT min(x) AS lo, max(x) AS hi, CAST(least(25, greatest(8, count(DISTINCT x) // 3)) AS INTEGER) AS bins FROM v HAVING count(*) >= 5 AND count(DISTINCT x) >= 3),
b AS (SELECT unnest(range(0, bins)) AS bin, lo, hi, bins FROM s),
c AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * bins), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM v, s GROUP BY 1)
SELECT '{column}' AS column_name, CAST(b.bin AS INTEGER) AS bin, {r('lo + b.bin * ((hi - lo) / bins)', 'low')}, {r('lo + (b.bin + 1) * ((hi - lo) / bins)', 'high')},
  CAST(coalesce(n, 0) AS BIGINT) AS n FROM b LEFT JOIN c ON b.bin = c.bin)"""


@query("chart_histograms_lineitem", union(f"SELECT * FROM {histogram_sql('lineitem', c)}" for c in ("l_extendedprice", "l_quantity", "l_tax")))
def chart_histograms_lineitem(d: Data):
    return G.histogram(d.lineitem, ["l_extendedprice", "l_quantity", "l_tax"]).withColumnRenamed("column", "column_name")


@query("chart_histogram_events", f"SELECT * FROM {histogram_sql('events', 'value')}")
def chart_histogram_events(d: Data):
    return G.histogram(d.events, ["value"]).withColumnRenamed("column", "column_name")


@query("chart_missing_documents", union(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM (SELECT quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
    for c in ("quality", "toxic")))
def chart_missing_documents(d: Data):
    return G.missing_counts(labelled(d)).withColumnRenamed("column", "column_name")


@query("chart_crosstab_part", """
WITH a AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 6), b AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 6)
SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part WHERE p_brand IN (FROM a) AND p_type IN (FROM b) GROUP BY ALL""")
def chart_crosstab_part(d: Data):
    return G.crosstab(d.part, "p_brand", "p_type")


@query("chart_core_bars_part", f"SELECT column_name, value, count, in_core FROM {concentration_sql('part', 'p_name')} WHERE rank <= 20")
def chart_core_bars_part(d: Data):
    return G.core_bars(C.concentration_values(d.part, ["p_name"])).withColumnRenamed("column", "column_name")


def medians_sql(source: str, category: str, number: str) -> str:
    return f"""(SELECT CAST({category} AS VARCHAR) AS g, count(*) AS n, quantile_cont({number}, 0.5) AS med FROM {source}
  WHERE {category} IS NOT NULL AND {number} IS NOT NULL GROUP BY 1)"""


@query("chart_median_by_segment", f"""
SELECT g AS "group", n, {r('med', 'median')} FROM (SELECT * FROM {medians_sql('customer', 'c_mktsegment', 'c_acctbal')} ORDER BY med DESC, g LIMIT 16)""")
def chart_median_by_segment(d: Data):
    return G.median_by_group(d.customer, "c_mktsegment", "c_acctbal")


@query("chart_median_ratio_by_brand", f"""
SELECT g AS "group", n, {r('med', 'median')} FROM (
  SELECT * FROM {medians_sql('(SELECT l_returnflag, l_extendedprice / nullif(l_quantity, 0) AS ratio FROM lineitem)', 'l_returnflag', 'ratio')} ORDER BY med DESC, g LIMIT 16)""")
def chart_median_ratio_by_brand(d: Data):
    from gleanframe.operators.derived import with_ratios

    df, pairs = with_ratios(d.lineitem, PRICES)
    return G.median_by_group(df, "l_returnflag", next(iter(pairs)))


def _mentioned(words) -> str:
    return "(" + " OR ".join(f"column_name LIKE '%{w}%'" for w in words if w.isascii()) + ")"


NUMERIC_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_importance_lineitem", f"""
WITH s AS ({structure_sql('lineitem')}),
m AS ({union(f"SELECT '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}) AS std FROM lineitem" for c in NUMERIC_LINE)}),
j AS (SELECT s.*, mean, std FROM s LEFT JOIN m USING (column_name))
SELECT table_id, column_name, kind, {r('''CASE WHEN useless THEN 0.0 ELSE 10.0 + CASE WHEN business THEN 35.0 ELSE 0.0 END
    + CASE WHEN kind = 'categorical' AND nunique BETWEEN 2 AND 12 THEN 20.0 WHEN kind = 'categorical' AND nunique <= 20 THEN 10.0 ELSE 0.0 END
    + CASE WHEN kind = 'numeric' THEN CASE WHEN abs(mean) > 1e-9 THEN least(25.0, std / abs(mean) * 15.0) WHEN std > 0 THEN 10.0 ELSE 0.0 END ELSE 0.0 END
    + CASE WHEN kind = 'datetime' THEN 15.0 ELSE 0.0 END END''', 'importance')}
FROM (SELECT *, {_mentioned(BUSINESS_WORDS)} AS business, {_mentioned(UNCHARTED_WORDS)} OR kind = 'identifier' OR nunique <= 1
  OR (kind = 'categorical' AND nunique > 25) OR (kind = 'numeric' AND nunique >= 0.95 * non_null) AS useless FROM j)""")
def column_importance_lineitem(d: Data):
    from gleanframe.operators.frequency import number_rows

    described = K.structure(d.table("lineitem"))
    spread = M.moments(number_rows(d.lineitem, NUMERIC_LINE))
    return G.column_importance(described, spread).withColumnRenamed("column", "column_name")


@query("caption_extremes_part", f"""
WITH g AS (SELECT p_brand AS g, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1), t AS (SELECT * FROM g ORDER BY n DESC, g LIMIT 10)
SELECT (SELECT g FROM t ORDER BY m DESC, g LIMIT 1) AS best, {r('max(m)', 'best_mean')}, {r('min(m)', 'worst_mean')}, (SELECT g FROM g ORDER BY m, g LIMIT 1) AS worst FROM t""")
def caption_extremes_part(d: Data):
    return G.caption_extremes(d.part, "p_brand", "p_retailprice")


@query("caption_medians_customer", f"""
WITH m AS (SELECT * FROM {medians_sql('customer', 'c_mktsegment', 'c_acctbal')})
SELECT (SELECT g FROM m ORDER BY med DESC, g LIMIT 1) AS best, (SELECT g FROM m ORDER BY med, g LIMIT 1) AS worst""")
def caption_medians_customer(d: Data):
    return G.caption_medians(d.customer, "c_mktsegment", "c_acctbal")


@query("caption_counts_orders", union(f"""
(SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM orders) AS categories, {c} AS top, count(*) AS top_n, {r('100.0 * count(*) / (SELECT count(*) FROM orders)', 'share_pct')}
FROM orders GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)""" for c in ("o_orderstatus", "o_orderpriority")))
def caption_counts_orders(d: Data):
    return G.caption_counts(d.orders, ["o_orderstatus", "o_orderpriority"]).withColumnRenamed("column", "column_name")


@query("caption_shapes", union(f"""
SELECT '{c}' AS column_name, {r(f'avg({c})', 'mean')}, {r(f'CAST(quantile_cont({c}, 0.5) AS DOUBLE)', 'median')}, {r(f'stddev_samp({c})', 'std')},
  CASE WHEN abs(avg({c}) - quantile_cont({c}, 0.5)) < 0.15 * stddev_samp({c}) THEN 'symmetric' WHEN avg({c}) > quantile_cont({c}, 0.5) THEN 'right' ELSE 'left' END AS shape
FROM events""" for c in ("value", "user_id")))
def caption_shapes(d: Data):
    return G.caption_shape(d.events, ["value", "user_id"]).withColumnRenamed("column", "column_name")


@query("caption_missing_documents", f"""
WITH g AS ({union(f"SELECT '{c}' AS c, {i} AS i, count(*) AS rows, count(*) - count({c}) AS m FROM (SELECT quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)" for i, c in enumerate(('quality', 'toxic')))})
SELECT count(*) AS columns_with_gaps, (SELECT c FROM g ORDER BY m DESC, i LIMIT 1) AS worst, max(m) AS worst_missing, {r('max(100.0 * m / rows)', 'worst_pct')} FROM g WHERE m > 0""")
def caption_missing_documents(d: Data):
    return G.caption_missing(labelled(d))
