"""Associations, rank tests, anomalies, concentration, groups, relations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gleanframe.functions import names as N
from gleanframe.operators import (
    anomalies as X, associations as A, concentration as C, derived as D, frequency as Q, rank_tests as R,
    relations as J,
)
from gleanframe.operators.structure import Roles

from .base import LINE_NUMBERS, SCHEMA, labelled, structure_sql
from .registry import TABLES, Data, query, r, union

# --- associations ------------------------------------------------------------

PAIRS = list(combinations(LINE_NUMBERS, 2))


def pearson_sql(table: str, pairs) -> str:
    return union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({b}, {a}) AS s, regr_count({b}, {a}) AS n FROM {table}"
                 for a, b in pairs)


@query("pearson_lineitem", f"SELECT col_a, col_b, {r('s', 'stat')}, CAST(n AS BIGINT) AS n FROM ({pearson_sql('lineitem', PAIRS)})")
def pearson_lineitem(d: Data):
    return A.pearson(d.lineitem, LINE_NUMBERS)


@query("correlation_matrix_lineitem", f"""
SELECT col_a, col_b, {r('s', 'stat')} FROM ({pearson_sql('lineitem', [(a, b) for a in LINE_NUMBERS for b in LINE_NUMBERS])})""")
def correlation_matrix_lineitem(d: Data):
    return A.correlation_matrix(d.lineitem, LINE_NUMBERS)


def cramers_sql(source: str, pairs) -> str:
    parts = []
    for a, b in pairs:
        parts.append(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, sqrt(sum(n) * (sum(n * n / (ra * cb)) - 1) / (sum(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))) AS s,
  CAST(sum(n) AS BIGINT) AS n
FROM (SELECT a, b, CAST(n AS DOUBLE) AS n, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb
      FROM (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL))""")
    return union(parts)


LINE_GROUPS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("cramers_v_lineitem", f"SELECT col_a, col_b, {r('s', 'stat')}, n FROM ({cramers_sql('lineitem', list(combinations(LINE_GROUPS, 2)))})")
def cramers_v_lineitem(d: Data):
    return A.cramers_v(d.lineitem, LINE_GROUPS)


DOC_GROUPS = "(SELECT d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("cramers_v_documents", f"""
SELECT col_a, col_b, {r('s', 'stat')}, n FROM ({cramers_sql(DOC_GROUPS, list(combinations(['lang', 'quality', 'toxic'], 2)))})""")
def cramers_v_documents(d: Data):
    return A.cramers_v(labelled(d), ["lang", "quality", "toxic"])


@query("chi_square_lineitem", f"""
SELECT a AS col_a, b AS col_b, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT l_returnflag) AS levels_a, count(DISTINCT l_linenumber) AS levels_b, {r('sum((n - e) * (n - e) / e)', 'chi2')}
FROM (SELECT 'l_returnflag' AS a, 'l_linenumber' AS b, l_returnflag, l_linenumber, n,
        sum(n) OVER (PARTITION BY l_returnflag) * sum(n) OVER (PARTITION BY l_linenumber) / sum(n) OVER () AS e
      FROM (SELECT l_returnflag, l_linenumber, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL)) GROUP BY ALL""")
def chi_square_lineitem(d: Data):
    return A.chi_square(Q.contingency(d.lineitem, [("l_returnflag", "l_linenumber")]))


def eta_sql(source: str, categories, numbers) -> str:
    parts = []
    for c in categories:
        for x in numbers:
            parts.append(f"""
SELECT '{c}' AS col_a, '{x}' AS col_b, sqrt(sum(n * (m - gm) * (m - gm)) / max(st)) AS s, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT g, CAST(count(*) AS DOUBLE) AS n, avg(x) AS m, max(gm) AS gm, max(st) AS st
      FROM (SELECT coalesce(CAST({c} AS VARCHAR), 'nan') AS g, {x} AS x FROM {source} WHERE {x} IS NOT NULL),
           (SELECT avg({x}) AS gm, var_pop({x}) * count({x}) AS st FROM {source}) GROUP BY g)""")
    return union(parts)


@query("correlation_ratio_lineitem", f"SELECT col_a, col_b, {r('s', 'stat')}, n FROM ({eta_sql('lineitem', LINE_GROUPS, LINE_NUMBERS)})")
def correlation_ratio_lineitem(d: Data):
    return A.correlation_ratio(d.lineitem, LINE_GROUPS, LINE_NUMBERS)


@query("correlation_ratio_gaps", f"""
SELECT col_a, col_b, {r('s', 'stat')}, n
FROM ({eta_sql('(SELECT d.n_chars, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)', ['lang', 'quality'], ['n_chars'])})""")
def correlation_ratio_gaps(d: Data):
    return A.correlation_ratio(labelled(d), ["lang", "quality"], ["n_chars"])


@query("notable_associations", f"""
WITH p AS (SELECT 'pearson' AS type, *, 0.7 AS hi, 0.4 AS mid, 15 AS top FROM ({pearson_sql('lineitem', PAIRS)})
  UNION ALL SELECT 'cramers_v', *, 0.5, 0.3, 10 FROM ({cramers_sql('lineitem', list(combinations(LINE_GROUPS, 2)))})
  UNION ALL SELECT 'eta', *, 0.5, 0.3, 10 FROM ({eta_sql('lineitem', LINE_GROUPS, LINE_NUMBERS)})),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY round(abs(s), 4) DESC, col_a, col_b) AS rank FROM p WHERE abs(s) >= mid)
SELECT type, col_a, col_b, {r('s', 'stat')}, CAST(n AS BIGINT) AS n, CASE WHEN abs(s) >= hi THEN 'strong' ELSE 'moderate' END AS strength,
  CASE WHEN type = 'pearson' THEN CASE WHEN s > 0 THEN 'positive' ELSE 'negative' END END AS direction, rank
FROM k WHERE rank <= top""")
def notable_associations(d: Data):
    df = d.lineitem
    return (
        A.graded(A.pearson(df, LINE_NUMBERS), "pearson", 0.7, 0.4, 15)
        .unionByName(A.graded(A.cramers_v(df, LINE_GROUPS), "cramers_v", 0.5, 0.3, 10))
        .unionByName(A.graded(A.correlation_ratio(df, LINE_GROUPS, LINE_NUMBERS), "eta", 0.5, 0.3, 10))
    )


# --- rank tests --------------------------------------------------------------

def rank_sql(column: str, source: str) -> str:
    return (f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0")


@query("average_ranks_price", f"""
SELECT {r('x', 'x')}, n, {r('a', 'avg_rank')} FROM (
  SELECT x, n, sum(n) OVER (ORDER BY x) - n + (n + 1) / 2.0 AS a FROM (SELECT l_extendedprice AS x, count(*) AS n FROM lineitem GROUP BY 1))""")
def average_ranks_price(d: Data):
    return R.ranks(d.lineitem, "l_extendedprice")


@query("spearman_quantity_price", f"""
SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, {r('corr(b, a)', 'stat')}, count(*) AS n FROM (
  SELECT {rank_sql('l_quantity', 'lineitem')} AS a, {rank_sql('l_extendedprice', 'lineitem')} AS b FROM lineitem)""")
def spearman_quantity_price(d: Data):
    return R.spearman(d.lineitem, "l_quantity", "l_extendedprice")


def kruskal_sql(table: str, category: str, number: str) -> str:
    return f"""
SELECT '{category}' AS col_a, '{number}' AS col_b, 12.0 / (t * (t + 1.0)) * sum(n * m * m) - 3.0 * (t + 1.0) AS s, CAST(t AS BIGINT) AS n FROM (
  SELECT {category}, CAST(count(*) AS DOUBLE) AS n, avg(rk) AS m, max(t) AS t FROM (
    SELECT {category}, {rank_sql(number, table)} AS rk, CAST(count(*) OVER () AS DOUBLE) AS t FROM {table}
    WHERE {category} IS NOT NULL AND {number} IS NOT NULL) GROUP BY {category}) GROUP BY t"""


@query("kruskal_flag_price", f"SELECT col_a, col_b, {r('s', 'stat')}, n FROM ({kruskal_sql('lineitem', 'l_returnflag', 'l_extendedprice')})")
def kruskal_flag_price(d: Data):
    return R.kruskal(d.lineitem, ["l_returnflag"], ["l_extendedprice"])


@query("rank_tests_orders", f"""
SELECT 'kruskal' AS type, k.col_a, k.col_b, {r('k.s', 'stat')}, {r('e.s', 'eta')}, k.n
FROM ({union(kruskal_sql('orders', c, 'o_totalprice') for c in ('o_orderstatus', 'o_orderpriority'))}) k
JOIN ({eta_sql('orders', ['o_orderstatus', 'o_orderpriority'], ['o_totalprice'])}) e ON k.col_a = e.col_a AND k.col_b = e.col_b""")
def rank_tests_orders(d: Data):
    groups = ("o_orderstatus", "o_orderpriority")
    eta = A.correlation_ratio(d.orders, groups, ["o_totalprice"]).withColumn("type", F.lit("eta"))
    return R.rank_tests(d.orders, Roles(geo=groups, money=("o_totalprice",)), eta)


# --- derived metrics and anomalies -------------------------------------------

PRICES = Roles(money=("l_extendedprice",), area=("l_quantity",), numeric=("l_extendedprice", "l_quantity", "l_discount"))


@query("derived_unit_price", f"""
SELECT 'l_extendedprice / l_quantity' AS name, 'l_extendedprice' AS numerator, 'l_quantity' AS denominator, count(x) AS count,
  {r('avg(x)', 'mean')}, {r('quantile_cont(x, 0.5)', 'median')}, {r('min(x)', 'min')}, {r('max(x)', 'max')}, {r('quantile_cont(x, 0.9)', 'p90')}
FROM (SELECT l_extendedprice / nullif(l_quantity, 0) AS x FROM lineitem)""")
def derived_unit_price(d: Data):
    df, pairs = D.with_ratios(d.lineitem, PRICES)
    return D.ratio_summary(df, pairs)


def outliers_sql(table: str, column: str) -> str:
    """The rows of one column with its bounds and flags."""
    return f"""
WITH v AS (SELECT CAST({column} AS DOUBLE) AS x FROM {table} WHERE {column} IS NOT NULL),
q AS (SELECT count(*) AS n, count(DISTINCT x) AS nu, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3,
      min(x) AS mn, max(x) AS mx, avg(x) AS av, (SELECT count(*) FROM {table}) AS rows FROM v),
m AS (SELECT CASE WHEN max(nu) >= 40 THEN quantile_cont(abs(x - med), 0.5) END AS mad FROM v, q),
f AS (SELECT x, q.*, mad, q3 - q1 > 0 AS ok, q3 - q1 > 0 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS near,
      q3 - q1 > 0 AND (x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1)) AS far,
      coalesce(mad > 0 AND abs(0.6745 * (x - med) / nullif(mad, 0)) > 3.5, false) AS z FROM v, q, m WHERE n >= 8 AND nu >= 4),
w AS (SELECT *, (SELECT count(*) FROM f WHERE near) > 0.12 * rows AS wide FROM f),
flagged AS (SELECT * FROM w WHERE CASE WHEN wide THEN far OR z ELSE near OR z END)"""


def outlier_summary_sql(table: str, column: str) -> str:
    fence = "CASE WHEN any_value(wide) THEN 3.0 ELSE 1.5 END"
    return f"""({outliers_sql(table, column)}
SELECT '{column}' AS column_name, count(*) AS n_outliers, {r('100.0 * count(*) / any_value(rows)', 'pct')},
  CAST(CASE WHEN any_value(ok) THEN {fence} END AS DOUBLE) AS fence,
  {r(f'CASE WHEN any_value(ok) THEN any_value(q1) - {fence} * (any_value(q3) - any_value(q1)) END', 'lower')},
  {r(f'CASE WHEN any_value(ok) THEN any_value(q3) + {fence} * (any_value(q3) - any_value(q1)) END', 'upper')},
  {r('any_value(mn)', 'min')}, {r('any_value(mx)', 'max')}, {r('any_value(med)', 'median')}, {r('any_value(av)', 'mean')}
FROM flagged HAVING count(*) > 0)"""


@query("outliers_events", outlier_summary_sql("events", "value"))
def outliers_events(d: Data):
    return X.numeric_outliers(d.events, ["value"]).drop("mad").withColumnRenamed("column", "column_name")


@query("outliers_documents", outlier_summary_sql("documents", "n_chars"))
def outliers_documents(d: Data):
    return X.numeric_outliers(d.documents, ["n_chars"]).drop("mad").withColumnRenamed("column", "column_name")


CUBED = "(SELECT l_quantity * l_quantity * l_quantity * l_quantity * l_quantity AS fifth, l_tax, l_quantity FROM lineitem)"


@query("outliers_lineitem", union(outlier_summary_sql(CUBED, c) for c in ("fifth", "l_tax", "l_quantity")))
def outliers_lineitem(d: Data):
    q = F.col("l_quantity")
    df = d.lineitem.select((q * q * q * q * q).alias("fifth"), "l_tax", "l_quantity")
    return X.numeric_outliers(df, df.columns).drop("mad").withColumnRenamed("column", "column_name")


@query("outlier_examples_events", f"""{outliers_sql('events', 'value')}
SELECT 'value' AS column_name, rank, {r('x', 'value')}, n AS count FROM (
  SELECT x, n, row_number() OVER (ORDER BY n DESC, x) AS rank FROM (SELECT x, count(*) AS n FROM flagged GROUP BY x)) WHERE rank <= 8""")
def outlier_examples_events(d: Data):
    found = X.numeric_outliers(d.events, ["value"])
    return X.outlier_examples(d.events, found, ["value"]).withColumnRenamed("column", "column_name")


@query("implausible_accounts", union(f"""
SELECT '{c}' AS column_name, 'negative' AS issue, count(*) AS count, {r(f'100.0 * count(*) / (SELECT count(*) FROM {t})', 'pct')}, CAST(NULL AS VARCHAR) AS detail
FROM {t} WHERE {c} < 0 HAVING count(*) > 0""" for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))))
def implausible_accounts(d: Data):
    a = X.implausible(d.customer, Roles(money=("c_acctbal",), numeric=("c_acctbal",)))
    b = X.implausible(d.supplier, Roles(money=("s_acctbal",)))
    return a.unionByName(b).withColumnRenamed("column", "column_name")


@query("implausible_lineitem", f"""
WITH t AS (SELECT count(*) AS rows FROM lineitem),
f AS (SELECT 'l_tax' AS column_name, 'zero' AS issue, count(*) AS count FROM lineitem WHERE l_tax = 0 HAVING count(*) > 0
  UNION ALL SELECT 'l_discount', 'zero', count(*) FROM lineitem WHERE l_discount = 0 HAVING count(*) > 0
  UNION ALL SELECT 'l_linenumber', 'tiny_area', count(*) FROM lineitem WHERE l_linenumber = 1
            HAVING count(*) >= greatest(10, 0.08 * (SELECT rows FROM t)))
SELECT column_name, issue, count, {r('100.0 * count / rows', 'pct')}, CAST(NULL AS VARCHAR) AS detail FROM f, t""")
def implausible_lineitem(d: Data):
    return X.implausible(d.lineitem, Roles(money=("l_tax", "l_discount"), area=("l_linenumber",))).withColumnRenamed(
        "column", "column_name")


SKEWED = ("(SELECT CASE WHEN l_quantity < 2 AND l_linenumber = 7 THEN 5.0 WHEN l_quantity < 2 AND l_linenumber = 6 THEN 4.0 "
          "ELSE l_linenumber % 3 END AS level FROM lineitem)")


@query("rare_levels_lineitem", f"""
SELECT 'level' AS column_name, CAST(x AS DOUBLE) AS x, n, row_number() OVER (ORDER BY n DESC, x) AS rank FROM (
  SELECT level AS x, count(*) AS n, sum(count(*)) OVER () AS t FROM {SKEWED} GROUP BY level)
WHERE n <= greatest(2, floor(0.01 * t))""")
def rare_levels_lineitem(d: Data):
    low, line = F.col("l_quantity") < 2, F.col("l_linenumber")
    level = F.when(low & (line == 7), 5.0).when(low & (line == 6), 4.0).otherwise((line % 3).cast("double"))
    return X.rare_levels(d.lineitem.select(level.alias("level")), ["level"]).withColumnRenamed("column", "column_name")


SPELLED = "(SELECT CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) WHEN c_acctbal > 9000 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS s FROM customer)"


@query("label_variants_customer", f"""
WITH c AS (SELECT trim(s) AS value, lower(trim(s)) AS canonical, count(*) AS count FROM {SPELLED} GROUP BY ALL)
SELECT 's' AS column_name, canonical, value, count, count(*) OVER (PARTITION BY canonical) AS variants,
  CAST(sum(count) OVER (PARTITION BY canonical) AS BIGINT) AS total FROM c QUALIFY variants >= 2""")
def label_variants_customer(d: Data):
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    spelled = F.when(bal < 0, F.lower(seg)).when(bal > 9000, F.concat(F.lit(" "), seg)).otherwise(seg)
    return X.label_variants(d.customer.select(spelled.alias("s")), ["s"]).withColumnRenamed("column", "column_name")


# --- concentration and groups ------------------------------------------------

def concentration_sql(table: str, column: str, role: str = "categorical") -> str:
    return f"""
(WITH c AS (SELECT trim({column}) AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1),
t AS (SELECT *, (SELECT count(*) FROM {table}) AS rows,
  CASE WHEN regexp_matches(value, '[А-Яа-яЁё]') AND regexp_matches(value, '[A-Za-z]') THEN 'mixed'
    WHEN regexp_matches(value, '[А-Яа-яЁё]') THEN 'cyrillic' WHEN regexp_matches(value, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script
  FROM c WHERE (SELECT count(*) FROM c) BETWEEN 3 AND 400),
m AS (SELECT script AS majority_script FROM t GROUP BY script ORDER BY sum(n) DESC, script LIMIT 1),
w AS (SELECT *, n / rows >= 0.05 AS big, sum(CASE WHEN n / rows >= 0.05 THEN n END) OVER () / rows AS big_total,
  coalesce(sum(n) OVER (ORDER BY n DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / rows AS ahead,
  row_number() OVER (ORDER BY n DESC, value) AS rank FROM t, m),
k AS (SELECT *, CASE WHEN coalesce(big_total, 0) >= 0.5 THEN big ELSE ahead < 0.8 END AS in_core FROM w)
SELECT '{column}' AS column_name, '{role}' AS role, value, n AS count, {r('100.0 * n / rows', 'share_pct')}, script, majority_script, in_core,
  concat_ws(',', CASE WHEN NOT in_core THEN 'periphery' END, CASE WHEN n <= least(greatest(3, floor(rows * 0.02)), 8) THEN 'rare' END,
    CASE WHEN majority_script IN ('cyrillic', 'latin') AND script NOT IN (majority_script, 'other', 'mixed') THEN 'foreign_script' END) AS flags, rank
FROM k)"""


def concentration_rows(df):
    return df.withColumn("flags", F.concat_ws(",", "flags")).withColumnRenamed("column", "column_name")


@query("concentration_values_part", union(f"SELECT * FROM {concentration_sql('part', c)}" for c in ("p_name", "p_brand", "p_type")))
def concentration_values_part(d: Data):
    return concentration_rows(C.concentration_values(d.part, ["p_name", "p_brand", "p_type"]))


@query("concentration_values_events", union(
    f"SELECT * FROM {concentration_sql('events', c, role)}" for c, role in (("event_type", "categorical"), ("props", "geo"))))
def concentration_values_events(d: Data):
    return concentration_rows(C.concentration_values(d.events, ["event_type", "props"], geo=["props"]))


@query("concentration_summary_part", f"""
SELECT column_name, role, count(*) AS n_categories, count(CASE WHEN in_core THEN 1 END) AS core_size,
  {r('coalesce(sum(CASE WHEN in_core THEN 100.0 * count / (SELECT count(*) FROM part) END), 0)', 'core_coverage_pct')}, any_value(majority_script) AS majority_script
FROM ({union(f"SELECT * FROM {concentration_sql('part', c)}" for c in ('p_name', 'p_brand', 'p_type'))}) GROUP BY column_name, role""")
def concentration_summary_part(d: Data):
    values = C.concentration_values(d.part, ["p_name", "p_brand", "p_type"])
    return C.concentration_summary(values).withColumnRenamed("column", "column_name")


def profiles_sql(source: str, category: str, number: str) -> str:
    return f"""
(WITH v AS (SELECT coalesce(trim(CAST({category} AS VARCHAR)), 'nan') AS value, CAST({number} AS DOUBLE) AS x FROM {source} WHERE {number} IS NOT NULL),
o AS (SELECT quantile_cont(x, 0.5) AS om, avg(x) AS oa FROM v),
g AS (SELECT value, count(*) AS n, avg(x) AS mean, min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.5) AS med FROM v GROUP BY value HAVING count(*) >= 5),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rk, count(*) OVER () AS kept FROM g, o)
SELECT '{category}' AS cat, '{number}' AS num, value, n, mean, mn, mx, med, om, oa, med / nullif(om, 0) AS rel FROM k WHERE kept >= 2 AND rk <= 20)"""


def profile_rows_sql(parts) -> str:
    return f"""
SELECT cat, num, value, n AS count, {r('mean', 'mean')}, {r('mn', 'min')}, {r('mx', 'max')}, {r('med', 'median')}, {r('om', 'overall_median')},
  {r('oa', 'overall_mean')}, {r('rel', 'median_vs_overall')},
  concat_ws(',', CASE WHEN n <= 8 THEN 'small_sample' END, CASE WHEN rel >= 2 OR rel <= 0.5 THEN 'far_from_center' END) AS flags FROM ({parts})"""


ORDER_PROFILES = union(f"SELECT * FROM {profiles_sql('orders', c, 'o_totalprice')}" for c in ("o_orderstatus", "o_orderpriority"))


@query("group_profiles_orders", profile_rows_sql(ORDER_PROFILES))
def group_profiles_orders(d: Data):
    profiles = C.group_profiles(d.orders, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])
    return profiles.withColumn("flags", F.concat_ws(",", "flags"))


GAPPY = "(SELECT d.lang, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("group_profiles_gaps", profile_rows_sql(union(f"SELECT * FROM {profiles_sql(GAPPY, c, 'n_chars')}" for c in ("lang", "quality"))))
def group_profiles_gaps(d: Data):
    return C.group_profiles(labelled(d), ["lang", "quality"], ["n_chars"]).withColumn("flags", F.concat_ws(",", "flags"))


@query("median_ranges_orders", f"""
WITH p AS ({ORDER_PROFILES}), l AS (SELECT *, count(CASE WHEN n >= 10 THEN 1 END) OVER (PARTITION BY cat, num) AS large FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY cat, num ORDER BY med DESC, n DESC, value) AS top, row_number() OVER (PARTITION BY cat, num ORDER BY med, n DESC, value) AS low
      FROM l WHERE n >= 10 OR large < 2)
SELECT cat, num, max(CASE WHEN top = 1 THEN value END) AS high_group, {r('max(med)', 'high')}, max(CASE WHEN low = 1 THEN value END) AS low_group,
  {r('min(med)', 'low')}, {r('any_value(om)', 'overall_median')}, {r('any_value(oa)', 'overall_mean')}, {r('max(med) / nullif(min(med), 0)', 'ratio')}
FROM c GROUP BY cat, num""")
def median_ranges_orders(d: Data):
    return C.median_ranges(C.group_profiles(d.orders, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]))


# --- relations ---------------------------------------------------------------

LINKED = TABLES


def keyed_values_sql(tables) -> str:
    parts = []
    for t in tables:
        for c, dtype in SCHEMA[t].items():
            if dtype.startswith(("timestamp", "array")):
                continue
            if dtype == "double":
                value = f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
            else:
                value = f"CAST({c} AS VARCHAR)" if dtype != "string" else f"nullif(trim({c}), '')"
            parts.append(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {value} AS value FROM {t} WHERE {c} IS NOT NULL")
    return union(parts)


def _any(words) -> str:
    return "(" + " OR ".join(f"c LIKE '%{w}%'" for w in words if w.isascii()) + ")"


def names_sql(tables) -> str:
    rows = []
    for (i, t), (j, u) in combinations(enumerate(tables), 2):
        for a in SCHEMA[t]:
            for b in SCHEMA[u]:
                score = N.name_similarity(N.ColumnName(t, a), N.ColumnName(u, b))
                keyed = N.mentions(a, N.KEY_WORDS) or N.mentions(b, N.KEY_WORDS)
                rows.append(f"({i}, {j}, '{t}', '{a}', {list(SCHEMA[t]).index(a)}, '{u}', '{b}', {list(SCHEMA[u]).index(b)}, {score}, {str(keyed).lower()})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS v(ti, tj, lt, lc, li, rt, rc, ri, name, keyed)"


def links_sql(tables) -> str:
    return f"""
WITH s AS ({union(structure_sql(t) for t in tables)}),
cand AS (SELECT * FROM (SELECT table_id AS t, column_name AS c, kind, nunique, non_null, rows FROM s)
  WHERE nunique > 1 AND kind NOT IN ('boolean', 'datetime') AND NOT (kind = 'numeric' AND {_any(N.KEY_MEASURE_WORDS)} AND NOT {_any(N.KEY_WORDS)})
    AND NOT (kind = 'textual' AND nunique > 0.95 * rows AND NOT {_any(N.KEY_WORDS)})),
vals AS (SELECT v.* FROM ({keyed_values_sql(tables)}) v JOIN cand USING (t, c)),
size AS (SELECT t, c, count(*) AS size FROM vals GROUP BY ALL),
o AS (SELECT a.t AS lt, a.c AS lc, b.t AS rt, b.c AS rc, count(*) AS matched FROM vals a JOIN vals b ON a.value = b.value AND a.t <> b.t GROUP BY ALL HAVING count(*) >= 3),
names AS ({names_sql(tables)}),
m AS (SELECT names.*, matched, matched / (x.size + y.size - matched) AS jaccard, matched / x.size AS ca, matched / y.size AS cb,
        f.nunique AS left_unique, g.nunique AS right_unique, f.nunique / f.non_null AS ua, g.nunique / g.non_null AS ub
      FROM names JOIN o USING (lt, lc, rt, rc) JOIN size x ON x.t = lt AND x.c = lc JOIN size y ON y.t = rt AND y.c = rc
      JOIN cand f ON f.t = lt AND f.c = lc JOIN cand g ON g.t = rt AND g.c = rc),
e AS (SELECT *, 0.5 * jaccard + 0.5 * greatest(ca, cb) AS ov FROM m),
sc AS (SELECT *, least(0.42 * name + 0.58 * ov + CASE WHEN keyed THEN 0.08 ELSE 0 END, 1.0) AS score FROM e
  WHERE NOT ((name < 0.4 AND ov < 0.55) OR (name < 0.15 AND ov < 0.7) OR (ov < 0.18 AND name < 0.85))),
best AS (SELECT *, row_number() OVER (PARTITION BY lt, rt ORDER BY round(score, 4) DESC, ti, li, tj, ri) AS rk FROM sc WHERE score >= 0.48),
links AS (SELECT * FROM best WHERE rk <= 2 ORDER BY round(score, 4) DESC, ti, li, tj, ri LIMIT 40)"""


LINKS_SQL = links_sql(LINKED)


@query("join_links", f"""{LINKS_SQL}
SELECT 'join' AS kind, lt AS left_table, lc AS left_column, rt AS right_table, rc AS right_column, {r('CAST(score AS DOUBLE)', 'score')}, {r('jaccard', 'jaccard')},
  {r('100 * ca', 'coverage_left')}, {r('100 * cb', 'coverage_right')}, matched, left_unique, right_unique,
  CASE WHEN ua >= 0.92 AND ub >= 0.92 THEN '1:1' WHEN ua >= 0.92 THEN '1:N' WHEN ub >= 0.92 THEN 'N:1' ELSE 'N:M' END AS cardinality,
  CAST(name AS DOUBLE) AS name_score FROM links""")
def join_links(d: Data):
    return J.join_links(d.tables(*LINKED))


@query("link_examples", f"""{LINKS_SQL},
shared AS (SELECT lt, lc, rt, rc, a.value FROM links JOIN vals a ON a.t = lt AND a.c = lc JOIN vals b ON b.t = rt AND b.c = rc AND a.value = b.value)
SELECT lt AS left_table, lc AS left_column, rt AS right_table, rc AS right_column, row_number() OVER (PARTITION BY lt, lc, rt, rc ORDER BY value) AS rank, value
FROM shared QUALIFY rank <= 8""")
def link_examples(d: Data):
    tables = d.tables(*LINKED)
    facts = J.table_facts(tables)
    return J.link_examples(tables, facts, J.join_links(tables, facts))


@query("key_overlap", """
SELECT 'o_custkey' AS left_column, 'c_custkey' AS right_column, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS matched,
  (SELECT count(DISTINCT o_custkey) FROM orders) AS left_size, (SELECT count(DISTINCT c_custkey) FROM customer) AS right_size
UNION ALL SELECT 'l_orderkey', 'o_orderkey', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders)),
  (SELECT count(DISTINCT l_orderkey) FROM lineitem), (SELECT count(DISTINCT o_orderkey) FROM orders)""")
def key_overlap(d: Data):
    from gleanframe.operators.structure import ColumnFacts

    tables = d.tables("lineitem", "orders", "customer")
    wanted = [("lineitem", "l_orderkey"), ("orders", "o_custkey"), ("orders", "o_orderkey"), ("customer", "c_custkey")]
    by_id = {t.id: t for t in tables}
    columns = [(i, by_id[t], ColumnFacts(c, "identifier", "bigint", 0, 0, 0, False)) for i, (t, c) in enumerate(wanted)]
    found = J.column_overlaps(J.key_values(columns)).filter("(a = 0 AND b = 2) OR (a = 1 AND b = 3)")
    first = F.col("a") == 0
    return found.select(
        F.when(first, "l_orderkey").otherwise("o_custkey").alias("left_column"),
        F.when(first, "o_orderkey").otherwise("c_custkey").alias("right_column"), "matched",
        F.col("size_a").alias("left_size"), F.col("size_b").alias("right_size"))


@query("verify_join_lineitem", """
WITH a AS (SELECT l_orderkey AS k, count(*) AS na FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, count(*) AS nb FROM orders GROUP BY 1),
f AS (SELECT coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b ON a.k = b.k)
SELECT CAST(sum(na) AS BIGINT) AS left_rows, CAST(sum(nb) AS BIGINT) AS right_rows, CAST(sum(CASE WHEN nb = 0 THEN na ELSE 0 END) AS BIGINT) AS left_unmatched,
  CAST(sum(CASE WHEN na = 0 THEN nb ELSE 0 END) AS BIGINT) AS right_unmatched, CAST(sum(na * nb) AS BIGINT) AS joined_rows,
  max(CASE WHEN na > 0 THEN nb ELSE 0 END) AS largest_fan_out FROM f""")
def verify_join_lineitem(d: Data):
    found = J.verify_join(d.lineitem, d.orders, "l_orderkey", "o_orderkey")
    return found.withColumn("joined_rows", F.col("joined_rows").cast("bigint"))


@query("verify_union_orders", """
SELECT count(*) AS rows, count(*) - count(DISTINCT (o_orderstatus, o_orderpriority, o_custkey)) AS duplicate_rows FROM (
  SELECT o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_totalprice < 250000
  UNION ALL SELECT o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_totalprice >= 250000)""")
def verify_union_orders(d: Data):
    from gleanframe.sources.tables import as_table

    columns = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    low = as_table(d.orders.filter("o_totalprice < 250000").select(*columns), "low")
    high = as_table(d.orders.filter("o_totalprice >= 250000").select(*columns), "high")
    return J.verify_union([low, high])


@query("appended_orders", """
SELECT CASE WHEN o_totalprice < 250000 THEN 'low' ELSE 'high' END AS source_table, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL""")
def appended_orders(d: Data):
    from gleanframe.sources.tables import as_table

    both = J.appended([as_table(d.orders.filter("o_totalprice < 250000"), "low"),
                       as_table(d.orders.filter("o_totalprice >= 250000"), "high")])
    return both.groupBy(F.col("_source_table").alias("source_table"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
