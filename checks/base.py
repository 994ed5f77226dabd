"""Sources, scalar expressions, structure, frequencies, metrics, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions import scalar as S
from gleanframe.functions.names import ID_WORDS, MEASURE_WORDS
from gleanframe.operators import frequency as Q, metrics as M, quality as L, structure as K
from gleanframe.session import shared_folder
from gleanframe.sources import sinks, tables as src

from .registry import TABLES, Data, query, r, union

# --- sources and sinks -------------------------------------------------------

COLS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query("table_shapes", union(
    f"SELECT '{t}' AS table_id, '{t}' AS name, count(*) AS rows, CAST({COLS[t]} AS BIGINT) AS cols FROM {t}"
    for t in TABLES))
def table_shapes(d: Data):
    return src.shapes(d.tables(*TABLES))


@query("preview_orders", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders ORDER BY orders.o_orderkey LIMIT 20""")
def preview_orders(d: Data):
    return src.preview(d.table("orders").df, 20, ["o_orderkey"])


@query("csv_roundtrip", f"""
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, {r('c_acctbal', 'c_acctbal')}, c_mktsegment
FROM customer""")
def csv_roundtrip(d: Data):
    path = shared_folder(d.spark, "csv")
    sinks.save_csv(d.customer, path)
    return src.read_csv(d.spark, path)


@query("csv_roundtrip_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip_documents(d: Data):
    """Texts with line breaks and quotes."""
    path = shared_folder(d.spark, "csv")
    sinks.save_csv(d.documents, path)
    return src.read_csv(d.spark, path)


@query("prepared_roundtrip", f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, {r('sum(l_quantity)', 'quantity')},
       CAST(min(l_shipdate) AS VARCHAR) AS first_date, CAST(max(l_shipdate) AS VARCHAR) AS last_date
FROM lineitem GROUP BY ALL""")
def prepared_roundtrip(d: Data):
    folder = shared_folder(d.spark, "tables")
    sinks.save_tables(d.tables("lineitem"), folder)
    again = sinks.reload_tables(d.spark, folder, ["lineitem"])
    return again[0].df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"),
        F.min("l_shipdate").cast("string").alias("first_date"),
        F.max("l_shipdate").cast("string").alias("last_date"))


# --- scalar expressions ------------------------------------------------------

@query("numeric_coercion", f"""
WITH v AS (SELECT l_linenumber, l_quantity, CASE l_linenumber
    WHEN 1 THEN CAST(l_quantity AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'd'
    WHEN 3 THEN '  ' || CAST(l_quantity AS VARCHAR) || ' ' WHEN 4 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'e2'
    WHEN 5 THEN replace(CAST(l_quantity AS VARCHAR), '.', ',') ELSE '-' || CAST(l_quantity AS VARCHAR) END AS t FROM lineitem)
SELECT l_linenumber, count(*) AS n, CAST(sum(CASE WHEN l_linenumber IN (2, 5) THEN 0 ELSE 1 END) AS BIGINT) AS numbers,
       {r("sum(CASE WHEN l_linenumber IN (1, 3) THEN l_quantity WHEN l_linenumber = 4 THEN l_quantity * 100 WHEN l_linenumber > 5 THEN -l_quantity END)", "total")}
FROM v GROUP BY l_linenumber""")
def numeric_coercion(d: Data):
    q = F.col("l_quantity")
    text, whole = q.cast("string"), q.cast("int").cast("string")
    line = F.col("l_linenumber")
    shown = (
        F.when(line == 1, text).when(line == 2, F.concat(whole, F.lit("d")))
        .when(line == 3, F.concat(F.lit("  "), text, F.lit(" "))).when(line == 4, F.concat(whole, F.lit("e2")))
        .when(line == 5, F.replace(text, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit("-"), text))
    )
    df = d.lineitem.select("l_linenumber", shown.alias("t"))
    return df.select("l_linenumber", S.number("t", df.schema["t"].dataType).alias("x")).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("numbers"), F.sum("x").alias("total"))


@query("datetime_coercion", """
SELECT shape, count(*) AS n, count(t) AS dates, CAST(min(t) AS VARCHAR) AS first_date, CAST(max(t) AS VARCHAR) AS last_date
FROM (SELECT o_orderkey % 14 AS shape, CASE WHEN shape < 6 OR shape IN (9, 12) THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
    WHEN shape IN (6, 10) THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 10 HOUR
    WHEN shape = 7 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 22 HOUR
    WHEN shape = 8 THEN date_trunc('year', CAST(o_orderdate AS TIMESTAMP)) END AS t FROM orders) GROUP BY shape""")
def datetime_coercion(d: Data):
    """Dates written in 14 shapes, the last four of which are 24-hour times with a zone, no dates at all, or wrong ones."""
    t = F.col("o_orderdate").cast("date")
    as_ = lambda pattern: F.date_format(t, pattern)
    shapes = [as_("yyyy-MM-dd"), as_("M/d/yyyy"), as_("yyyy/MM/dd"), as_("yyyyMMdd"), as_("MMMM d, yyyy"), as_("MM-dd-yyyy"), as_("MMM d, yyyy 10:00"),
              as_("yyyy-MM-dd 10:00 'PM'"), as_("yyyy"), as_("d MMM yyyy"), as_("yyyy-MM-dd'T'12:00:00'+02:00'"), as_("'on 'yyyy-MM-dd"),
              as_("yyyy-MM-dd 12:00:00 'am'"), as_("yyyy-'13'-dd")]
    df = d.orders.select((F.col("o_orderkey") % 14).alias("shape"), F.element_at(F.array(*shapes), (F.col("o_orderkey") % 14 + 1).cast("int")).alias("t"))
    return df.select("shape", S.moment("t", df.schema["t"].dataType).alias("t")).groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("t").alias("dates"), F.min("t").cast("string").alias("first_date"),
        F.max("t").cast("string").alias("last_date"))


@query("canonical_keys", """
WITH v AS (
  SELECT 'l_quantity' AS column_name, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem
  UNION ALL SELECT 'l_tax', CASE WHEN l_tax = floor(l_tax) THEN CAST(CAST(l_tax AS BIGINT) AS VARCHAR) ELSE CAST(l_tax AS VARCHAR) END FROM lineitem)
SELECT column_name, value, count(*) AS n FROM v GROUP BY ALL""")
def canonical_keys(d: Data):
    df, types = d.lineitem, Q.dtypes(d.lineitem)
    keys = {c: S.canonical_key(c, types[c]) for c in ("l_quantity", "l_linenumber", "l_returnflag", "l_tax")}
    return Q.unpivot(df, keys, "column_name", "value").filter("value IS NOT NULL").groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"))


@query("text_scripts", """
SELECT lang, CASE WHEN regexp_matches(text, '[А-Яа-яЁё]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed'
  WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN 'cyrillic' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script,
  count(*) AS n FROM documents GROUP BY ALL""")
def text_scripts(d: Data):
    return d.documents.groupBy("lang", S.script_of(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


# --- structure ---------------------------------------------------------------

def has(name: str, words) -> str:
    return "true" if any(w in name.lower() for w in words) else "false"


NUMBERS, DATES, TEXTS, LISTS = "number", "datetime", "text", "nested"
SCHEMA = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
                 "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                 "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}


def structure_sql(table: str, source: str | None = None, schema: dict | None = None) -> str:
    """Kinds by the written rules; the texts of the test tables hold no dates and no numbers."""
    parts = []
    for i, (c, dtype) in enumerate((schema or SCHEMA[table]).items()):
        nested = dtype.startswith("array")
        family = NUMBERS if dtype in ("int", "bigint", "double") else DATES if dtype.startswith("timestamp") else TEXTS
        count = f"count({c})"
        levels = "CAST(NULL AS BIGINT)" if nested else f"count(DISTINCT {c})"
        identifies = f"{has(c, ID_WORDS)} AND nn > 0 AND nu >= 0.9 * nn"
        if nested:
            kind = "CAST(NULL AS VARCHAR)"
        elif family == DATES:
            kind = "'datetime'"
        elif family == NUMBERS:
            kind = (f"CASE WHEN {identifies} THEN 'identifier' WHEN {has(c, MEASURE_WORDS)} THEN 'numeric' "
                    "WHEN nn > 0 AND nu <= least(15, greatest(2, floor(0.1 * nn))) THEN 'categorical' ELSE 'numeric' END")
        else:
            kind = (f"CASE WHEN {identifies} THEN 'identifier' WHEN nu > 0.9 * nn AND nu > 50 THEN 'textual' "
                    "ELSE 'categorical' END")
        parts.append(
            f"SELECT '{table}' AS table_id, '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal, {kind} AS kind, "
            f"'{dtype}' AS dtype, rows, nn AS non_null, nu AS nunique, "
            f"{'true' if family == DATES and not nested else 'false'} AS is_datetime_candidate "
            f"FROM (SELECT count(*) AS rows, {count} AS nn, {levels} AS nu FROM {source or table})")
    return union(parts)


def structure_rows(df):
    return df.drop("complete_rows").withColumnRenamed("column", "column_name")


def _register_structure(table: str) -> None:
    @query(f"structure_{table}", structure_sql(table))
    def build(d: Data):
        return structure_rows(K.structure(d.table(table)))


for _table in TABLES:
    _register_structure(_table)


@query("column_roles", f"""
WITH s AS ({union(structure_sql(t) for t in ('part', 'orders', 'nation', 'lineitem'))}),
roles AS (
  SELECT table_id, column_name, 'geo' AS role FROM s WHERE kind IN ('categorical', 'textual') AND (column_name LIKE '%region%' OR column_name LIKE '%city%' OR column_name LIKE '%state%')
  UNION ALL SELECT table_id, column_name, 'money' FROM s WHERE kind = 'numeric' AND (column_name LIKE '%price%' OR column_name LIKE '%cost%' OR column_name LIKE '%rent%' OR column_name LIKE '%amount%')
  UNION ALL SELECT table_id, column_name, 'currency' FROM s WHERE kind IN ('categorical', 'textual') AND column_name LIKE '%curr%'
  UNION ALL SELECT table_id, column_name, 'area' FROM s WHERE kind = 'numeric' AND (column_name LIKE '%area%' OR column_name LIKE '%sqm%')
  UNION ALL SELECT table_id, column_name, kind FROM s WHERE kind IN ('numeric', 'categorical', 'datetime', 'identifier'))
SELECT * FROM roles""")
def column_roles(d: Data):
    described = K.structures(d.tables("part", "orders", "nation", "lineitem"))
    return K.role_table(described).withColumnRenamed("column", "column_name")


# --- frequencies -------------------------------------------------------------

@query("value_counts_orders", union(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM orders GROUP BY {c}"
    for c in ("o_orderstatus", "o_orderpriority")))
def value_counts_orders(d: Data):
    return Q.value_counts(d.orders, ["o_orderstatus", "o_orderpriority"]).withColumnRenamed("column", "column_name")


@query("distinct_counts_lineitem", union(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS nunique FROM lineitem" for c in SCHEMA["lineitem"]))
def distinct_counts_lineitem(d: Data):
    return Q.distinct_counts(d.lineitem, d.lineitem.columns).withColumnRenamed("column", "column_name")


@query("distinct_counts_texts", union(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS nunique FROM documents" for c in ("text", "lang", "source")))
def distinct_counts_texts(d: Data):
    return Q.distinct_counts(d.documents, ["text", "lang", "source"]).withColumnRenamed("column", "column_name")


@query("duplicate_texts", """
SELECT count(*) AS rows, count(*) - count(DISTINCT (text, lang)) AS duplicate_rows FROM documents""")
def duplicate_texts(d: Data):
    return Q.duplicate_rows(d.documents.select("text", "lang"))


@query("column_fill_documents", f"""
WITH j AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT count(*) AS rows, count(CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 1 END) AS complete_rows,
  {', '.join(f'count({c}) AS {c}' for c in ('doc_id', 'lang', 'n_chars', 'quality', 'toxic'))} FROM j)
{union(f"SELECT '{c}' AS column_name, rows, {c} AS non_null, complete_rows FROM c" for c in ('doc_id', 'lang', 'n_chars', 'quality', 'toxic'))}""")
def column_fill_documents(d: Data):
    return Q.column_fill(labelled(d)).drop("ordinal").withColumnRenamed("column", "column_name")


def labelled(d: Data, *extra: str):
    """Documents with their labels: the test tables themselves hold no gaps."""
    return d.documents.join(d.labels, "doc_id", "left").select("doc_id", "lang", "n_chars", "quality", "toxic", *extra)


@query("contingency_lineitem", """
SELECT l_returnflag AS a, CAST(l_linenumber AS VARCHAR) AS b, count(*) AS n FROM lineitem GROUP BY ALL""")
def contingency_lineitem(d: Data):
    return Q.contingency(d.lineitem, [("l_returnflag", "l_linenumber")]).select("a", "b", "n")


# --- metrics -----------------------------------------------------------------

def numeric_sql(table: str, columns) -> str:
    names = {
        "count": "CAST(count(x) AS DOUBLE)", "mean": "avg(x)", "median": "quantile_cont(x, 0.5)", "std": "stddev_samp(x)",
        "var": "var_samp(x)", "min": "min(x)", "max": "max(x)", "quantile_25": "quantile_cont(x, 0.25)",
        "quantile_75": "quantile_cont(x, 0.75)", "quantile_90": "quantile_cont(x, 0.9)",
        "quantile_95": "quantile_cont(x, 0.95)", "skew": "skewness(x)", "kurtosis": "kurtosis(x)",
        "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
    }
    parts = []
    for c in columns:
        v = f"SELECT CAST({c} AS DOUBLE) AS x FROM {table} WHERE {c} IS NOT NULL"
        wide = f"SELECT {', '.join(f'{e} AS {n}' for n, e in names.items())} FROM ({v})"
        parts += [f"SELECT '{c}' AS column_name, '{n}' AS metric, {n} AS v FROM ({wide})" for n in names]
        parts.append(f"SELECT '{c}', 'mad', avg(abs(x - m)) FROM ({v}), (SELECT avg(x) AS m FROM ({v}))")
        parts.append(f"SELECT '{c}', 'mode', x FROM (SELECT x, count(*) AS n FROM ({v}) GROUP BY x ORDER BY n DESC, x LIMIT 1)")
    return f"SELECT column_name, metric, {r('v', 'value')} FROM ({union(parts)})"


def numeric_rows(df):
    return df.select(F.col("column").alias("column_name"), "metric", F.col("value_double").alias("value"))


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_metrics_lineitem", numeric_sql("lineitem", LINE_NUMBERS))
def numeric_metrics_lineitem(d: Data):
    return numeric_rows(M.numeric_metrics(d.lineitem, LINE_NUMBERS))


@query("numeric_metrics_events", numeric_sql("events", ["value", "user_id"]))
def numeric_metrics_events(d: Data):
    return numeric_rows(M.numeric_metrics(d.events, ["value", "user_id"]))


def categorical_sql(table: str, columns) -> str:
    parts = []
    for c in columns:
        top = f"(SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1)"
        parts += [
            f"SELECT '{c}' AS column_name, 'count' AS metric, CAST(count({c}) AS DOUBLE) AS v, NULL AS value_string FROM {table}",
            f"SELECT '{c}', 'nunique', CAST(count(DISTINCT {c}) AS DOUBLE), NULL FROM {table}",
            f"SELECT '{c}', 'mode', NULL, CAST(v AS VARCHAR) FROM {top}",
            f"SELECT '{c}', 'mode_count', CAST(n AS DOUBLE), NULL FROM {top}",
            f"SELECT '{c}', 'mode_rel_freq', n / (SELECT count(*) FROM {table}), NULL FROM {top}",
        ]
    return f"SELECT column_name, metric, {r('v', 'value')}, value_string FROM ({union(parts)})"


def categorical_rows(df):
    return df.select(F.col("column").alias("column_name"), "metric", F.col("value_double").alias("value"), "value_string")


@query("categorical_metrics_orders", categorical_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def categorical_metrics_orders(d: Data):
    return categorical_rows(M.categorical_metrics(d.orders, ["o_orderstatus", "o_orderpriority"]))


@query("categorical_metrics_documents", categorical_sql(
    "(SELECT d.lang, d.text, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)", ["lang", "text", "quality"]))
def categorical_metrics_documents(d: Data):
    return categorical_rows(M.categorical_metrics(labelled(d, "text"), ["lang", "text", "quality"]))


def datetime_sql(table: str, columns) -> str:
    parts = []
    for c in columns:
        iso = lambda e: (f"strftime({e}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({e}, '%f') = '000000' THEN '' "
                         f"ELSE '.' || strftime({e}, '%f') END")
        parts += [
            f"SELECT '{c}' AS column_name, 'count' AS metric, CAST(count({c}) AS DOUBLE) AS value, NULL AS value_string FROM {table}",
            f"SELECT '{c}', 'min_date', NULL, {iso(f'min({c})')} FROM {table}",
            f"SELECT '{c}', 'max_date', NULL, {iso(f'max({c})')} FROM {table}",
            f"SELECT '{c}', 'date_range_days', CAST((epoch_us(max({c})) - epoch_us(min({c}))) // 86400000000 AS DOUBLE), NULL FROM {table}",
            f"SELECT '{c}', 'unique_dates', CAST(count(DISTINCT CAST({c} AS DATE)) AS DOUBLE), NULL FROM {table}",
        ]
    return union(parts)


@query("datetime_metrics_orders", datetime_sql("orders", ["o_orderdate"]))
def datetime_metrics_orders(d: Data):
    return categorical_rows(M.datetime_metrics(d.orders, ["o_orderdate"])).filter("metric <> 'dates_per_month'")


@query("datetime_metrics_events", datetime_sql("events", ["ts"]))
def datetime_metrics_events(d: Data):
    return categorical_rows(M.datetime_metrics(d.events, ["ts"])).filter("metric <> 'dates_per_month'")


def months_sql(table: str, column: str) -> str:
    return f"""
WITH c AS (SELECT date_trunc('month', {column}) AS m, count(*) AS n FROM {table} GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT min(m) FROM c), (SELECT max(m) FROM c), INTERVAL 1 MONTH)) AS m)
SELECT '{column}' AS column_name, strftime(last_day(cal.m), '%Y-%m-%d') AS month, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM cal LEFT JOIN c ON cal.m = c.m"""


@query("dates_per_month_lineitem", months_sql("lineitem", "l_shipdate"))
def dates_per_month_lineitem(d: Data):
    return M.months_of(M.days_of(d.lineitem, ["l_shipdate"])).select(
        F.col("column").alias("column_name"), F.col("month").cast("string").alias("month"), "n")


@query("dates_per_month_gaps", months_sql(
    "(SELECT CASE WHEN month(o_orderdate) IN (1, 5, 12) THEN o_orderdate END AS o_orderdate FROM orders)", "o_orderdate"))
def dates_per_month_gaps(d: Data):
    gappy = d.orders.withColumn("o_orderdate", F.when(F.month("o_orderdate").isin(1, 5, 12), F.col("o_orderdate")))
    return M.months_of(M.days_of(gappy, ["o_orderdate"])).select(
        F.col("column").alias("column_name"), F.col("month").cast("string").alias("month"), "n")


@query("identifier_metrics_customer", union(
    f"SELECT '{c}' AS column_name, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM customer"
    for c in ("c_custkey", "c_name") for m, e in (("count", f"count({c})"), ("nunique", f"count(DISTINCT {c})"))))
def identifier_metrics_customer(d: Data):
    return numeric_rows(M.identifier_metrics(d.customer, ["c_custkey", "c_name"]))


@query("planned_metrics_part", f"""
SELECT column_name, metric, value, CAST(NULL AS VARCHAR) AS value_string FROM ({numeric_sql('part', ['p_size', 'p_retailprice'])})
UNION ALL {categorical_sql('part', ['p_brand'])}
UNION ALL SELECT 'p_partkey', m, CAST(n AS DOUBLE), NULL FROM (SELECT unnest(['count', 'nunique']) AS m, count(*) AS n FROM part)""")
def planned_metrics_part(d: Data):
    plan = {"p_size": M.NUMERIC, "p_retailprice": M.NUMERIC, "p_brand": M.CATEGORICAL, "p_partkey": M.IDENTIFIER}
    return categorical_rows(M.metrics(d.part, plan))


# --- quality -----------------------------------------------------------------

LABELLED = "(SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
LABELLED_SCHEMA = {"doc_id": "bigint", "lang": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}


def quality_sql(table: str, source: str, schema: dict) -> str:
    flag = lambda name, test: f"CASE WHEN {test} THEN '{name}' END"
    return f"""
SELECT table_id, column_name, kind, rows, non_null, rows - non_null AS missing, missing_pct, nunique, unique_pct,
  concat_ws(',', {flag('high_missing', 'missing_pct >= 50')}, {flag('moderate_missing', 'missing_pct >= 10 AND missing_pct < 50')},
    {flag('constant', 'non_null > 0 AND nunique = 1')},
    {flag('near_unique', "non_null > 10 AND unique_pct >= 95 AND kind <> 'identifier'")},
    {flag('likely_identifier', "kind = 'identifier'")}) AS issues
FROM (SELECT *, round(100.0 * (rows - non_null) / rows, 2) AS missing_pct, round(100.0 * nunique / non_null, 2) AS unique_pct
      FROM ({structure_sql(table, source, schema)})) WHERE kind IS NOT NULL"""


def quality_rows(df):
    return df.drop("ordinal", "complete_rows").withColumn("issues", F.concat_ws(",", "issues")).withColumnRenamed(
        "column", "column_name")


@query("quality_columns_documents", quality_sql("documents", LABELLED, LABELLED_SCHEMA))
def quality_columns_documents(d: Data):
    return quality_rows(L.quality_columns(K.structure(src.Table("documents", "documents", labelled(d)))))


@query("quality_columns_customer", quality_sql("customer", "customer", SCHEMA["customer"]))
def quality_columns_customer(d: Data):
    return quality_rows(L.quality_columns(K.structure(d.table("customer"))))


def summary_sql(table: str, source: str, schema: dict) -> str:
    issue = lambda name: f"count(CASE WHEN issues LIKE '%{name}%' THEN 1 END)"
    complete = " AND ".join(f"{c} IS NOT NULL" for c in schema)
    return f"""
WITH q AS ({quality_sql(table, source, schema)}),
x AS (SELECT count(*) AS rows, count(CASE WHEN {complete} THEN 1 END) AS complete_rows,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicate_rows FROM {source}),
a AS (SELECT count(*) AS columns, round(avg(missing_pct), 2) AS avg_missing_pct, {issue('high_missing')} AS high_missing_columns,
      {issue('moderate_missing')} AS moderate_missing_columns, {issue('constant')} AS constant_columns,
      {issue('near_unique')} AS near_unique_columns, {issue('likely_identifier')} AS identifier_columns,
      CAST(sum(non_null) AS BIGINT) AS filled FROM q),
s AS (SELECT *, round(100.0 * duplicate_rows / rows, 2) AS duplicate_pct FROM x, a),
g AS (SELECT *, CAST(greatest(round_even(100.0 - (least(avg_missing_pct * 0.6, 30) + least(duplicate_pct * 0.5, 20)
      + least(high_missing_columns * 5, 15) + least(constant_columns * 3, 10) + least(near_unique_columns * 2, 10)), 0), 0) AS BIGINT) AS score FROM s)
SELECT '{table}' AS table_id, rows, columns, duplicate_rows, duplicate_pct, avg_missing_pct, score,
  CASE WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS grade, high_missing_columns,
  moderate_missing_columns, constant_columns, near_unique_columns, identifier_columns, complete_rows,
  round(100.0 * complete_rows / rows, 2) AS complete_pct, rows - complete_rows AS rows_with_missing,
  round(100.0 * filled / (rows * columns), 2) AS fill_rate_pct,
  greatest(columns - constant_columns - identifier_columns, 0) AS usable_columns FROM g"""


def _summary(table: src.Table):
    summary = L.quality_summary(L.quality_columns(K.structure(table)), L.table_duplicates(table))
    return summary.drop("column_kinds", "top_missing")


@query("quality_summary_lineitem", summary_sql("lineitem", "lineitem", SCHEMA["lineitem"]))
def quality_summary_lineitem(d: Data):
    return _summary(d.table("lineitem"))


@query("quality_summary_documents", summary_sql("documents", LABELLED, LABELLED_SCHEMA))
def quality_summary_documents(d: Data):
    return _summary(src.Table("documents", "documents", labelled(d)))


@query("top_missing_documents", f"""
SELECT table_id, column_name, missing_pct, kind, row_number() OVER (ORDER BY missing_pct DESC, column_name) AS rank
FROM ({quality_sql('documents', LABELLED, LABELLED_SCHEMA)}) WHERE missing_pct > 0 ORDER BY rank LIMIT 5""")
def top_missing_documents(d: Data):
    found = L.top_missing(L.quality_columns(K.structure(src.Table("documents", "documents", labelled(d)))))
    return found.drop("ordinal").withColumnRenamed("column", "column_name")
