"""Edge cases of the written rules."""

import datetime as dt
import math

import pandas as pd
import pytest

from gleanframe.functions import names as N, scalar as S
from gleanframe.operators import (
    anomalies as X, associations as A, charts as G, concentration as C, derived as D, frequency as Q, metrics as M,
    quality as L, relations as J, structure as K,
)
from gleanframe.operators.structure import Roles
from gleanframe.plans import findings as W
from gleanframe.sources.tables import Table, as_table


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_numbers_in_text(spark):
    texts = ["1d", "1f", "1,5", " 12 ", "1e5", "", "inf", "-.5", "0x1", None]
    df = frame(spark, "s string", [(t,) for t in texts])
    got = [r[0] for r in df.select(S.number("s", df.schema["s"].dataType)).collect()]
    assert got == [None, None, None, 12.0, 1e5, None, math.inf, -0.5, None, None]


def test_dates_in_text(spark):
    texts = ["2024-01-02", "2024-01-02 03:04:05.5", "2024-1-2T03:04", "02.13.2024", "13.02.2024", "2024", "12345", "12:30", "now", ""]
    df = frame(spark, "s string", [(t,) for t in texts])
    got = [r[0] for r in df.select(S.moment("s", df.schema["s"].dataType)).collect()]
    assert got == [
        dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 500000), dt.datetime(2024, 1, 2, 3, 4),
        dt.datetime(2024, 2, 13), dt.datetime(2024, 2, 13), dt.datetime(2024, 1, 1), None, None, None, None]


def test_day_first_formats(spark):
    df = frame(spark, "s string", [("02.01.2024",), ("02/01/2024",)])
    first = df.select(S.text_to_timestamp(S.col("s")).cast("date")).collect()
    assert [r[0] for r in first] == [dt.date(2024, 2, 1)] * 2
    other = df.select(S.text_to_timestamp(S.col("s"), day_first=True).cast("date")).collect()
    assert [r[0] for r in other] == [dt.date(2024, 1, 2)] * 2


def test_canonical_keys_of_all_types(spark):
    df = frame(spark, "i bigint, f double, s string, b boolean", [(12, 12.0, "12.0", True), (0, 0.5, " no ", False), (None, None, None, None)])
    types = Q.dtypes(df)
    rows = df.select(*[S.canonical_key(c, types[c]).alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in rows] == [("12", "12", "12", "true"), ("0", "0.5", None, "false"), (None, None, None, None)]


def test_empty_and_tiny_tables(spark):
    for rows in ([], [(1.0, "a", None)], [(None, None, None)]):
        df = frame(spark, "x double, s string, t timestamp_ntz", rows)
        table = Table("t", "t", df)
        described = {r["column"]: r for r in K.structure(table).collect()}
        assert len(described) == 3
        values = {r["metric"]: r["value_double"] for r in M.numeric_metrics(df, ["x"]).collect()}
        assert set(values) == set(M.NUMERIC)
        assert all(v is None for v in values.values()) or rows == [(1.0, "a", None)]
        assert M.categorical_metrics(df, ["s"]).count() == 5
        assert M.datetime_metrics(df, ["t"]).count() == 6
        summary = L.quality_summary(L.quality_columns(K.structure(table)), L.table_duplicates(table)).first()
        assert summary["rows"] == len(rows)
        assert X.numeric_outliers(df, ["x"]).count() == 0
        assert G.histogram(df, ["x"]).count() == 0


def test_missing_values_are_nan_too(spark):
    df = frame(spark, "x double", [(1.0,), (float("nan"),), (None,), (-0.0,), (0.0,)])
    got = {r["metric"]: r["value_double"] for r in M.numeric_metrics(df, ["x"]).collect()}
    assert got["count"] == 3 and got["mode"] == 0.0 and abs(got["mean"] - 1 / 3) < 1e-12
    assert Q.column_fill(df).first()["non_null"] == 3
    assert Q.distinct_counts(df, ["x"]).first()["nunique"] == 2


def test_constant_column_has_no_correlation(spark):
    df = frame(spark, "a double, b double, c double", [(float(i), 5.0, float(-i)) for i in range(12)])
    got = {(r["col_a"], r["col_b"]): r["stat"] for r in A.pearson(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] is None and abs(got[("a", "c")] + 1) < 1e-12
    skew = {r["metric"]: r["value_double"] for r in M.numeric_metrics(df, ["b"], ["skew", "kurtosis", "std"]).collect()}
    assert skew == {"skew": 0.0, "kurtosis": 0.0, "std": 0.0}


def test_metrics_agree_with_pandas(spark):
    values = pd.Series([3.0, 3.0, 1.0, 1.0, 7.5, -2.0, 100.0, 4.0])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = {r["metric"]: r["value_double"] for r in M.numeric_metrics(df, ["x"]).collect()}
    want = {
        "mean": values.mean(), "median": values.median(), "mode": 1.0, "std": values.std(), "var": values.var(),
        "skew": values.skew(), "kurtosis": values.kurt(), "mad": (values - values.mean()).abs().mean(),
        "iqr": values.quantile(0.75) - values.quantile(0.25), "quantile_90": values.quantile(0.9),
    }
    assert all(abs(got[m] - v) < 1e-9 for m, v in want.items())


def test_extra_metrics(spark):
    from pyspark.sql import functions as F

    df = frame(spark, "x double", [(1.0,), (4.0,)])
    rows = M.metrics(df, {"x": ["mean", "std"]}, extra={"sum_of_squares": lambda x: F.sum(x * x)}).collect()
    assert {r["metric"]: r["value_double"] for r in rows}["sum_of_squares"] == 17.0


def test_date_metrics(spark):
    df = frame(spark, "t timestamp_ntz", [(dt.datetime(2024, 1, 31, 23),), (dt.datetime(2024, 2, 1, 1),)])
    got = {r["metric"]: r for r in M.datetime_metrics(df, ["t"]).collect()}
    assert got["date_range_days"]["value_double"] == 0 and got["unique_dates"]["value_double"] == 2
    assert got["min_date"]["value_string"] == "2024-01-31T23:00:00"
    gap = frame(spark, "t timestamp_ntz", [(dt.datetime(2024, 1, 5),), (dt.datetime(2024, 3, 9),)])
    series = M.datetime_metrics(gap, ["t"], ["dates_per_month"]).first()["value_array"]
    assert series == [1, 0, 1]


def test_kinds(spark):
    n = 100
    rows = [(i, i % 2, i % 2 == 0, f"2024-01-{i % 28 + 1:02d}", f"{i}.5", f"text number {i}", "ab"[i % 2], [1.0], float(i % 20), f"{i}", 1.0 + i % 3)
            for i in range(n)]
    df = frame(spark, "item_id bigint, flag int, truth boolean, day string, amount string, note string, letter string, v array<double>, level double, code_id string, price double", rows)
    kinds = {r["column"]: r["kind"] for r in K.structure(as_table(df, "t")).collect()}
    assert kinds == {
        "item_id": "identifier", "flag": "categorical", "truth": "boolean", "day": "datetime", "amount": "numeric",
        "note": "textual", "letter": "categorical", "v": None, "level": "numeric", "code_id": "identifier", "price": "numeric"}


def test_roles_from_names(spark):
    facts = {c: K.ColumnFacts(c, k, "", 9, 9, 9, False) for c, k in (
        ("Город", "categorical"), ("Страна", "categorical"), ("Валюта", "categorical"), ("Площадь, м²", "numeric"),
        ("Арендная плата, мес.", "numeric"), ("Цена за м²", "numeric"), ("ID объявления", "identifier"), ("День платежа", "numeric"))}
    roles = K.roles_of(facts)
    assert roles.geo == ("Город", "Страна") and roles.currency == ("Валюта",) and roles.area == ("Площадь, м²",)
    assert roles.money == ("Арендная плата, мес.", "Цена за м²", "День платежа")


def test_ratio_columns_with_odd_names(spark):
    df = frame(spark, "`Арендная плата, мес.` double, `Площадь, м²` double", [(10.0, 2.0), (9.0, 0.0), (None, 1.0), (8.0, 4.0)])
    roles = Roles(money=("Арендная плата, мес.",), area=("Площадь, м²",))
    wide, pairs = D.with_ratios(df, roles)
    row = D.ratio_summary(wide, pairs).first()
    assert row["name"] == "Арендная плата, мес. / Площадь, м²" and row["count"] == 2 and row["median"] == 3.5
    assert X.numeric_outliers(wide, list(pairs)).count() == 0


def test_wide_fence_where_many_values_stray(spark):
    values = [0.0, 1.0, 2.0, 3.0] * 20 + [7.0] * 13          # beyond 1.5 IQR, within 3 IQR
    df = frame(spark, "x double", [(v,) for v in values])
    s = pd.Series(values)
    iqr = s.quantile(0.75) - s.quantile(0.25)
    assert (s > s.quantile(0.75) + 1.5 * iqr).mean() > 0.12
    far = s > s.quantile(0.75) + 3 * iqr
    found = X.numeric_outliers(df, ["x"]).collect()
    assert (found[0]["n_outliers"] if found else 0) == far.sum()


def test_no_spread_no_outliers(spark):
    df = frame(spark, "x double", [(5.0,)] * 50 + [(float(i),) for i in range(5)])
    assert X.numeric_outliers(df, ["x"]).count() == 0


def test_label_groups_and_scripts(spark):
    rows = [("Минск",)] * 5 + [("минск",)] * 2 + [(" МИНСК ",)] + [("Гродно",)] * 4 + [("Berlin",)] + [(None,)] * 3
    df = frame(spark, "city string", rows)
    found = X.label_duplicates(df, ["city"]).collect()
    assert len(found) == 1 and found[0]["canonical"] == "минск" and found[0]["total"] == 8
    assert [(v["value"], v["count"]) for v in found[0]["variants"]] == [("Минск", 5), ("минск", 2), ("МИНСК", 1)]
    values = {r["value"]: r for r in C.concentration_values(df, ["city"], geo=["city"]).collect()}
    assert "foreign_script" in values["Berlin"]["flags"] and values["Berlin"]["majority_script"] == "cyrillic"


def test_core_by_accumulation(spark):
    sizes = [4] * 20 + [2] * 10                                # no value reaches 5 %
    rows = [(f"v{i:02d}",) for i, n in enumerate(sizes) for _ in range(n)]
    values = C.concentration_values(frame(spark, "c string", rows), ["c"]).collect()
    core = sum(r["count"] for r in values if r["in_core"])
    assert core >= 80 and core - 4 < 80


def test_missing_category_is_a_group_of_its_own(spark):
    rows = [("a", 1.0), ("b", 2.0), (None, 30.0)] * 10
    df = frame(spark, "g string, x double", rows)
    assert {r["value"] for r in C.group_profiles(df, ["g"], ["x"]).collect()} == {"a", "b", "nan"}
    assert A.correlation_ratio(df, ["g"], ["x"]).first()["n"] == 30
    assert A.correlation_ratio(df, ["g"], ["x"], null_label=None).first()["n"] == 20
    assert A.cramers_v(df.selectExpr("g", "CAST(x AS STRING) AS h"), ["g", "h"]).first()["n"] == 20


def test_union_links_need_four_of_five(spark):
    base = frame(spark, "a int, b int, c int, d int", [(1, 2, 3, 4)])
    close = base.selectExpr("a", "b", "c", "d", "1 AS e")
    far = base.selectExpr("a", "b", "c", "d AS z", "1 AS e")
    tables = [as_table(base, "one"), as_table(close, "two"), as_table(far, "three")]
    assert [(r["left_table"], r["right_table"]) for r in J.union_links(tables).collect()] == [("one", "two")]


@pytest.mark.parametrize("a,b,score", [
    (("listings", "ID объявления"), ("contracts", "ID объявления"), 1.0), (("x", "client_id"), ("y", "clientkey"), 0.94),
    (("region", "r_regionkey"), ("nation", "n_regionkey"), 0.86), (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), 0.0),
    (("x", "color"), ("y", "colorcode"), 0.62)])
def test_name_similarity(a, b, score):
    assert N.name_similarity(N.ColumnName(*a), N.ColumnName(*b)) == score


def test_relations_of_more_than_one_mask(spark):
    left = frame(spark, ", ".join(f"c{i}_id bigint" for i in range(70)), [tuple(r * 100 + i for i in range(70)) for r in range(20)])
    right = left.selectExpr("c69_id AS other_id", "c3_id AS third_id")
    links = J.join_links([as_table(left, "wide"), as_table(right, "narrow")]).collect()
    assert {(r["left_column"], r["right_column"]) for r in links} == {("c69_id", "other_id"), ("c3_id", "third_id")}
    assert all(r["cardinality"] == "1:1" and r["matched"] == 20 for r in links)


def test_split_trend_within_one_date(spark):
    rows = [(dt.datetime(2024, 1, 1), float(i)) for i in range(10)] + [(dt.datetime(2024, 1, 2), 100.0)]
    got = G.split_trend(frame(spark, "t timestamp_ntz, x double", rows), "t", "x").first()
    assert got["first_mean"] == 2.0 and abs(got["second_mean"] - (5 + 6 + 7 + 8 + 9 + 100) / 6) < 1e-9 and got["trend"] == "up"


def test_hypotheses_cover_all_rules(spark):
    rows = []
    for i in range(400):
        city = "Берлин" if i < 3 else "Berlin" if i % 3 else "Munich"
        rows.append((city.upper() if i == 50 else city, "USD" if i == 7 or i == 11 else "EUR", "xyz"[i % 3] if i != 9 else "rare",
                     0.0 if i == 5 else (50_000.0 if i == 6 else 100.0 * (1 + i % 40) * (3 if i % 3 else 1)), 10.0 + i % 40))
    df = frame(spark, "city string, currency string, sort string, price double, area double", rows)
    table = as_table(df, "flats")
    facts = K.table_facts([table])[table.id]
    roles = K.roles_of(facts)
    assert roles.geo == ("city",) and roles.money == ("price",) and roles.area == ("area",)
    from gleanframe.plans.profile import profile

    done = profile(table)
    kinds = {r["kind"] for r in done["hypotheses"].collect()}
    assert {"geo_outlier", "quality", "numeric_outlier", "implausible", "group_difference", "correlation"} <= kinds
    ids = [r["id"] for r in done["hypotheses"].orderBy("id").collect()]
    assert ids == list(range(1, len(ids) + 1)) and len(ids) <= 14
    assert done["highlights"].count() <= 16
    assert {"structure", "metrics", "quality_summary", "associations", "outliers", "tests", "recommendations"} <= set(done.results)


@pytest.mark.parametrize("label", ["nan", None])
def test_group_medians_beside_the_whole(spark, label):
    rows = [(None if i % 7 == 0 else "ab"[i % 2], None if i % 5 == 0 else "xyz"[i % 3], float(i * i % 101), i % 11 or None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, h string, x double, n int")
    given = pd.DataFrame(rows, columns=["g", "h", "x", "n"])
    found = C.group_profiles(df, ["g", "h"], ["x", "n"], null_label=label).collect()
    assert len(found) == (14 if label else 10)
    for r in found:
        known = given[given[r["num"]].notna()]
        names = known[r["cat"]].fillna(label) if label else known[r["cat"]]
        inside, whole = known[names == r["value"]][r["num"]], known[names.notna()][r["num"]]
        assert (r["count"], r["median"], r["overall_median"]) == (len(inside), inside.median(), whole.median())
        assert r["mean"] == pytest.approx(inside.mean()) and r["overall_mean"] == pytest.approx(whole.mean())
