"""The whole profile of a table with the headers that real files have, and the charts it chooses."""

import json

import pytest
from pyspark.sql import functions as F

from gleanframe import profile
from gleanframe.plans import charts as V
from gleanframe.operators import structure as K
from gleanframe.sources.literals import literal_rows
from gleanframe.sources.tables import Table, tidy

CITY, MONEY, AREA, DAY = "Город, район", "Арендная плата, мес.", "Общая площадь (кв.м)", "start.date `x`"


@pytest.fixture(scope="module")
def done(spark):
    import datetime as dt
    rows = []
    for i in range(240):
        city = ["Minsk", "Brest", "Гомель", "Grodno"][i % 4] if i else None
        area = 20.0 + (i * 7) % 60
        rows.append((city, area * (10 + 9 * (i % 4)) + (50_000.0 if i == 17 else i % 5), area, ["a,b", "c.d", "e`f"][i % 3], dt.datetime(2024, 1, 1) + dt.timedelta(days=i * 3)))
    df = spark.createDataFrame(rows, "c0 string, c1 double, c2 double, c3 string, c4 timestamp_ntz").toDF(CITY, MONEY, AREA, "kind", DAY)
    return profile(Table("flats", "flats", tidy(df)))


def test_profile_of_real_headers(done):
    plan = {(r.kind, tuple(r.columns)) for r in done["chart_plan"].collect()}
    assert {("place_median", (CITY, MONEY)), ("area_money", (AREA, MONEY)), ("outlier_box", (MONEY,)), ("core", (CITY,))} <= plan
    kinds = {k for k, _ in plan}
    assert {"place_ratio", "series", "count", "histogram"} <= kinds
    for kind in kinds:
        rows = done[f"chart_{kind}"].collect()
        assert rows, kind
        if kind not in ("heatmap", "missing"):
            assert {tuple(r["columns"]) for r in rows} <= {c for k, c in plan if k == kind}, kind
    assert done["chart_area_money"].count() == 240


def test_captions_meet_their_charts(done):
    plan = {(r["rank"], r.kind, tuple(r.columns)) for r in done["chart_plan"].collect()}
    captions = done["captions"].collect()
    assert {(r["rank"], r.kind, tuple(r.columns)) for r in captions} == {p for p in plan if p[1] in V.CAPTIONS or p[1] == "missing"}
    by_kind = {r.kind: json.loads(r.numbers) for r in captions}
    assert by_kind["place_median"]["best"] in ("Minsk", "Brest", "Гомель", "Grodno") and by_kind["series"]["trend"] in ("up", "down", "flat")


def test_choice_is_one_plan(spark):
    """Pairs, columns and gaps by the rules; equal points keep the order of kinds; nothing is collected."""
    importance = literal_rows(spark, [("t", c, k, w) for c, k, w in (("n1", "numeric", 40.0), ("n2", "numeric", 40.0), ("n3", "numeric", 30.0), ("n4", "numeric", 0.0),
                              ("g,1", "categorical", 60.0), ("g2", "boolean", 20.0), ("d", "datetime", 25.0))], "table_id string, column string, kind string, importance double")
    links = [("pearson", "n1", "n2", -0.9), ("pearson", "n2", "n1", 0.8), ("pearson", "n1", "n3", 0.7), ("pearson", "n3", "n2", 0.6), ("pearson", "n4", "n1", 0.5),
             ("eta", "g,1", "n1", 0.6), ("cramers_v", "g,1", "g2", 0.5)]
    ties = literal_rows(spark, [(t, a, b, s, i + 1) for i, (t, a, b, s) in enumerate(links)], "type string, col_a string, col_b string, stat double, rank bigint")
    none = literal_rows(spark, [], "column string, missing bigint")
    got = [(r.kind, r.columns, round(r.score, 6)) for r in V.chart_plan(importance, ties, none).orderBy("rank").collect()]
    assert got == [("heatmap", ["n1", "n2", "n3"], 98.0), ("scatter", ["n1", "n2"], 98.0), ("mean_bar", ["g,1", "n1"], 97.0), ("scatter", ["n1", "n3"], 94.5),
                   ("scatter", ["n4", "n1"], 87.5), ("count", ["g,1"], 85.0), ("box", ["g,1", "n1"], 81.0), ("series", ["d", "n1"], 80.0), ("crosstab", ["g,1", "g2"], 75.0),
                   ("count", ["g2"], 65.0), ("histogram", ["n1"], 64.0), ("histogram", ["n2"], 64.0)]
    gaps = literal_rows(spark, [("n1", 5)], "column string, missing bigint")
    found = literal_rows(spark, [("n1", 3.0)], "column string, pct double")
    more = V.discovered_charts(None, found, K.Roles(geo=("g2",), money=("n1",)), (), spark)
    got = [(r.kind, r.columns) for r in V.chart_plan(importance, ties, gaps, more, 5).orderBy("rank").collect()]
    assert got == [("heatmap", ["n1", "n2", "n3"]), ("scatter", ["n1", "n2"]), ("mean_bar", ["g,1", "n1"]), ("scatter", ["n1", "n3"]), ("outlier_box", ["n1"])]
    assert ("missing", []) in [(r.kind, r.columns) for r in V.chart_plan(importance, ties, gaps).collect()]
    nothing = V.chart_plan(importance.where("importance < 0"), ties.limit(0), none)
    assert nothing.collect() == []


def test_dates_by_shape(spark):
    from gleanframe.functions import scalar as S
    cases = {"20240105": "2024-01-05 00:00:00", "September 5, 2024": "2024-09-05 00:00:00", "Sep 5, 2024 10:00": "2024-09-05 10:00:00", "01-02-2024": "2024-01-02 00:00:00",
             "2024-01-02 10:00 PM": "2024-01-02 22:00:00", "2024-01-02 12:30:15.25 am": "2024-01-02 00:30:15.25", "5 May 2024": "2024-05-05 00:00:00", "13/02/2024": "2024-02-13 00:00:00",
             "2024": "2024-01-01 00:00:00", " 2024.3.4 ": "2024-03-04 00:00:00", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05+02:00": "2024-01-02 01:04:05",
             "2024-13-01": None, "30/02/2024": None, "2024-01-02 13:00 PM": None, "2024-01/02": None, "Foo 5, 2024": None, "12345": None, "": None, "2024-01-02 25:00": None, "a|b|c": None, "1|2": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.d and str(r.d) for r in df.select("t", S.text_to_timestamp(S.col("t")).cast("timestamp_ntz").cast("string").alias("d")).collect()}
    assert got == cases
    assert df.select(S.text_to_timestamp(F.lit("01/02/2024"), day_first=True).cast("date").cast("string")).first()[0] == "2024-02-01"


def test_rows_are_equal_by_value_and_place(spark):
    from gleanframe.operators import frequency as Q
    rows = [("1", None, None), (None, "1", None), ("", None, None), (None, None, None), (None, None, None), ("1:1", "", None), ("1", ":1", None), ("", "", [1]), ("", "", [1]), ("-", "", None), (None, "-", None)]
    df = spark.createDataFrame(rows, "a string, b string, c array<int>")
    assert Q.duplicate_rows(df).first().asDict() == {"rows": 11, "duplicate_rows": 2}
    assert Q.duplicate_rows(df.select()).first()["rows"] == 11
