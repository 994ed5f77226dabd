"""Exact ranks and quantiles against pandas, on data made to strain the cells."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gleanframe.operators import order_stats as O, rank_tests as R

PROBABILITIES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}


def cases():
    rng = np.random.default_rng(7)
    return {
        "heavy tails": rng.standard_cauchy(3000) * 1e4,
        "third in one value": np.concatenate([np.full(1000, 42.0), rng.normal(size=2000)]),
        "narrow range": 1.7e9 + rng.integers(0, 1000, 2000) / 8.0,
        "tiny and huge": np.array([5e-324, -5e-324, 1e308, -1e308, 0.0, -0.0, 1.0, -1.0] * 5),
        "constant": np.full(50, -3.5),
        "single": np.array([2.0]),
        "whole numbers": rng.integers(-50, 50, 2500).astype(float),
    }


@pytest.mark.parametrize("name", list(cases()))
def test_quantiles(spark, name):
    values = cases()[name]
    df = spark.createDataFrame(pd.DataFrame({"column": "v", "x": values})).repartition(5)
    got = O.quantile_columns(df, ["column"], PROBABILITIES).toPandas().iloc[0]
    want = pd.Series(values).quantile(list(PROBABILITIES.values()))
    assert np.allclose([got[c] for c in PROBABILITIES], want.to_numpy(), rtol=1e-12, atol=0)


@pytest.mark.parametrize("limit", [0, 40, O.BROADCAST_ROWS])
def test_ranks_by_key_on_both_sides_of_the_limit(spark, limit):
    rng = np.random.default_rng(3)
    parts = {"near": 1.7e9 + rng.integers(0, 4000, 3000) / 8.0, "wide": rng.standard_cauchy(900) * 1e4, "one": np.full(9, 2.0)}
    values = pd.concat([pd.DataFrame({"key": k, "x": v}) for k, v in parts.items()])
    counts = values.value_counts(["key", "x"]).rename("n").reset_index()
    got = O.average_ranks(spark.createDataFrame(counts).repartition(4), ["key"], limit=limit)
    text = got._jdf.queryExecution().toString()
    assert ("__hot" in text) == (limit < O.BROADCAST_ROWS)
    want = values.assign(rank=values.groupby("key")["x"].rank()).drop_duplicates(["key", "x"])
    both = got.toPandas().merge(want, on=["key", "x"])
    assert len(both) == len(counts) and (both["avg_rank"] == both["rank"]).all()


@pytest.mark.parametrize("name", list(cases()))
def test_average_ranks(spark, name):
    values = pd.Series(cases()[name])
    counts = values.value_counts().rename_axis("x").reset_index(name="n")
    got = O.average_ranks(spark.createDataFrame(counts).repartition(3), []).toPandas()
    want = dict(zip(values, values.rank()))
    assert len(got) == values.nunique()
    assert all(want[x] == r for x, r in zip(got["x"], got["avg_rank"]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=60))
def test_bins_keep_the_order(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"x": sorted(values)})).coalesce(1)
    bins = df.selectExpr("x", f"{O.magnitude_bin('x')} AS b").orderBy("x").toPandas()["b"]
    assert bins.is_monotonic_increasing


def test_partitions_do_not_matter(spark):
    values = cases()["heavy tails"]
    df = spark.createDataFrame(pd.DataFrame({"column": "v", "x": values}))
    one = O.quantile_columns(df.coalesce(1), ["column"], PROBABILITIES).collect()
    many = O.quantile_columns(df.repartition(8), ["column"], PROBABILITIES).collect()
    assert one == many


def test_spearman_and_kruskal_with_hot_values(spark):
    rng = np.random.default_rng(3)
    n = 3000
    a = np.where(np.arange(n) % 3 == 0, 10.0, rng.integers(0, 900, n).astype(float))
    b = np.where(np.arange(n) % 3 == 1, 5.0, a + rng.normal(size=n) * 100)
    g = np.where(np.arange(n) % 3 == 2, "hot", [f"g{i % 7}" for i in range(n)])
    pdf = pd.DataFrame({"a": a, "b": b, "g": g})
    df = spark.createDataFrame(pdf)
    rho = R.spearman(df, "a", "b").first()
    assert rho["n"] == n and abs(rho["stat"] - pdf["a"].rank().corr(pdf["b"].rank())) < 1e-9
    h = R.kruskal(df, ["g"], ["a"]).first()["stat"]
    ranks = pdf["a"].rank().groupby(pdf["g"])
    want = 12 / (n * (n + 1)) * (ranks.count() * ranks.mean() ** 2).sum() - 3 * (n + 1)
    assert abs(h - want) < 1e-6


def test_attach_unique_splits_hot_and_cold(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id % 50 END AS k", "id")
    lookup = rows.groupBy("k").count().selectExpr("k", "count AS pairs", "k * 2.0D AS r")
    for parts in (2, 100_000):          # few hot keys, all keys hot
        joined = O.attach_unique(rows, lookup, ["k"], "pairs", ["r"], hot_parts=parts)
        assert joined.count() == 3000 and joined.filter("r <> k * 2").count() == 0
