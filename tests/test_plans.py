"""What the plans must not contain."""

import re

import pytest

from checks.registry import Data
from gleanframe.operators import (
    anomalies as X, associations as A, concentration as C, frequency as Q, metrics as M, order_stats as O, rank_tests as R,
    relations as J, structure as K,
)


@pytest.fixture(scope="module")
def data(spark):
    return Data(spark, "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(d):
    li = d.lineitem
    return {
        "moments": M.moments(Q.number_rows(li, ["l_quantity", "l_tax"])),
        "metrics": M.numeric_metrics(li, ["l_quantity", "l_tax"]),
        "structure": K._counts(d.table("lineitem")),
        "counts": Q.value_counts(li, ["l_returnflag"]),
        "quantiles": O.quantile_columns(Q.number_rows(li, ["l_quantity"]), ["column"], {"m": 0.5}),
        "eta": A.correlation_ratio(li, ["l_returnflag"], ["l_quantity"]),
        "cramers": A.cramers_v(li, ["l_returnflag", "l_linestatus"]),
        "spearman": R.spearman(li, "l_quantity", "l_extendedprice"),
        "concentration": C.concentration_values(li, ["l_returnflag"]),
        "groups": C.group_profiles(li, ["l_returnflag"], ["l_quantity"]),
        "outliers": X.numeric_outliers(li, ["l_quantity"]),
        "links": J.join_links(d.tables("nation", "customer")),
    }


def test_no_python_workers_cross_joins_or_percentile_buffers(data):
    for name, df in frames(data).items():
        text = plan(df)
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "percentile("):
            assert bad not in text, (name, bad)


def test_only_needed_columns_are_read(data):
    text = plan(M.moments(Q.number_rows(data.lineitem, ["l_tax"])))
    assert re.findall(r"ReadSchema: (\S+)", text) == ["struct<l_tax:double>"]
    text = plan(Q.value_counts(data.orders, ["o_orderstatus"]))
    assert re.findall(r"ReadSchema: (\S+)", text) == ["struct<o_orderstatus:string>"]


def test_scans(data, monkeypatch):
    """How often the table itself is read: stored values and bins are read in its place."""
    reads = []

    def counted(df, purpose):
        reads.append(plan(df).count("lineitem.parquet"))
        return kept(df, purpose)

    kept = M.stored
    monkeypatch.setattr(M, "stored", counted)
    text = plan(M.numeric_metrics(data.lineitem, ["l_quantity", "l_tax"]))
    assert sum(reads) + text.count("lineitem.parquet") == 1
    reads.clear()
    text = plan(M.numeric_metrics(data.lineitem, ["l_quantity", "l_tax"], ["mean", "median", "mad", "skew"]))
    assert sum(reads) + text.count("lineitem.parquet") <= 4


def test_groups_of_a_pair_meet_as_sums(data):
    assert "Window" not in plan(A.correlation_ratio(data.lineitem, ["l_returnflag"], ["l_quantity"]))


def test_long_values_of_links_travel_as_digests(data):
    tables = data.tables("documents", "labels")
    columns = J.key_columns(tables, K.table_facts(tables))
    assert "sha2(" in plan(J.key_values(columns)) and "sha2(" not in plan(J.key_values(columns, whole=True))


def test_values_are_combined_before_shuffles(data):
    text = plan(Q.value_counts(data.lineitem, ["l_returnflag", "l_linestatus"]))
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_single_partitions_hold_totals_only(data):
    """Where everything meets in one task, at most bins, slots or one row per task arrive."""
    for name, df in frames(data).items():
        lines = plan(df).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert re.search(r"Aggregate\(.*partial_|LocalLimit|TakeOrdered|Aggregate\(keys=\[", lines[i + 1]) or "Scan parquet" not in lines[i + 1], (name, lines[i + 1])
    assert "SinglePartition" not in plan(O.quantile_columns(Q.number_rows(data.lineitem, ["l_tax"]), ["column"], {"m": 0.5}))


def test_values_are_distinct_before_they_are_written_or_tested(data):
    """Only the grouping of (id, value) may lie between a table and the work on each value's text."""
    tables = data.tables("orders", "customer")
    facts = K.table_facts(tables)
    columns = [(i, t, facts[t.id][c]) for i, (t, c) in enumerate((t, c) for t in tables for c in t.df.columns if t.df.schema[c].dataType.simpleString() != "timestamp_ntz")]
    levels = Q.level_counts([(i, t.df, f.name) for i, t, f in columns], K.TEXT_TESTS)
    for df in (J.key_values(columns), J.key_values(columns, whole=True), levels):
        below = [b.split("FileScan")[0] for b in re.split(r"Exchange hashpartitioning\(id#\d+, value#\d+, \d+\)", plan(df))[1:]]
        assert len(below) == 2                                # whole numbers, short text
        assert not [b for b in below if re.search("(?i)regexp|rlike|trim|as string", b)]
