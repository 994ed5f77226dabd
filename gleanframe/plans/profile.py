"""The full profile of one or several tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT_LIMITS, Limits
from ..operators import (
    anomalies, associations, charts as G, concentration, derived, frequency as Q, metrics, quality, rank_tests, relations,
    structure as K,
)
from ..session import shared_folder
from ..sources.sinks import save_results
from ..sources.tables import Table
from . import charts, findings


# Result tables that highlights are drawn from.
WORDED = {"concentration_values", "outliers", "implausible", "label_duplicates", "tests", "derived"}


@dataclass
class Profile:
    """Result tables by name; each carries ``table_id`` where it describes one table."""

    results: dict[str, DataFrame]
    facts: dict[str, dict[str, K.ColumnFacts]]
    roles: dict[str, K.Roles]
    tables: list[Table] = field(default_factory=list)
    folder: str = ""

    def __getitem__(self, name: str) -> DataFrame:
        return self.results[name]

    def save(self, folder: str, fmt: str = "json") -> None:
        save_results(self.results, folder, fmt)


def table_results(table: Table, facts: K.Facts, roles: K.Roles, limits: Limits = DEFAULT_LIMITS,
                  plan: Mapping[str, Sequence[str]] | None = None) -> dict[str, Callable[[], DataFrame]]:
    """How to compute each result table of one table from its rows; nothing runs yet."""
    df, pairs = derived.with_ratios(table.df, roles)
    plan = plan if plan is not None else metrics.default_plan(facts)
    measures = K.ordered(roles.measures(), tuple(pairs))
    groups, numbers = roles.profile_groups(), roles.profile_numbers(tuple(pairs))
    jobs = {
        "outliers": (measures, lambda: anomalies.outliers_with_examples(df, measures, limits)),
        "group_profiles": (groups and numbers, lambda: concentration.group_profiles(df, groups, numbers, limits)),
        "metrics": (plan, lambda: metrics.metrics(table.df, plan)),
        "derived": (pairs, lambda: derived.ratio_summary(df, pairs)),
        "associations": (True, lambda: associations.associations(table.df, facts, limits)),
        "concentration_values": (roles.concentrations(), lambda: concentration.concentration_values(
            df, roles.concentrations(), roles.geo, limits)),
        "implausible": (roles.measures(), lambda: anomalies.implausible(df, roles, limits)),
        "label_duplicates": (roles.labels(), lambda: anomalies.label_duplicates(df, roles.labels())),
    }
    return {name: build for name, (applies, build) in jobs.items() if applies}


def profile(tables: Table | Sequence[Table], limits: Limits = DEFAULT_LIMITS,
            roles: Mapping[str, K.Roles] | None = None,
            plans: Mapping[str, Mapping[str, Sequence[str]]] | None = None, parallel: int = 8) -> Profile:
    """Run all analyses.

    Results are written once to the shared folder of the cluster, so that findings
    read small tables instead of repeating the work, and lost executors cost a task.
    Up to ``parallel`` independent jobs are submitted at a time.  ``roles`` and
    ``plans`` override, per table id, what names and kinds suggest.
    """
    tables = [tables] if isinstance(tables, Table) else list(tables)
    spark = tables[0].df.sparkSession
    folder = shared_folder(spark, "profile")

    def stored(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def run(jobs: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        with ThreadPoolExecutor(parallel) as pool:
            waiting = {name: pool.submit(inheritable_thread_target(spark)(lambda n, b: stored(n, b())), name, build)
                       for name, build in jobs.items()}
            return {name: w.result() for name, w in waiting.items()}

    described = stored("structure", K.structures(tables, limits))
    facts = K.collect_facts(described)
    prepared = [K.with_dates(t, [c for c, f in facts[t.id].items() if f.is_datetime_candidate]) for t in tables]
    chosen = {t.id: (roles or {}).get(t.id) or K.roles_of(facts[t.id]) for t in tables}

    # what is computed from rows
    jobs: dict[str, Callable[[], DataFrame]] = {
        "duplicates": lambda: K.union_all([quality.table_duplicates(t) for t in prepared]),
    }
    if any(t.df.schema != p.df.schema for t, p in zip(tables, prepared)):
        # text that turned out not to be a date counts as missing: the fill is counted again
        jobs["structure_prepared"] = lambda: described.drop("non_null", "nunique", "complete_rows").join(
            F.broadcast(K.structures(prepared, limits).select(
                "table_id", "column", "non_null", "nunique", "complete_rows")), ["table_id", "column"])
    if len(tables) > 1:
        jobs["relations"] = lambda: relations.relations(prepared, facts, limits)
    for table in prepared:
        own = table_results(table, facts[table.id], chosen[table.id], limits, (plans or {}).get(table.id))
        jobs |= {f"{name}/{table.id}": build for name, build in own.items()}
    done = run(jobs)

    # what is computed from those results
    found = {t.id: {n.split("/")[0]: df for n, df in done.items() if n.endswith(f"/{t.id}")} for t in prepared}
    jobs = {"skipped_columns": lambda: quality.skipped_columns(described, limits), "quality_columns": lambda: quality.quality_columns(done.get("structure_prepared", described), limits)}
    if len(tables) > 1:
        jobs["relation_examples"] = lambda: relations.link_examples(prepared, facts, done["relations"], limits)
    for table in prepared:
        mine, own = chosen[table.id], found[table.id]
        if mine.money or mine.numeric:
            jobs[f"tests/{table.id}"] = lambda t=table, m=mine, o=own: rank_tests.rank_tests(
                t.df, m, o["associations"], limits)
        jobs[f"chart_plan/{table.id}"] = lambda t=table, o=own: charts.chart_plan(
            G.column_importance(described.where(F.col("table_id") == t.id), metrics.moments(Q.number_rows(
                t.df, [c for c, f in facts[t.id].items() if f.kind == "numeric"] or t.df.columns[:1]))),
            o["associations"], G.missing_counts(t.df), charts.discovered_charts(
                concentration.concentration_summary(o["concentration_values"]) if "concentration_values" in o else None,
                o.get("outliers"), chosen[t.id], tuple(derived.ratio_pairs(chosen[t.id].money, chosen[t.id].area)), spark))
        if "concentration_values" in own:
            jobs[f"concentration/{table.id}"] = lambda o=own: concentration.concentration_summary(o["concentration_values"])
        if "group_profiles" in own:
            jobs[f"group_ranges/{table.id}"] = lambda o=own: concentration.median_ranges(o["group_profiles"], limits)
    done |= run(jobs)

    found = {t.id: {n.split("/")[0]: df for n, df in done.items() if n.endswith(f"/{t.id}")} for t in prepared}
    jobs = {"quality_summary": lambda: quality.quality_summary(done["quality_columns"], done["duplicates"], limits)}
    if "relations" in done:
        jobs["relation_counts"] = lambda: relations.relation_counts(done["relations"])
    for table in prepared:
        mine, own = chosen[table.id], found[table.id]
        jobs |= {f"{name}/{table.id}": lambda df=df: df for name, df in charts.chart_tables(
            derived.with_ratios(table.df, mine)[0], own["chart_plan"], own.get("concentration_values")).items()}
        if WORDED & set(own):
            names = tuple(derived.ratio_pairs(mine.money, mine.area))
            jobs[f"highlights/{table.id}"] = lambda m=mine, o=own: findings.highlights(o, m, limits)
            jobs[f"table_hypotheses/{table.id}"] = lambda m=mine, o=own, n=names: findings.hypotheses(o, m, n, limits)
    done |= run(jobs)

    results = {"structure": described}
    results |= {n: done[n] for n in ("quality_columns", "skipped_columns", "quality_summary", "relations", "relation_counts", "relation_examples") if n in done}
    for name in dict.fromkeys(n.split("/")[0] for n in done if "/" in n):
        parts = [done[f"{name}/{t.id}"].select(F.lit(t.id).alias("table_id"), "*")
                 for t in prepared if f"{name}/{t.id}" in done]
        results[name] = K.union_all(parts)
    worded = [(t.name, done[f"table_hypotheses/{t.id}"]) for t in prepared if f"table_hypotheses/{t.id}" in done]
    of_links = findings.relation_hypotheses(done["relations"], limits) if "relations" in done else None
    jobs = {}
    if worded or of_links is not None:
        jobs["hypotheses"] = lambda: findings.merge_hypotheses(of_links, worded)
    if "metrics" in results:
        counts = results["metrics"].filter("metric = 'count'").join(
            F.broadcast(described.select("table_id", "column", "ordinal")), ["table_id", "column"]
        ).select("table_id", "column", "ordinal", F.col("value_double").alias("count"))
        jobs["recommendations"] = lambda: findings.recommendations(done["quality_summary"], counts, limits)
    results |= run(jobs)
    return Profile(results, facts, chosen, prepared, folder)
