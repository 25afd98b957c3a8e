"""Findings per cluster and the way from a failed run to its likely cause."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.catalogs import (
    QUICK_CATALOG,
    RECOMMENDATIONS,
    SEARCH_CATALOG,
    Catalog,
    focus_categories,
)
from runscope.functions.classify import error_kind
from runscope.functions.text import sql_text
from runscope.operators.jobs import failed_run_rows, run_clusters
from runscope.operators.matching import (
    category_stats,
    pattern_counts,
    search_error_patterns,
    under_cap,
    unmatched_lines,
)
from runscope.operators.ranking import cut_lineage, join_checked
from runscope.operators.templates import line_templates

QUICK_CAP = 10
# What a line of trouble says, whatever its pattern.
TROUBLE = r"(?i)\b(warn|warning|error|fatal|severe|critical|exception|fail|failed|failure)\b"
RERUN_ADVICE = "Run full analysis for detailed diagnosis"


def keep_focus(matches: DataFrame, focus_areas: Iterable[str] | None) -> DataFrame:
    """Only the categories of the given areas; no areas means all."""
    if not focus_areas:
        return matches
    return matches.filter(F.col("category").isin(*focus_categories(focus_areas)))


def quick_scan(contents: DataFrame) -> DataFrame:
    """Per cluster with a hit: counts, kinds of the first five, the first three matches.

    ``critical_errors_found`` counts the matches listed, ``QUICK_CAP`` at most;
    ``total_errors`` counts all of them.
    """
    totals = pattern_counts(contents, QUICK_CATALOG).groupBy("cluster_id").agg(
        F.sum("matches").alias("total_errors"))
    found = search_error_patterns(contents, QUICK_CATALOG, QUICK_CAP, keep_order=True)
    row = F.struct("rn", error_kind(F.col("line")).alias("kind"), "line", "file", "line_number", "severity")
    # ten rows per cluster at most
    grouped = found.groupBy("cluster_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.join(totals, "cluster_id").select(
        "cluster_id", F.size("rows").cast("bigint").alias("critical_errors_found"), "total_errors",
        F.expr("array_sort(array_distinct(transform(slice(rows, 1, 5), r -> r.kind)))").alias("error_types"),
        F.expr("transform(slice(rows, 1, 3), r -> named_struct('file', r.file, 'line', r.line, "
               "'line_number', r.line_number, 'severity', r.severity))").alias("sample_errors"),
        F.lit(RERUN_ADVICE).alias("recommendation"),
    )


def critical_findings(matches: DataFrame, totals: DataFrame) -> DataFrame:
    """Per (cluster, category) with critical or else high matches, from capped matches and their totals.

    Severity follows all matches, as :func:`runscope.operators.matching.level_totals`
    counts them. ``count`` counts those of that severity among the capped
    ``matches`` of :func:`runscope.operators.matching.search_by_level`, or all if
    none of them is; ``examples`` are the first of them. :func:`findings` needs no
    capped matches.
    """
    whole = totals.groupBy("cluster_id", "category").agg(
        *[F.sum(name).alias(name) for name in ("critical_total", "high_total")])
    critical, high = F.col("severity") == "critical", F.col("severity") == "high"
    row = F.struct("level", "rn", F.struct("file", "line_number", "line", "severity").alias("m"))
    # a group holds as many rows as the caps of the levels allow
    shown = matches.groupBy("cluster_id", "category").agg(
        F.count_if(critical).alias("n_critical"), F.count_if(high).alias("n_high"),
        F.array_sort(F.collect_list(F.when(critical, row))).alias("c"),
        F.array_sort(F.collect_list(F.when(high, row))).alias("h"),
    )
    worst = F.col("critical_total") > 0
    count = F.when(worst, F.col("n_critical")).otherwise(F.col("n_high"))
    return whole.filter("critical_total + high_total > 0").join(shown, ["cluster_id", "category"], "left").select(
        "cluster_id", "category", F.when(worst, "critical").otherwise("high").alias("severity"),
        F.when(count > 0, count).when(worst, F.col("critical_total")).otherwise(F.col("high_total")).alias("count"),
        F.expr("transform(if(critical_total > 0, slice(c, 1, 3), slice(h, 1, 2)), x -> x.m)").alias("examples"),
        "critical_total", "high_total",
    )


def _over_levels(stats: DataFrame) -> DataFrame:
    """:func:`category_stats` per (cluster, category); there are as many rows in a group as levels."""
    ordered = "flatten(transform(array_sort(collect_list(struct(level, {0}))), x -> x.{0}))"
    counts = ("matches_total", "critical_total", "high_total")
    rows = stats.withColumn("matches", under_cap()).groupBy("cluster_id", "category").agg(
        *[F.sum(name).alias(name) for name in ("matches", *counts)], F.max("level").alias("deepest"),
        F.max("memory_hits").alias("memory_hits"),
        *[F.expr(ordered.format(name)).alias(name) for name in ("critical", "high")])
    worst = F.col("critical_total") > 0
    return rows.select(
        "cluster_id", "category", "matches", "deepest", "memory_hits", *counts,
        F.when(worst, "critical").when(F.col("high_total") > 0, "high").alias("severity"),
        F.when(worst, F.col("critical_total")).otherwise(F.col("high_total")).alias("count"),
        F.expr("if(critical_total > 0, slice(critical, 1, 3), slice(high, 1, 2))").alias("examples"))


def findings(stats: DataFrame) -> DataFrame:
    """Per (cluster, category): the critical matches if there are any, else the high ones; all are counted.

    ``stats`` is :func:`runscope.operators.matching.category_stats`, perhaps
    with :func:`keep_focus`.
    """
    return _over_levels(stats).filter("severity IS NOT NULL").select(
        "cluster_id", "category", "severity", "count", "examples", "critical_total", "high_total")


def _out_of_memory() -> Column:
    return (F.col("category") == "critical_errors") & F.lower("line").contains("outofmemory")


def recommendations(matches: DataFrame) -> DataFrame:
    """Per cluster: advice for the categories that have a match.

    Takes match rows, or the rows of :func:`runscope.operators.matching.category_stats`,
    which know all matches. A critical out-of-memory line counts as a memory issue
    instead, because the search stops before the memory patterns when it finds one.
    """
    advice = "map(" + ", ".join(f"{sql_text(c)}, {sql_text(t)}" for c, t in RECOMMENDATIONS) + ")"
    if "memory_hits" in matches.columns:
        named = F.explode(F.when(F.col("memory_hits"), F.array(F.lit("memory_issues"), "category")).otherwise(F.array("category")))
    else:
        named = F.when(_out_of_memory(), "memory_issues").otherwise(F.col("category"))
    return (
        matches.select("cluster_id", named.alias("category"))
        .filter(F.col("category").isin(*[c for c, _ in RECOMMENDATIONS]))
        .distinct()
        .withColumn("recommendation", F.element_at(F.expr(advice), F.col("category")))
    )


def smart_analysis(
    contents: DataFrame, focus_areas: Sequence[str] | None = None, max_levels: int = 3
) -> DataFrame:
    """One row per cluster with a match: findings, counts, levels used and advice.

    Severities, the ``count`` of a finding and what ends in ``_total`` follow all
    matches; ``total_errors`` and ``matches`` are what the caps of the levels show.
    """
    stats = _over_levels(keep_focus(category_stats(contents, max_levels=max_levels), focus_areas)).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(
            F.struct("category", "matches", "severity", "count", "examples",
                     "matches_total", "critical_total", "high_total")
        )).alias("s"),
        F.sum("matches_total").alias("errors_total"),
        F.max("memory_hits").alias("memory_hits"), F.sum("matches").alias("total_errors"),
        F.max("deepest").alias("deepest_level"),
    )
    advice = []
    for category, text in RECOMMENDATIONS:
        seen = f"exists(s, x -> x.category = {sql_text(category)})"
        if category == "memory_issues":
            seen += " OR memory_hits"
        advice.append(f"if({seen}, {sql_text(text)}, NULL)")
    return stats.select(
        "cluster_id", "total_errors", "errors_total", "deepest_level",
        F.transform("s", lambda x: F.struct(
            x.category.alias("category"), x.matches.alias("matches"), x.matches_total.alias("matches_total")))
        .alias("error_breakdown"),
        F.transform(F.filter("s", lambda x: x.severity.isNotNull()), lambda x: F.struct(
            x.category.alias("category"), x.severity.alias("severity"), x["count"].alias("count"),
            x.examples.alias("examples"), x.critical_total.alias("critical_total"),
            x.high_total.alias("high_total"),
        )).alias("critical_findings"),
        F.expr(f"array_compact(array({', '.join(advice)}))").alias("recommendations"),
    )


def failure_diagnosis(
    jobs: DataFrame,
    runs: DataFrame,
    tasks: DataFrame,
    contents: DataFrame,
    as_of: str,
    name_pattern: str | None = None,
    hours_back: float = 24,
    focus_areas: Sequence[str] | None = None,
    limit: int | None = 20,
) -> DataFrame:
    """Failed runs, the clusters they used, and what the logs of those clusters show.

    One row per (run, cluster, category with critical or high matches). Only
    the logs of affected clusters are searched, and each cluster is reduced to
    a few findings before it meets the runs again. ``limit`` is that of
    :func:`runscope.operators.jobs.failed_runs`; ``None`` looks at all runs.
    """
    found = failed_run_rows(jobs, runs, as_of, name_pattern, hours_back, limit)
    return diagnosis_of(found, tasks, contents, focus_areas)


def diagnosis_of(
    failed: DataFrame, tasks: DataFrame, contents: DataFrame, focus_areas: Sequence[str] | None = None
) -> DataFrame:
    """:func:`failure_diagnosis` of given failed runs; the logs are semi-joined with the clusters these used."""
    # slim rows that are needed three times below
    failed = cut_lineage(failed.select("run_id", "job_id", "job_name", "start_time", "cluster_id", "state"))
    used = cut_lineage(run_clusters(failed, tasks))
    affected = join_checked(
        contents, used.select("cluster_id").distinct(), ["cluster_id"], "left_semi"
    )
    found = findings(keep_focus(category_stats(affected), focus_areas))
    named = failed.select("run_id", "job_id", "job_name", "start_time", "state.result_state",
                          "state.life_cycle_state")
    advice = "map(" + ", ".join(f"{sql_text(c)}, {sql_text(t)}" for c, t in RECOMMENDATIONS) + ")"
    return (
        used.join(found, "cluster_id").join(named, "run_id")
        .withColumn("recommendation", F.try_element_at(F.expr(advice), F.col("category")))
        .select(
            "run_id", "job_id", "job_name", "start_time", "result_state", "life_cycle_state",
            "cluster_id", "category", "severity", "count", "examples", "critical_total", "high_total",
            "recommendation",
        )
    )


def common_failure_patterns(
    jobs: DataFrame,
    runs: DataFrame,
    tasks: DataFrame,
    contents: DataFrame,
    as_of: str,
    hours_back: float = 24,
    catalog: Catalog = SEARCH_CATALOG,
    limit: int | None = 20,
) -> DataFrame:
    """How often each pattern occurs in the logs of clusters with recent failures.

    ``limit`` is that of :func:`runscope.operators.jobs.failed_runs`; ``None`` looks at all runs.
    """
    affected = _affected(jobs, runs, tasks, contents, as_of, hours_back, limit)
    return (
        pattern_counts(affected, catalog)
        .groupBy("category", "pattern")
        .agg(F.sum("matches").alias("matches"), F.count("*").alias("files"))
        .orderBy(F.desc("matches"), "category", "pattern")
    )


def failure_templates(
    jobs: DataFrame,
    runs: DataFrame,
    tasks: DataFrame,
    contents: DataFrame,
    as_of: str,
    hours_back: float = 24,
    catalog: Catalog = SEARCH_CATALOG,
    limit: int | None = 20,
    looks_like: str | None = TROUBLE,
) -> DataFrame:
    """Common errors that no pattern names: templates of the other lines in the logs of clusters with recent failures.

    ``looks_like`` tells which lines count, ``None`` takes all; for the columns see
    :func:`runscope.operators.templates.line_templates`.
    """
    affected = _affected(jobs, runs, tasks, contents, as_of, hours_back, limit)
    return line_templates(unmatched_lines(affected, catalog, looks_like))


def _affected(
    jobs: DataFrame, runs: DataFrame, tasks: DataFrame, contents: DataFrame, as_of: str, hours_back: float, limit: int | None
) -> DataFrame:
    """The logs of clusters that recently failed runs used."""
    found = failed_run_rows(jobs, runs, as_of, None, hours_back, limit)
    failed = cut_lineage(found.select("run_id", "cluster_id"))
    hit = run_clusters(failed, tasks).select("cluster_id").distinct()
    return join_checked(contents, hit, ["cluster_id"], "left_semi")
