"""Text reports and JSON output.

Report columns expect the arrays built in :mod:`runscope.plans.analysis`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.functions.text import TRUNCATED, excerpt, quoted_list

# Headings and line formats of the two reports.
STANDARD_TITLE = "=== LOG ANALYSIS SUMMARY ===\n"
STANDARD_ERRORS = "IDENTIFIED ERRORS:"
STANDARD_ERROR_LINE = "• %s (%s): Found %d occurrences"
STANDARD_EXCERPTS = "MOST RELEVANT LOG EXCERPTS:"
ITERATIVE_TITLE = "=== ITERATIVE LOG ANALYSIS SUMMARY ==="
ITERATIVE_ROUNDS = "Analysis completed in %d iterations\n"
ITERATIVE_BREAKDOWN = "ITERATION BREAKDOWN:"
ITERATIVE_ROUND_LINE = "Iteration %d: %d errors found, %d chunks analyzed, %.1f tokens used"
ITERATIVE_CRITICAL = "🚨 CRITICAL ERRORS DETECTED:"
ITERATIVE_HIGH = "⚠️  HIGH PRIORITY ERRORS:"
ITERATIVE_ERROR_LINE = "• %s: %d occurrences"
ITERATIVE_EXCERPTS = "📋 MOST RELEVANT LOG EXCERPTS:"
SOLUTION_LINE = "  Solution: %s..."
EXCERPT_LINE = "\n--- Excerpt %d from %s ---"
SCORE_LINE = "Priority: %.2f | Errors: %s"


def _excerpts(chunks: Column, count: int, chars: int) -> Column:
    return F.flatten(F.transform(F.slice(chunks, 1, count), lambda c, i: F.array(
        F.format_string(EXCERPT_LINE, i + 1, c.file_name),
        F.format_string(SCORE_LINE, c.priority_score, quoted_list(c.error_indicators)),
        excerpt(c.content, chars),
    )))


def _section(title: str, lines: Column, closing: bool = False) -> Column:
    """Title and lines, nothing at all when there are no lines."""
    end = [F.array(F.lit(""))] if closing else []
    return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), lines, *end)).otherwise(
        F.array().cast("array<string>")
    )


def standard_report() -> Column:
    """Top five errors and top five chunks of one cluster."""
    errors = F.flatten(F.transform(F.slice("error_summary", 1, 5), lambda e: F.array(
        F.format_string(STANDARD_ERROR_LINE, F.upper(e.error_type), e.severity, e.frequency),
        F.format_string(SOLUTION_LINE, F.substring(e.suggested_solution, 1, 200)),
        F.lit(""),
    )))
    return F.array_join(F.concat(
        F.array(F.lit(STANDARD_TITLE)),
        _section(STANDARD_ERRORS, errors),
        F.array(F.lit(STANDARD_EXCERPTS)),
        _excerpts(F.col("prioritized_chunks"), 5, 1000),
    ), "\n")


def iterative_report() -> Column:
    """Rounds, all critical and three high errors, three different best chunks."""
    rounds = F.transform("iteration_breakdown", lambda r: F.format_string(
        ITERATIVE_ROUND_LINE, r.iteration, r.errors_found, r.chunks_analyzed, r.token_usage
    ))

    def errors(severity: str) -> Column:
        return F.filter("error_summary", lambda e: e.severity == severity)

    def lines(found: Column) -> Column:
        return F.flatten(F.transform(found, lambda e: F.array(
            F.format_string(ITERATIVE_ERROR_LINE, F.upper(e.error_type), e.frequency),
            F.format_string(SOLUTION_LINE, F.substring(e.suggested_solution, 1, 150)),
        )))

    # a chunk kept by several rounds appears once, with its highest score
    ordered = F.array_sort(F.transform("chunks", lambda c, i: F.struct(
        (-c.priority_score).alias("neg"), i.alias("i"), c.alias("c")
    )))
    best = F.filter(
        F.transform(ordered, lambda x, i: F.struct(
            i.alias("i"), x.c.alias("c"), F.concat_ws("#", x.c.file_path, x.c.chunk_no).alias("key")
        )),
        lambda x: ~F.exists(
            F.slice(ordered, F.lit(1), x.i),
            lambda y: F.concat_ws("#", y.c.file_path, y.c.chunk_no) == x.key,
        ),
    )
    return F.array_join(F.concat(
        F.array(F.lit(ITERATIVE_TITLE), F.format_string(ITERATIVE_ROUNDS, "total_iterations")),
        F.array(F.lit(ITERATIVE_BREAKDOWN)), rounds, F.array(F.lit("")),
        _section(ITERATIVE_CRITICAL, lines(errors("critical")), closing=True),
        _section(ITERATIVE_HIGH, lines(F.slice(errors("high"), 1, 3)), closing=True),
        F.array(F.lit(ITERATIVE_EXCERPTS)),
        _excerpts(F.transform(best, lambda x: x.c), 3, 800),
    ), "\n")


def with_message(
    requested: DataFrame, results: DataFrame, text: str, message: str, key: str = "cluster_id"
) -> DataFrame:
    """One row per requested key: its result text, or ``message`` when it has none."""
    found = results.select(key, text)
    return requested.select(key).distinct().join(found, key, "left").withColumn(
        text, F.coalesce(F.col(text), F.format_string(message, F.col(key)))
    )


def json_rows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One JSON document per row, next to the given key columns.

    A result of any size is written as JSON lines; it never becomes one string.
    """
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.text(path)


def result_counts(df: DataFrame, *keys: str, name: str = "total") -> DataFrame:
    """Row count per key, the header that goes with :func:`json_rows`."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


__all__ = [
    "TRUNCATED", "iterative_report", "json_rows", "result_counts", "standard_report",
    "with_message", "write_json", "write_text",
]
