"""Log excerpts around the lines that match a regular expression.

Works on ``log_contents``; a file is one bounded row, so no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.catalogs import required_text
from runscope.functions.text import sql_text

LINE_FLAGS = "(?id)"


def context_snippets(
    contents: DataFrame, pattern: str, max_lines: int = 100, around_lines: int = 5
) -> DataFrame:
    """Per file with a hit: every matching line with its neighbours, numbered.

    The hit is marked ``>>>`` and each window ends with ``---``; windows may
    overlap and then repeat lines. The snippet holds ``2 * max_lines`` lines at
    most; ``lines_matched`` counts all hits of the file.
    """
    word = required_text(pattern)
    wanted = contents if word is None else contents.filter(F.lower("content").contains(word))
    regex, limit, k = sql_text(LINE_FLAGS + pattern), 2 * max_lines, around_lines
    numbered = wanted.select(
        "cluster_id", "file_path", "file_name", "log_type",
        F.split("content", "\n", -1).alias("l"),
    )
    hits = numbered.withColumn(
        "h", F.expr(f"filter(sequence(1, size(l)), i -> element_at(l, i) RLIKE {regex})")
    )
    window = (
        f"transform(sequence(greatest(i - {k}, 1), least(i + {k}, size(l))), "
        "j -> format_string('%s %4d: %s', if(j = i, '>>>', '   '), j, element_at(l, j)))"
    )
    # every hit adds two lines or more, so max_lines hits fill the snippet
    text = (
        f"array_join(slice(flatten(transform(slice(h, 1, {max_lines}), "
        f"i -> concat({window}, array('---')))), 1, {limit}), '\\n')"
    )
    # a filter on the hits would search every line twice; files without hits
    # leave through an empty list instead
    found = (
        f"inline_outer(if(size(h) > 0, array(named_struct('matches', {text}, "
        "'lines_matched', CAST(size(h) AS BIGINT))), array()))"
    )
    return hits.select(
        "cluster_id", "file_path", "file_name", "log_type", F.expr(found)
    ).filter("matches IS NOT NULL")


def head_snippets(contents: DataFrame, max_lines: int = 100) -> DataFrame:
    """First ``max_lines`` lines of every file, numbered."""
    text = (
        f"array_join(transform(slice(split(content, '\\n', -1), 1, {max_lines}), "
        "(x, i) -> format_string('%4d: %s', i + 1, x)), '\\n')"
    )
    return contents.select(
        "cluster_id", "file_path", "file_name", "log_type", F.expr(text).alias("snippet")
    )


def search_log_pattern(
    contents: DataFrame,
    pattern: str,
    log_types: Sequence[str] | None = None,
    max_lines: int = 50,
    around_lines: int = 3,
) -> DataFrame:
    """Snippets of all files, or of the files of some types, that match ``pattern``."""
    if log_types:
        contents = contents.filter(F.col("log_type").isin(*log_types))
    return context_snippets(contents, pattern, max_lines, around_lines)


def pattern_totals(
    contents: DataFrame, pattern: str, log_types: Sequence[str] | None = None
) -> DataFrame:
    """Per cluster: how many files and how many lines match ``pattern``."""
    found = search_log_pattern(contents, pattern, log_types)
    return found.groupBy("cluster_id").agg(
        F.count("*").alias("files_matched"), F.sum("lines_matched").alias("lines_matched")
    )


def line_windows(lines: DataFrame, pattern: str, around_lines: int = 5) -> DataFrame:
    """The same search on ``log_lines``, for files too large for one row.

    A hit names the line numbers it needs and an equi-join fetches them, so a
    file of any size is spread over tasks. One output row per (hit, line).
    """
    k = around_lines
    hits = lines.filter(F.col("line").rlike(LINE_FLAGS + pattern)).select(
        "cluster_id", "file_path", F.col("line_number").alias("hit_line"),
        F.explode(F.expr(f"sequence(greatest(line_number - {k}, 1), line_number + {k})"))
        .alias("line_number"),
    )
    return hits.join(lines, ["cluster_id", "file_path", "line_number"]).select(
        "cluster_id", "file_path", "hit_line", "line_number",
        F.format_string(
            "%s %4d: %s", F.when(F.col("hit_line") == F.col("line_number"), ">>>").otherwise("   "),
            "line_number", "line",
        ).alias("text"),
    )
