"""Classification of files and lines as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runscope.catalogs import ANALYSIS_FILE_ORDER, SEARCH_FILE_ORDER
from runscope.functions.text import basename

# Words that decide the severity of a matched line, and the
# categories that decide it when no word does.
CRITICAL_WORDS = ("fatal", "critical", "panic", "crash", "segmentation fault", "core dumped")
HIGH_WORDS = ("outofmemoryerror", "failed", "exception", "severe")
HIGH_CATEGORIES = ("memory_issues", "critical_errors", "spark_errors")
MEDIUM_CATEGORIES = ("application_errors", "io_errors", "authentication_errors")

# First time stamp of a line.
TIMESTAMP_PATTERN = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}"

_NAME_TYPES = ("stderr", "stdout", "log4j", "driver", "executor")


def log_type(file_path: Column, compressed: bool = True) -> Column:
    """Type of a log file from its base name; ``compressed=False`` folds .gz into unknown."""
    name = F.lower(basename(file_path))
    chain = F
    for kind in _NAME_TYPES:
        chain = chain.when(name.contains(kind), kind)
    if compressed:
        chain = chain.when(name.endswith(".gz"), "compressed")
    return chain.otherwise("unknown")


def type_rank(kind: Column, order: tuple[str, ...]) -> Column:
    """0-based place of a log type in ``order``; 99 for the others."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), kind)
    return F.when(place > 0, place - 1).otherwise(99).cast("int")


def search_rank(kind: Column) -> Column:
    return type_rank(kind, SEARCH_FILE_ORDER)


def analysis_rank(kind: Column) -> Column:
    return type_rank(kind, ANALYSIS_FILE_ORDER)


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def match_severity(line: Column, category: Column) -> Column:
    low = F.lower(line)
    return (
        F.when(any_word(low, CRITICAL_WORDS), "critical")
        .when(any_word(low, HIGH_WORDS) | category.isin(*HIGH_CATEGORIES), "high")
        .when(category.isin(*MEDIUM_CATEGORIES), "medium")
        .otherwise("low")
    )


def line_timestamp(line: Column) -> Column:
    """The first time stamp of a line as text, null when there is none."""
    return F.nullif(F.regexp_extract(line, TIMESTAMP_PATTERN, 0), F.lit(""))


def line_event_time(line: Column) -> Column:
    """The same as a typed TIMESTAMP_NTZ, null when it is no valid time."""
    text = F.translate(line_timestamp(line), "T\t", "  ")
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def error_kind(line: Column) -> Column:
    """Tag of a line in the quick scan."""
    low = F.lower(line)
    return (
        F.when(low.contains("outofmemory"), "Memory Issues")
        .when(low.contains("job") & low.contains("failed"), "Job Failures")
        .when(low.contains("analysisexception"), "SQL Errors")
        .otherwise("Critical Errors")
    )


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "critical", 4).when(severity == "high", 3)
        .when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)
    )
