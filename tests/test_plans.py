"""Plans hold no Python stage, no cross join, limits before shuffles, one text pass."""

import re

import pytest

from bound_queries import QUERIES
from runscope.operators import chunking, matching
from runscope.sources import tables

TEXT_QUERIES = [
    "pattern_matches", "search_error_patterns", "search_leveled", "pattern_counts", "snippet_context",
    "search_log_pattern", "quick_scan", "smart_analysis", "chunk_split", "chunk_score",
    "error_summary", "log_lines_numbered", "top_chunk_keys",
]
# Plans that a query hides behind a checkpoint.
PARTS = {
    "top_chunk_keys": lambda spark, folder: chunking.top_chunk_keys(tables.event_contents(spark, folder), 10, None, 5),
}


PLANS: dict[str, str] = {}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, folder, name):
    if name not in PLANS:
        PLANS[name] = plan_of((QUERIES | PARTS)[name](spark, folder))
    return PLANS[name]


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream_", "file_"))])
def test_no_python_and_no_cross_join(spark, folder, name):
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in plan(spark, folder, name), node


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_no_filter_repeats_the_text_work(spark, folder, name):
    for line in plan(spark, folder, name).splitlines():
        if re.search(r"[-:] (\*\(\d+\) )?Filter ", line):
            assert "regexp_extract_all" not in line and "split(" not in line, line[:300]


@pytest.mark.parametrize("name", ["search_error_patterns", "search_leveled", "top_chunk_keys", "job_runs", "failed_runs"])
def test_limits_are_applied_before_the_shuffle(spark, folder, name):
    text = plan(spark, folder, name)
    assert text.count("WindowGroupLimit") >= 4
    assert "Partial" in text


def test_ranking_chunks_moves_no_text(spark, folder):
    text = plan(spark, folder, "top_chunk_keys")
    shuffled = text.split("Exchange hashpartitioning(cluster_id")[0]
    assert "content" not in shuffled


def test_time_range_reaches_the_scan(spark, folder):
    text = plan(spark, folder, "job_runs")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)


def test_only_needed_columns_are_read(spark, folder):
    text = plan_of(tables.event_contents(spark, folder).select("cluster_id").distinct())
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "props" not in schema and "value" not in schema


def test_equal_patterns_of_the_levels_run_once(spark, folder):
    found = matching.search_by_level(tables.document_contents(spark, folder))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") <= 62
