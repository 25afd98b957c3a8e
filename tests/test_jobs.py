"""Jobs, runs, tasks and clusters, and the way to a diagnosis."""

import datetime as dt

import pytest

from runscope.functions import timespan
from runscope.operators import jobs, matching
from runscope.plans import diagnose

NOW = "2024-01-10 00:00:00"
RUN = (
    "run_id BIGINT, job_id BIGINT, cluster_id STRING, run_name STRING, "
    "state STRUCT<life_cycle_state: STRING, result_state: STRING, state_message: STRING>, "
    "start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, execution_duration BIGINT, creator_user_name STRING"
)


def run(run_id, job_id, result, start, life="TERMINATED", cluster=None):
    begin = dt.datetime.strptime(start, timespan.FORMAT) if start else None
    return (run_id, job_id, cluster, f"r{run_id}", (life, result, None), begin, None, 1500, "me")


@pytest.fixture
def model(spark):
    named = spark.createDataFrame(
        [(1, "daily_ETL"), (2, "report"), (3, None)], "job_id BIGINT, job_name STRING"
    )
    runs = spark.createDataFrame([
        run(10, 1, "FAILED", "2024-01-09 12:00:00", cluster="c1"),
        run(11, 1, "SUCCESS", "2024-01-09 13:00:00"),
        run(12, 1, None, "2024-01-09 14:00:00", "INTERNAL_ERROR"),
        run(13, 1, None, "2024-01-09 15:00:00", "RUNNING"),
        run(14, 2, "TIMEOUT", "2024-01-09 16:00:00", cluster="c2"),
        run(15, 2, "CANCELED", "2024-01-01 00:00:00"),
        run(16, 3, "FAILED", "2024-01-09 17:00:00"),
    ], RUN)
    tasks = spark.createDataFrame(
        [(10, "a", "c1"), (10, "b", "c3"), (12, "a", None), (14, "a", "c4"), (99, "z", "c9")],
        "run_id BIGINT, task_key STRING, cluster_id STRING",
    )
    return named, runs, tasks


def ids(df):
    return [r.run_id for r in df.collect()]


def test_job_names_ignore_case_and_null(model):
    named, _, _ = model
    assert [r.job_id for r in jobs.search_jobs(named, "etl$").collect()] == [1]
    assert jobs.search_jobs(named, ".*").count() == 2


def test_failed_runs(model):
    named, runs, _ = model
    assert ids(jobs.failed_runs(named, runs, NOW)) == [16, 14, 12, 10]
    assert ids(jobs.failed_runs(named, runs, NOW, "daily")) == [12, 10]
    assert ids(jobs.failed_runs(named, runs, NOW, None, 24 * 30)) == [16, 14, 12, 10, 15]


def test_limit_applies_before_the_failure_filter(model):
    named, runs, _ = model
    assert ids(jobs.failed_runs(named, runs, NOW, "daily", limit=2)) == [12]
    assert ids(jobs.failed_runs(named, runs, NOW, "daily", limit=None)) == [12, 10]


def test_job_runs_default_range_and_limit(model):
    _, runs, _ = model
    assert sorted(ids(jobs.job_runs(runs, as_of=NOW))) == [10, 11, 12, 13, 14, 16]
    assert sorted(ids(jobs.job_runs(runs, as_of=NOW, limit=1))) == [13, 14, 16]
    with pytest.raises(ValueError):
        jobs.job_runs(runs)


def test_details_keep_runs_without_tasks(model):
    _, runs, tasks = model
    rows = jobs.run_details(runs, tasks).collect()
    got = sorted((r.run_id, r.task.task_key if r.task else "") for r in rows)
    assert got == [(10, "a"), (10, "b"), (11, ""), (12, "a"), (13, ""), (14, "a"), (15, ""), (16, "")]


def test_cluster_ids_come_from_runs_and_tasks(model):
    named, runs, tasks = model
    span = timespan.look_back(NOW)
    got = jobs.cluster_ids_for_job(named, runs, tasks, "etl|report", span)
    assert sorted(r.cluster_id for r in got.collect()) == ["c1", "c2", "c3", "c4"]


def test_timeline_has_both_durations(model):
    named, runs, _ = model
    row = jobs.execution_timeline(named, runs, "report", NOW).first()
    assert (row.run_id, row.execution_duration_ms, row.duration_seconds) == (14, 1500, 1.5)


def test_time_arguments():
    assert timespan.resolve_range(None, None, NOW) == ("2024-01-09 00:00:00", NOW)
    assert timespan.resolve_range("2024-01-01 00:00:00", None, NOW) == ("2024-01-01 00:00:00", NOW)
    both = ("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert timespan.resolve_range(*both, NOW) == both
    with pytest.raises(ValueError):
        timespan.resolve_range(None, NOW, NOW)
    with pytest.raises(ValueError):
        timespan.resolve_range("yesterday", None, NOW)


def test_exported_records_become_runs_and_tasks(spark):
    raw = spark.createDataFrame([
        (1, 7, ("c1",), "n", ("TERMINATED", "FAILED", "m"), 1704067200000, 0, 5, "me",
         [("t1", ("c2",), ("TERMINATED", None), None, 1704067201000)]),
        (2, 7, None, "n", None, None, None, None, None, None),
    ], """run_id BIGINT, job_id BIGINT, cluster_instance STRUCT<cluster_id: STRING>, run_name STRING,
          state STRUCT<life_cycle_state: STRING, result_state: STRING, state_message: STRING>,
          start_time BIGINT, end_time BIGINT, execution_duration BIGINT, creator_user_name STRING,
          tasks ARRAY<STRUCT<task_key: STRING, cluster_instance: STRUCT<cluster_id: STRING>,
            state: STRUCT<life_cycle_state: STRING, result_state: STRING>, start_time: BIGINT, end_time: BIGINT>>""")
    one, two = jobs.project_runs(raw).orderBy("run_id").collect()
    assert (one.cluster_id, one.start_time, one.end_time) == ("c1", dt.datetime(2024, 1, 1), None)
    assert (two.cluster_id, two.start_time, two.state.result_state) == (None, None, None)
    task = jobs.project_tasks(raw).collect()
    assert [(t.run_id, t.task_key, t.cluster_id, t.end_time) for t in task] == [
        (1, "t1", "c2", dt.datetime(2024, 1, 1, 0, 0, 1))
    ]


def test_diagnosis_joins_runs_with_findings(model, contents_of):
    named, runs, tasks = model
    contents = contents_of({
        "c1/stderr": "fine", "c3/stderr": "OutOfMemoryError", "c4/stderr": "permission denied exception",
        "c9/stderr": "FATAL ERROR",
    })
    rows = diagnose.failure_diagnosis(named, runs, tasks, contents, NOW).collect()
    assert sorted((r.run_id, r.cluster_id, r.category, r.severity, r["count"]) for r in rows) == [
        (10, "c3", "critical_errors", "high", 1), (14, "c4", "io_errors", "high", 1),
    ]
    assert [r.recommendation is not None for r in sorted(rows)] == [False, True]
    common = diagnose.common_failure_patterns(named, runs, tasks, contents, NOW).collect()
    assert {r.category for r in common} == {"critical_errors", "memory_issues", "io_errors"}


def test_findings_prefer_critical_matches(contents_of):
    body = "\n".join(["FATAL ERROR"] * 5 + ["segmentation fault"] + ["connection refused: failed"] * 4)
    rows = diagnose.smart_analysis(contents_of({"c1/stderr": body, "c2/stderr": body.lower()[66:]})).collect()
    got = {r.cluster_id: r for r in rows}
    first = got["c1"].critical_findings
    assert [(f.category, f.severity, f["count"], len(f.examples)) for f in first] == [
        ("critical_errors", "critical", 6, 3)
    ]
    assert got["c1"].deepest_level == 1


def test_recommendations_need_a_match(contents_of):
    contents = contents_of({"c1/stderr": "OutOfMemoryError", "c2/stderr": "connection refused"})
    rows = {r.cluster_id: r for r in diagnose.smart_analysis(contents).collect()}
    assert len(rows["c1"].recommendations) == 1 and "emory" in rows["c1"].recommendations[0]
    assert rows["c2"].recommendations == []


def test_focus_areas(contents_of):
    contents = contents_of({"c2/stderr": "connection refused\npermission denied\ninvalid credentials"})
    rows = diagnose.smart_analysis(contents, ["io", "authentication_errors", "no_such_area"]).first()
    assert [b.category for b in rows.error_breakdown] == ["authentication_errors", "io_errors"]


def test_quick_scan_counts_beyond_its_cap(contents_of):
    rows = diagnose.quick_scan(contents_of({"c1/stderr": "FATAL ERROR\n" * 25, "c2/stderr": "all well"})).collect()
    assert [(r.cluster_id, r.critical_errors_found, r.total_errors) for r in rows] == [("c1", 10, 25)]


def test_totals_count_beyond_the_caps_of_levels(contents_of):
    contents = contents_of({"c1/stderr": "FATAL ERROR\n" * 200, "c2/stderr": "all well"})
    totals = matching.level_totals(contents)
    all_of = sum(r.matches_total for r in totals.collect())
    assert all_of >= 200
    row = diagnose.smart_analysis(contents).first()
    assert row.errors_total == all_of and row.total_errors < row.errors_total
    found = diagnose.critical_findings(matching.search_by_level(contents, keep_order=True), totals).first()
    assert (found["count"], found.critical_total) == (20, 200)
    first = matching.level_summary(contents).filter("cluster_id = 'c1' and iteration = 1").first()
    assert first.errors_total == all_of
