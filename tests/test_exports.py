"""Exported run records: usable ones, repeated ones, and those that do not fit."""

import json

import pytest

from runscope.operators import jobs
from runscope.sources import exports


def record(run_id, **more):
    base = {"run_id": run_id, "job_id": 7, "run_name": "r", "state": {"life_cycle_state": "TERMINATED", "result_state": "FAILED"},
            "start_time": 1704067200000, "end_time": 0, "cluster_instance": {"cluster_id": "c1"}}
    return json.dumps(base | more)


TASK = {"task_key": "t", "cluster_instance": {"cluster_id": "c2"}, "state": {"result_state": "SUCCESS"}, "start_time": 1000, "end_time": 0}


@pytest.fixture
def records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    lines = [record(1, tasks=[TASK, TASK | {"task_key": "u"}]), record(2), record(3, tasks=[]), record(4, cluster_instance=None),
             "", "{broken", record("five"), json.dumps({"run_id": 6}), json.dumps({"job_id": 7}), "null",
             record(1, end_time=1704067260000, tasks=[TASK], unknown={"x": 1})]
    (tmp_path / "a" / "x.json").write_text("\n".join(lines[:6]) + "\n")
    (tmp_path / "y.json").write_text("\n".join(lines[6:]))
    return exports.exported_records(spark, str(tmp_path))


def test_runs_are_the_latest_usable_records(records):
    runs = {r.run_id: r for r in exports.runs_from_export(records).collect()}
    assert set(runs) == {1, 2, 3, 4}
    assert str(runs[1].start_time) == "2024-01-01 00:00:00" and str(runs[1].end_time) == "2024-01-01 00:01:00"
    assert runs[2].end_time is None and runs[4].cluster_id is None
    assert exports.runs_from_export(records).filter(jobs.is_failed()).count() == 4


def test_runs_without_tasks_keep_a_row(records):
    tasks = sorted((r.run_id, r.task_key or "", r.cluster_id or "") for r in exports.tasks_from_export(records).collect())
    assert tasks == [(1, "t", "c2"), (2, "", ""), (3, "", ""), (4, "", "")]


def test_records_that_do_not_fit_are_rows(records):
    found = exports.rejected_records(records).collect()
    assert sorted((r.reason, r.file_path.rsplit("/", 1)[1]) for r in found) == [
        ("no_job_id", "y.json"), ("no_run_id", "y.json"), ("not_json", "x.json"), ("not_json", "y.json"), ("not_json", "y.json")]
    assert {r.record for r in found if r.reason == "not_json"} >= {"{broken", record("five")}
    assert all(r.record for r in found)


def test_an_export_can_be_read_back(spark, folder, tmp_path):
    from runscope.sources import tables

    runs, tasks = tables.runs(spark, folder), tables.run_tasks(spark, folder)
    exports.export_records(runs, tasks).write.json(str(tmp_path / "e"))
    records = exports.exported_records(spark, str(tmp_path / "e"))
    assert exports.rejected_records(records).isEmpty()
    columns = ["run_id", "job_id", "cluster_id", "start_time", "end_time", "state"]
    assert exports.runs_from_export(records).select(*columns).exceptAll(runs.select(*columns)).isEmpty()
    assert exports.tasks_from_export(records).filter("task_key IS NOT NULL").count() == tasks.join(
        runs, "run_id", "left_semi").count()


def test_an_empty_export(spark, tmp_path):
    (tmp_path / "none.json").write_text("\n")
    records = exports.exported_records(spark, str(tmp_path))
    assert exports.runs_from_export(records).isEmpty() and exports.rejected_records(records).isEmpty()


def test_only_the_fields_asked_for_move(records):
    assert exports._latest(records, ["run_id", "tasks"]).columns == ["run_id", "tasks"]
    plan = exports.runs_from_export(records)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("max_by("):].split(" AS r#")[0]
    assert "run_name" in moved and "tasks, tasks#" not in moved.split(", named_struct(ended")[0].split(", struct(ended")[0]


def test_the_export_is_written_compressed(spark, folder):
    import bound_queries

    records = bound_queries._exported(spark, folder)
    good = [f for f in records.inputFiles() if "/good/" in f]
    assert good and all(f.endswith(".json.gz") for f in good)
