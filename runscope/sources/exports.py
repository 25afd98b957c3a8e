"""Run records as a scheduler exports them: nested JSON lines, with a channel for records that do not fit.

A record has epoch milliseconds, its cluster in ``cluster_instance`` and its tasks
in an array. The schema is enforced while lines are parsed, so nothing is inferred
and only the fields below are built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.functions.timespan import to_millis
from runscope.operators.jobs import project_runs, project_tasks

STATE = "STRUCT<life_cycle_state: STRING, result_state: STRING, state_message: STRING>"
CLUSTER = "STRUCT<cluster_id: STRING>"
RECORD = (
    "run_id BIGINT, job_id BIGINT, run_name STRING, creator_user_name STRING, "
    f"cluster_instance {CLUSTER}, state {STATE}, start_time BIGINT, end_time BIGINT, execution_duration BIGINT, "
    f"tasks ARRAY<STRUCT<task_key: STRING, cluster_instance: {CLUSTER}, state: {STATE}, "
    "start_time: BIGINT, end_time: BIGINT>>"
)
CORRUPT = "_corrupt_record"
ADDED = ("reason", "file_path", CORRUPT)     # columns that are no fields of a record


def exported_records(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path`` with ``reason``, which is null for usable ones.

    ``not_json``: the line is no record of this schema, wrong types included;
    ``no_run_id``, ``no_job_id``: a key is missing. Blank lines are no records.
    """
    raw = (
        spark.read.schema(f"{RECORD}, {CORRUPT} STRING").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", "true").json(path)
    )
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "not_json").when(F.col("run_id").isNull(), "no_run_id")
        .when(F.col("job_id").isNull(), "no_job_id")
    )
    return raw.withColumns({"reason": reason, "file_path": F.col("_metadata.file_path")})


def runs_from_export(records: DataFrame) -> DataFrame:
    """The usable records as runs; of records of one run the one that ended last counts.

    An export that is repeated while a run goes on holds it several times. Records
    of a run are compared as slim rows; a run has few, however many tasks.
    """
    return project_runs(_latest(records, [c for c in records.columns if c not in (*ADDED, "tasks")]))


def tasks_from_export(records: DataFrame) -> DataFrame:
    """One row per task of the runs of :func:`runs_from_export`; a run without tasks keeps one row of nulls."""
    return project_tasks(_latest(records, ["run_id", "tasks"]), keep_empty=True)


def _latest(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The given fields of the record that counts of each run; nothing else of a record moves."""
    rank = F.struct(
        (F.coalesce(F.nullif(F.col("end_time"), F.lit(0)), F.lit(-1))).alias("ended"),
        F.coalesce(F.size("tasks"), F.lit(-1)).alias("n_tasks"),
        F.xxhash64(F.to_json(F.struct("state", "tasks", "cluster_instance"))).alias("tie"))
    return records.filter("reason IS NULL").groupBy("run_id").agg(
        F.max_by(F.struct(*fields), rank).alias("r")).select("r.*")


def rejected_records(records: DataFrame) -> DataFrame:
    """Records that are left out: ``file_path, reason, record``, as they stand in the file where they are no JSON."""
    fields = [c for c in records.columns if c not in ADDED]
    text = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*fields)))
    return records.filter("reason IS NOT NULL").select("file_path", "reason", text.alias("record"))


def export_records(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs and tasks in the form of an export, one nested record a run.

    A run's tasks meet in one row, so this is for runs of a size that an export
    can hold; the tables themselves have no such bound.
    """
    own = tasks.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(
        "task_key", F.struct("cluster_id").alias("cluster_instance"), "state",
        F.coalesce(to_millis("start_time"), F.lit(0)).alias("start_time"),
        F.coalesce(to_millis("end_time"), F.lit(0)).alias("end_time")))).alias("tasks"))
    return runs.join(own, "run_id", "left").select(
        "run_id", "job_id", "run_name", "creator_user_name",
        F.struct(F.coalesce("cluster_id", F.lit("")).alias("cluster_id")).alias("cluster_instance"), "state",
        F.coalesce(to_millis("start_time"), F.lit(0)).alias("start_time"),
        F.coalesce(to_millis("end_time"), F.lit(0)).alias("end_time"), "execution_duration", "tasks")
