"""Jobs, runs, tasks and clusters as joins, filters and per-job windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.functions.timespan import (
    DEFAULT_DAYS,
    DEFAULT_HOURS,
    TimeRange,
    from_millis,
    in_range,
    look_back,
)
from runscope.operators.ranking import top_n_per_group

# States that count as failed.
FAILED_RESULTS = ("FAILED", "CANCELED", "TIMEOUT")
FAILED_LIFE_CYCLES = ("INTERNAL_ERROR",)


def search_jobs(jobs: DataFrame, name_pattern: str) -> DataFrame:
    """Jobs whose name contains a match, ignoring case; a null name never matches."""
    return jobs.filter(F.col("job_name").rlike("(?i)" + name_pattern))


def is_failed() -> Column:
    failed = F.col("state.result_state").isin(*FAILED_RESULTS) | F.col(
        "state.life_cycle_state"
    ).isin(*FAILED_LIFE_CYCLES)
    return F.coalesce(failed, F.lit(False))


def project_runs(raw: DataFrame) -> DataFrame:
    """Run records as exported (epoch milliseconds, nested cluster) in model form."""
    return raw.select(
        "run_id", "job_id",
        F.nullif(F.col("cluster_instance.cluster_id"), F.lit("")).alias("cluster_id"),
        "run_name",
        F.struct("state.life_cycle_state", "state.result_state", "state.state_message").alias("state"),
        from_millis("start_time").alias("start_time"), from_millis("end_time").alias("end_time"),
        "execution_duration", "creator_user_name",
    )


def project_tasks(raw: DataFrame, keep_empty: bool = False) -> DataFrame:
    """The nested tasks of exported run records, one row per task.

    ``keep_empty`` keeps a run without tasks as a row whose other columns are null.
    """
    each = F.explode_outer("tasks") if keep_empty else F.explode("tasks")
    tasks = raw.select("run_id", each.alias("t")).select("run_id", "t.*")
    return tasks.select(
        "run_id", "task_key",
        F.nullif(F.col("cluster_instance.cluster_id"), F.lit("")).alias("cluster_id"),
        F.struct("state.life_cycle_state", "state.result_state").alias("state"),
        from_millis("start_time").alias("start_time"), from_millis("end_time").alias("end_time"),
    )


def job_runs(
    runs: DataFrame,
    span: TimeRange | None = None,
    as_of: str | None = None,
    limit: int | None = 50,
    job_ids: DataFrame | None = None,
) -> DataFrame:
    """The latest ``limit`` runs of each job in a time range (default: seven days).

    The range reaches the scan, and rows beyond the limit are dropped before
    the shuffle, so a job with very many runs is no burden.
    """
    if span is None:
        if as_of is None:
            raise ValueError("give span or as_of")
        span = look_back(as_of, 24 * DEFAULT_DAYS)
    found = runs.filter(in_range("start_time", span))
    if job_ids is not None:
        found = found.join(job_ids.select("job_id"), "job_id", "left_semi")
    if limit is None:
        return found
    order = [F.col("start_time").desc_nulls_last(), F.col("run_id").desc()]
    return top_n_per_group(found, ["job_id"], order, limit, ["run_id"]).drop("rn")


def _named_runs(
    jobs: DataFrame, runs: DataFrame, name_pattern: str | None, span: TimeRange, limit: int | None
) -> DataFrame:
    wanted = jobs if name_pattern is None else search_jobs(jobs, name_pattern)
    named = wanted.select("job_id", "job_name")
    recent = job_runs(runs, span, limit=limit, job_ids=None if name_pattern is None else named)
    return recent.join(named, "job_id")


def failed_runs(
    jobs: DataFrame,
    runs: DataFrame,
    as_of: str,
    name_pattern: str | None = None,
    hours_back: float = DEFAULT_HOURS,
    limit: int | None = 20,
) -> DataFrame:
    """Failed runs among the last ``limit`` runs of every job, newest first.

    The limit applies before the failure filter; ``None`` looks at all runs.
    """
    found = failed_run_rows(jobs, runs, as_of, name_pattern, hours_back, limit)
    return found.orderBy(F.col("start_time").desc_nulls_last(), "run_id")


def failed_run_rows(
    jobs: DataFrame,
    runs: DataFrame,
    as_of: str,
    name_pattern: str | None = None,
    hours_back: float = DEFAULT_HOURS,
    limit: int | None = 20,
) -> DataFrame:
    """The rows of :func:`failed_runs` in no order, for operators that go on with them."""
    return _named_runs(jobs, runs, name_pattern, look_back(as_of, hours_back), limit).filter(is_failed())


def execution_timeline(
    jobs: DataFrame,
    runs: DataFrame,
    name_pattern: str,
    as_of: str,
    hours_back: float = DEFAULT_HOURS,
    limit: int | None = 20,
) -> DataFrame:
    """Runs of the matching jobs, newest first, with the duration in ms and seconds."""
    latest = _named_runs(jobs, runs, name_pattern, look_back(as_of, hours_back), limit)
    return latest.select(
        "job_name", "run_id", "cluster_id", "state", "start_time", "end_time",
        F.col("execution_duration").alias("execution_duration_ms"),
        (F.col("execution_duration") / 1000).alias("duration_seconds"),
    ).orderBy(F.col("start_time").desc_nulls_last(), "run_id")


def run_details(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every run with its tasks, one row per task; a run without tasks keeps one row.

    Written as inner join plus the runs left over, because an outer join could
    not split the tasks of one huge run over several tasks of the engine.
    """
    task = F.struct(*[F.col(c) for c in tasks.columns if c != "run_id"]).alias("task")
    packed = tasks.select("run_id", task)
    joined = runs.join(packed, "run_id")
    with_tasks = tasks.select("run_id").distinct()
    alone = runs.join(with_tasks, "run_id", "left_anti").withColumn(
        "task", F.lit(None).cast(packed.schema["task"].dataType)
    )
    return joined.unionByName(alone)


def cluster_log_info(clusters: DataFrame) -> DataFrame:
    """Clusters with the place of their logs, null where none is configured."""
    place = F.when(
        F.col("log_conf.destination").isNotNull(),
        F.concat_ws("/", "log_conf.destination", "cluster_id"),
    )
    return clusters.withColumn("log_path", place)


def run_clusters(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Distinct (run_id, cluster_id), from the run itself and from its tasks."""
    own = runs.select("run_id", "cluster_id")
    of_tasks = tasks.select("run_id", "cluster_id").join(
        runs.select("run_id"), "run_id", "left_semi"
    )
    return own.unionByName(of_tasks).dropna(subset=["cluster_id"]).distinct()


def cluster_ids_for_job(
    jobs: DataFrame,
    runs: DataFrame,
    tasks: DataFrame,
    name_pattern: str,
    span: TimeRange,
    limit: int | None = 50,
) -> DataFrame:
    """Clusters used by the runs of matching jobs, each once."""
    wanted = search_jobs(jobs, name_pattern)
    recent = job_runs(runs, span, limit=limit, job_ids=wanted)
    return run_clusters(recent, tasks).select("cluster_id").distinct()
