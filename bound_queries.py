"""Every operator bound to the driver's tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope import catalogs
from runscope.functions import classify, text, timespan
from runscope.operators import chunking, jobs, matching, oversize, pattern_tables, snippets, templates
from runscope.plans import analysis, diagnose, reports
from runscope.sources import exports, files, tables
from runscope.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]

LINES = 5            # lines per chunk on the short event logs
DOCUMENT_LINES = 10  # lines per chunk on the documents
SPREAD = 32          # tasks of heavy text work on documents; the test tables have one row group
SNIPPET = "exception|failed"
DOCUMENT_QUERY = "the "
FOLDER_FILES = 1000  # files in a folder of the event logs that are written to be read
CAP_MB = 700 / files.MB  # size cap of the queries on oversize files; the event logs are short
JOB_PATTERN = "customer#0000.*[05]$"
TOKENS = 130
ITERATIVE_TOKENS = 1200

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def stamp(column: str) -> Column:
    return F.substring(F.col(column).cast("string"), 1, 19)


def joined(column: str | Column) -> Column:
    return F.array_join(column, ",")


def flat_matches(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*matching.MATCH_COLUMNS, *extra)


# ---- files and lines ---------------------------------------------------------


@query
def log_inventory(spark, folder):
    found = tables.event_contents(spark, folder).select(
        "cluster_id", "file_path", "file_name", "size", stamp("last_modified").alias("last_modified"),
        "log_type",
    )
    return files.newest_first(found)


@query
def log_type_class(spark, folder):
    path = F.col("file_path")
    return tables.document_contents(spark, folder).select(
        "file_path", classify.log_type(path).alias("log_type"),
        classify.log_type(path, compressed=False).alias("analysis_type"),
        classify.search_rank(classify.log_type(path)).alias("search_rank"),
        classify.analysis_rank(classify.log_type(path)).alias("analysis_rank"),
    )


@query
def log_lines_numbered(spark, folder):
    return files.lines_of(tables.event_contents(spark, folder))


@query
def document_lines_numbered(spark, folder):
    return files.lines_of(tables.document_contents(spark, folder))


def _written(spark, folder, gzip):
    root = feeds.scratch_path(spark, "logs")
    layout = files.write_contents(tables.event_contents(spark, folder), root, gzip, FOLDER_FILES)
    found = files.log_contents(spark, root, layout=layout)
    return found.select(
        "cluster_id", "file_name", "log_type", F.octet_length("content").cast("bigint").alias("bytes"),
        F.size(F.split("content", "\n", -1)).cast("bigint").alias("pieces"),
        F.md5("content").alias("digest"),
    )


@query
def file_contents_plain(spark, folder):
    return _written(spark, folder, gzip=False)


@query
def file_contents_gzip(spark, folder):
    return _written(spark, folder, gzip=True)


@query
def file_contents_crlf(spark, folder):
    """Line ends of two bytes are one line end in the texts."""
    contents = tables.event_contents(spark, folder)
    root = feeds.scratch_path(spark, "crlf")
    contents = contents.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\r\n")))
    layout = files.write_contents(contents, root, folder_files=FOLDER_FILES)
    return files.log_contents(spark, root, layout=layout).select(
        "cluster_id", "file_name", F.md5("content").alias("digest"))


@query
def file_not_utf8(spark, folder):
    """Files with a byte that is no UTF-8 are reported, and the others are read."""
    bad = F.col("file_name") == "stdout"
    contents = tables.event_contents(spark, folder).withColumn(
        "content", F.when(bad, F.concat("content", F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("content")))
    root = feeds.scratch_path(spark, "bytes")
    layout = files.write_contents(contents, root, folder_files=FOLDER_FILES)
    read = files.log_contents(spark, root, layout=layout).groupBy("cluster_id").agg(F.count("*").alias("files"))
    left_out = files.rejected_files(spark, root, layout=layout).groupBy("cluster_id", "reason").agg(
        F.count("*").alias("files"))
    return read.select("cluster_id", F.lit("read").alias("outcome"), "files").unionByName(
        left_out.select("cluster_id", F.col("reason").alias("outcome"), "files"))


@query
def file_lines(spark, folder):
    root = feeds.scratch_path(spark, "lines")
    layout = files.write_contents(tables.event_contents(spark, folder), root, folder_files=FOLDER_FILES)
    found = files.log_lines(spark, root, layout=layout)
    return found.select(
        "cluster_id", F.regexp_extract("file_path", r"[/=]log=([^/=]+)[/=]", 1).alias("file_name"),
        "line_number", "line",
    )


@query
def file_rejects(spark, folder):
    root = feeds.scratch_path(spark, "caps")
    layout = files.write_contents(tables.event_contents(spark, folder), root, folder_files=FOLDER_FILES)
    found = files.rejected_files(spark, root, max_size_mb=CAP_MB, layout=layout)
    return found.groupBy("cluster_id", "reason").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


def _oversize_lines(spark, folder, name):
    root = feeds.scratch_path(spark, name)
    layout = files.write_contents(tables.event_contents(spark, folder), root, folder_files=FOLDER_FILES)
    return files.oversize_lines(spark, root, CAP_MB, layout=layout)


@query
def file_oversize_matches(spark, folder):
    blocks = oversize.log_blocks(_oversize_lines(spark, folder, "oversize"), 256, 4, 4)
    found = matching.find_block_matches(blocks)
    return found.select(
        "cluster_id", "file", "category", "pattern_idx", "pattern", "matched_text", "line", "line_number", "context",
        "timestamp", "position", "severity",
    )


@query
def file_oversize_chunks(spark, folder):
    found = oversize.line_chunks(_oversize_lines(spark, folder, "chunks"), "worker handled", LINES)
    return found.select(
        "cluster_id", "file_name", "chunk_no", "content", "priority_score",
        joined("error_indicators").alias("error_indicators"),
    )


# ---- pattern search ----------------------------------------------------------


@query
def pattern_matches(spark, folder):
    return flat_matches(matching.find_matches(tables.event_contents(spark, folder)))


@query
def pattern_matches_capped(spark, folder):
    found = matching.search_error_patterns(tables.event_contents(spark, folder), None, 5)
    return flat_matches(found)


@query
def search_error_patterns(spark, folder):
    return flat_matches(matching.search_error_patterns(tables.event_contents(spark, folder)))


@query
def search_custom_patterns(spark, folder):
    found = matching.search_error_patterns(
        tables.document_contents(spark, folder, SPREAD), tables.DOCUMENT_PATTERNS
    )
    return flat_matches(found)


@query
def custom_matches_all(spark, folder):
    found = matching.find_matches(tables.document_contents(spark, folder), tables.DOCUMENT_PATTERNS)
    return flat_matches(found)


@query
def rejected_patterns(spark, folder):
    given = {"broken": [r"[invalid regex", r"Table\s+or"], "fine": [r"heap\s+space"]}
    usable, _ = catalogs.valid_patterns(spark, given)
    found = matching.find_matches(tables.event_contents(spark, folder), usable)
    return found.groupBy("category", "pattern").agg(F.count("*").alias("matches"))


@query
def custom_patterns_table(spark, folder):
    usable, _ = pattern_tables.checked_patterns(tables.document_pattern_table(spark, folder))
    return flat_matches(pattern_tables.find_table_matches(tables.document_contents(spark, folder, SPREAD), usable))


@query
def custom_patterns_rejected(spark, folder):
    _, rejected = pattern_tables.checked_patterns(tables.document_pattern_table(spark, folder))
    return rejected.select("category", "pattern_idx", "pattern", F.col("reason").isNotNull().alias("has_reason"))


@query
def pattern_counts(spark, folder):
    return matching.pattern_counts(tables.event_contents(spark, folder))


@query
def match_severity(spark, folder):
    found = matching.find_matches(tables.event_contents(spark, folder))
    return found.groupBy("category", "severity").agg(F.count("*").alias("matches"))


@query
def match_timestamp(spark, folder):
    found = matching.find_matches(tables.event_contents(spark, folder))
    when = classify.line_event_time(F.col("line"))
    return found.groupBy(F.substring(when.cast("string"), 1, 10).alias("day")).agg(
        F.count("*").alias("matches"), F.count("timestamp").alias("stamped"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )


@query
def search_leveled(spark, folder):
    return flat_matches(matching.search_by_level(tables.event_contents(spark, folder)), "level")


@query
def search_leveled_distinct(spark, folder):
    found = matching.search_by_level(tables.event_contents(spark, folder), dedupe=True)
    return flat_matches(found, "level")


@query
def search_leveled_staged(spark, folder):
    return flat_matches(matching.search_by_level_staged(tables.event_contents(spark, folder)), "level")


@query
def level_summary(spark, folder):
    return matching.level_summary(tables.event_contents(spark, folder))


@query
def snippet_context(spark, folder):
    return snippets.context_snippets(tables.event_contents(spark, folder), SNIPPET, 4, 2)


@query
def snippet_head(spark, folder):
    return snippets.head_snippets(tables.document_contents(spark, folder), 20)


@query
def search_log_pattern(spark, folder):
    return snippets.search_log_pattern(
        tables.event_contents(spark, folder), SNIPPET, ["stderr", "log4j"]
    )


@query
def log_pattern_totals(spark, folder):
    return snippets.pattern_totals(tables.document_contents(spark, folder), "tion the|ment de")


@query
def line_windows(spark, folder):
    lines = files.lines_of(tables.event_contents(spark, folder))
    return snippets.line_windows(lines, SNIPPET, 2)


@query
def quick_scan(spark, folder):
    found = diagnose.quick_scan(tables.event_contents(spark, folder))
    return found.select(
        "cluster_id", "critical_errors_found", "total_errors", joined("error_types").alias("error_types"),
        F.array_join(F.transform("sample_errors", lambda s: F.concat_ws(
            "|", s.file, s.line_number, s.severity, s.line)), "\n").alias("sample_errors"),
        "recommendation",
    )


def flat_findings(df: DataFrame) -> DataFrame:
    return df.select(
        "cluster_id", "category", "severity", "count", "critical_total", "high_total",
        F.array_join(F.transform("examples", lambda m: F.concat_ws(
            "|", m.file, m.line_number, m.line)), "\n").alias("examples"),
    )


@query
def smart_findings(spark, folder):
    return flat_findings(diagnose.findings(matching.category_stats(tables.event_contents(spark, folder))))


@query
def focus_area(spark, folder):
    totals = matching.level_totals(tables.event_contents(spark, folder))
    kept = diagnose.keep_focus(totals, ["memory", "io", "configuration_errors"])
    return kept.groupBy("cluster_id", "category").agg(F.sum("matches_total").alias("matches"))


@query
def recommendations(spark, folder):
    return diagnose.recommendations(matching.category_stats(tables.event_contents(spark, folder)))


@query
def smart_analysis(spark, folder):
    found = diagnose.smart_analysis(tables.event_contents(spark, folder), ["memory", "spark", "io"])
    return found.select(
        "cluster_id", "total_errors", "errors_total", "deepest_level",
        joined(F.transform("error_breakdown", lambda e: F.concat_ws("=", e.category, e.matches, e.matches_total)))
        .alias("error_breakdown"),
        joined(F.transform("critical_findings", lambda e: F.concat_ws("=", e.category, e.severity, e["count"])))
        .alias("critical_findings"),
        F.array_join("recommendations", "; ").alias("recommendations"),
    )


# ---- chunks ------------------------------------------------------------------


@query
def chunk_split(spark, folder):
    split = chunking.split_chunks(tables.document_contents(spark, folder), DOCUMENT_LINES)
    return split.select("cluster_id", "file_path", F.posexplode_outer("texts").alias("chunk_no", "content")).filter("content IS NOT NULL")


@query
def chunk_ids(spark, folder):
    found = chunking.number_chunks(tables.event_contents(spark, folder), LINES)
    return found.select("cluster_id", "file_path", "chunk_id", "chunk_no", F.md5("content").alias("digest"))


@query
def chunk_score(spark, folder):
    found = chunking.log_chunks(tables.event_contents(spark, folder), "worker handled", LINES)
    return found.select("cluster_id", "file_path", "chunk_no", "priority_score")


@query
def chunk_score_documents(spark, folder):
    found = chunking.log_chunks(
        tables.document_contents(spark, folder, SPREAD), DOCUMENT_QUERY, DOCUMENT_LINES
    )
    return found.select("cluster_id", "file_path", "chunk_no", "priority_score",
                        joined("error_indicators").alias("error_indicators"))


@query
def chunk_indicators(spark, folder):
    found = chunking.log_chunks(tables.event_contents(spark, folder), None, LINES)
    return found.select("cluster_id", "file_path", "chunk_no",
                        joined("error_indicators").alias("error_indicators"))


@query
def chunk_topk(spark, folder):
    found = chunking.top_chunks(tables.event_contents(spark, folder), 10, None, LINES)
    return found.select("cluster_id", "chunk_rank", "file_path", "chunk_no", "content",
                        "priority_score", joined("error_indicators").alias("error_indicators"))


@query
def error_summary(spark, folder):
    found = analysis.error_summary(tables.event_contents(spark, folder), None, LINES)
    return found.withColumn("relevant_logs", joined("relevant_logs"))


def flat_analysis(found: DataFrame, *extra: str) -> DataFrame:
    return found.select(
        "cluster_id", *extra,
        joined(F.transform("error_summary", lambda e: F.concat_ws(
            "=", e.error_type, e.frequency, e.severity))).alias("errors"),
        joined(F.transform("prioritized_chunks", lambda c: F.concat_ws(
            "#", c.file_path, c.chunk_no))).alias("chunks"),
        "optimized_content", F.round("token_estimate", 6).alias("token_estimate"),
    )


@query
def analyze_logs(spark, folder):
    found = analysis.analyze_logs(tables.event_contents(spark, folder), None, LINES)
    return flat_analysis(found, "chunk_count")


@query
def analyze_cluster_logs(spark, folder):
    found = analysis.analyze_cluster_logs(
        tables.event_contents(spark, folder), "worker", 3, lines_per_chunk=LINES
    )
    return flat_analysis(found, "files_analyzed", "search_pattern", "analysis_method")


def flat_rounds(found: DataFrame) -> DataFrame:
    return found.select(
        "cluster_id", "total_iterations",
        joined(F.transform("error_summary", lambda e: F.concat_ws(
            "=", e.error_type, e.frequency, e.distinct_chunks, e.frequency_total, e.severity))).alias("errors"),
        joined(F.transform("category_totals", lambda e: F.concat_ws("=", e.error_type, e.frequency_total)))
        .alias("category_totals"),
        joined(F.transform("prioritized_chunks", lambda c: F.concat_ws(
            "#", c.iteration, c.file_path, c.chunk_no))).alias("chunks"),
    )


@query
def analyze_iterative(spark, folder):
    found = analysis.analyze_iteratively(
        tables.event_contents(spark, folder), None, 3, LINES, ITERATIVE_TOKENS
    )
    return flat_rounds(found)


@query
def iteration_breakdown(spark, folder):
    found = analysis.analyze_iteratively(
        tables.event_contents(spark, folder), None, 3, LINES, ITERATIVE_TOKENS
    )
    return found.select("cluster_id", F.inline("iteration_breakdown")).withColumn(
        "token_usage", F.round("token_usage", 6)
    )


@query
def iterative_report(spark, folder):
    found = analysis.analyze_iteratively(tables.event_contents(spark, folder), None, 3, LINES)
    return found.select("cluster_id", "optimized_content",
                        F.round("token_estimate", 6).alias("token_estimate"))


@query
def token_estimate(spark, folder):
    return tables.document_contents(spark, folder).select(
        "file_path", F.round(text.token_estimate(F.col("content")), 6).alias("token_estimate")
    )


@query
def token_truncate(spark, folder):
    return tables.document_contents(spark, folder).select(
        "file_path", text.truncate_tokens(F.col("content"), TOKENS).alias("content")
    )


# ---- jobs and runs -----------------------------------------------------------


def flat_runs(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "run_id", "job_id", "cluster_id", "run_name",
        F.col("state.life_cycle_state").alias("life_cycle_state"),
        F.col("state.result_state").alias("result_state"),
        stamp("start_time").alias("start_time"), stamp("end_time").alias("end_time"),
        "execution_duration", *extra,
    )


@query
def jobs_search(spark, folder):
    found = jobs.search_jobs(tables.jobs(spark, folder), JOB_PATTERN)
    return found.withColumn("created_time", stamp("created_time"))


@query
def job_runs(spark, folder):
    span = timespan.look_back(tables.RUNS_AS_OF, 24 * 365)
    return flat_runs(jobs.job_runs(tables.runs(spark, folder), span, limit=3))


@query
def job_runs_week(spark, folder):
    return flat_runs(jobs.job_runs(tables.runs(spark, folder), as_of=tables.RUNS_AS_OF))


@query
def run_details(spark, folder):
    found = jobs.run_details(tables.runs(spark, folder), tables.run_tasks(spark, folder))
    return found.select(
        "run_id", "job_id", F.col("state.life_cycle_state").alias("life_cycle_state"),
        F.col("task.task_key").alias("task_key"), F.col("task.cluster_id").alias("task_cluster_id"),
        F.col("task.state.result_state").alias("task_result"),
        stamp("task.start_time").alias("task_start"),
    )


@query
def failed_runs(spark, folder):
    found = jobs.failed_runs(
        tables.jobs(spark, folder), tables.runs(spark, folder), tables.RUNS_AS_OF, None,
        tables.LOOK_BACK_HOURS,
    )
    return flat_runs(found, "job_name")


@query
def failed_runs_by_name(spark, folder):
    found = jobs.failed_runs(
        tables.jobs(spark, folder), tables.runs(spark, folder), tables.RUNS_AS_OF, JOB_PATTERN,
        24 * 365, 2,
    )
    return flat_runs(found, "job_name")


@query
def cluster_log_info(spark, folder):
    return jobs.cluster_log_info(tables.clusters(spark, folder)).select(
        "cluster_id", "cluster_name", "spark_version", "state",
        F.col("log_conf.region").alias("region"), "log_path",
    )


@query
def cluster_ids_for_job(spark, folder):
    span = timespan.resolve_range("2001-01-01 00:00:00", None, tables.RUNS_AS_OF)
    return jobs.cluster_ids_for_job(
        tables.jobs(spark, folder), tables.runs(spark, folder), tables.run_tasks(spark, folder),
        JOB_PATTERN, span,
    )


@query
def job_timeline(spark, folder):
    found = jobs.execution_timeline(
        tables.jobs(spark, folder), tables.runs(spark, folder), JOB_PATTERN, tables.RUNS_AS_OF,
        24 * 365,
    )
    return found.select(
        "job_name", "run_id", "cluster_id", F.col("state.result_state").alias("result_state"),
        timespan.range_label(F.col("start_time"), F.col("end_time")).alias("time_range"),
        "execution_duration_ms", "duration_seconds",
        timespan.to_millis("start_time").alias("start_ms"),
    )


def _exported(spark, folder):
    """The runs written as an export, among them a broken line and a record without a job per customer."""
    root = feeds.scratch_path(spark, "export")
    exports.export_records(tables.runs(spark, folder), tables.run_tasks(spark, folder)).write.json(
        f"{root}/good", compression="gzip")
    broken = tables.jobs(spark, folder).select(F.explode(F.array(
        F.concat(F.lit('{"run_id": '), "job_id", F.lit(', "job_id": "'), "job_name", F.lit('"}')),
        F.concat(F.lit('{"run_id": '), F.col("job_id") + 10**9, F.lit(', "run_name": "'), "job_name", F.lit('"}')),
        F.concat(F.lit('{"run_id": '), "job_id", F.lit(", ")))).alias("value"))
    broken.write.text(f"{root}/bad")
    return exports.exported_records(spark, root)


@query
def runs_from_export(spark, folder):
    return flat_runs(exports.runs_from_export(_exported(spark, folder)))


@query
def tasks_from_export(spark, folder):
    return exports.tasks_from_export(_exported(spark, folder)).select(
        "run_id", "task_key", "cluster_id", F.col("state.result_state").alias("task_result"),
        stamp("start_time").alias("task_start"))


@query
def rejected_records(spark, folder):
    return exports.rejected_records(_exported(spark, folder)).groupBy("reason").agg(
        F.count("*").alias("records"), F.sum(F.length("record")).alias("characters"))


# ---- diagnosis ---------------------------------------------------------------


def _diagnosis(spark, folder):
    return diagnose.failure_diagnosis(
        tables.jobs(spark, folder), tables.runs(spark, folder), tables.run_tasks(spark, folder),
        tables.event_contents(spark, folder), tables.RUNS_AS_OF, None, tables.LOOK_BACK_HOURS,
    )


@query
def failure_diagnosis(spark, folder):
    return flat_diagnosis(_diagnosis(spark, folder))


def flat_diagnosis(found: DataFrame) -> DataFrame:
    return found.select(
        "run_id", "job_id", "job_name", stamp("start_time").alias("start_time"), "result_state",
        "life_cycle_state", "cluster_id", "category", "severity", "count", "critical_total", "high_total",
        F.array_join(F.transform("examples", lambda m: F.concat_ws(
            "|", m.file, m.line_number, m.line)), "\n").alias("examples"),
        "recommendation",
    )


@query
def common_failure_patterns(spark, folder):
    return diagnose.common_failure_patterns(
        tables.jobs(spark, folder), tables.runs(spark, folder), tables.run_tasks(spark, folder),
        tables.event_contents(spark, folder), tables.RUNS_AS_OF, tables.LOOK_BACK_HOURS,
    )


@query
def failure_templates(spark, folder):
    return diagnose.failure_templates(
        tables.jobs(spark, folder), tables.runs(spark, folder), tables.run_tasks(spark, folder),
        tables.event_contents(spark, folder), tables.RUNS_AS_OF, tables.LOOK_BACK_HOURS, looks_like=None,
    )


@query
def document_templates(spark, folder):
    contents = tables.document_contents(spark, folder, SPREAD)
    return templates.line_templates(matching.unmatched_lines(contents, tables.DOCUMENT_PATTERNS))


@query
def json_results(spark, folder):
    found = jobs.search_jobs(tables.jobs(spark, folder), JOB_PATTERN).select("job_id", "job_name")
    return reports.json_rows(found, ["job_id"])


@query
def empty_messages(spark, folder):
    found = diagnose.quick_scan(tables.event_contents(spark, folder)).select(
        "cluster_id", F.col("critical_errors_found").cast("string").alias("message")
    )
    return reports.with_message(
        tables.event_contents(spark, folder), found, "message",
        "No critical errors found in cluster: %s",
    )


# ---- streams -----------------------------------------------------------------


@query
def stream_error_feed(spark, folder):
    documents = feeds.stream_table(spark, folder, "documents")
    contents = tables.contents_from_documents(documents)
    return feeds.run_available(
        flat_matches(feeds.error_feed(contents, tables.DOCUMENT_PATTERNS)), "feed"
    )


def _event_stream_matches(spark, folder):
    """Each event line as a one-line file, so that matching needs no grouping."""
    lines = tables.lines_from_events(feeds.stream_table(spark, folder, "events"))
    return feeds.error_feed(tables.with_file_columns(
        lines.withColumnRenamed("line", "content").withColumnRenamed("ts", "last_modified")
    ))


def _windows(df: DataFrame) -> DataFrame:
    return df.withColumns({
        name: F.substring(F.col(name).cast("timestamp_ntz").cast("string"), 1, 19)
        for name in df.columns if name.endswith(("_start", "_end"))
    })


@query
def stream_error_windows(spark, folder):
    found = feeds.error_windows(_event_stream_matches(spark, folder), "6 hours")
    return _windows(feeds.run_to_end(found, "windows"))


@query
def stream_error_sliding(spark, folder):
    found = feeds.error_windows(_event_stream_matches(spark, folder), "1 day", "12 hours")
    return _windows(feeds.run_to_end(found, "sliding"))


@query
def stream_failed_runs(spark, folder):
    runs = tables.runs_from_orders(feeds.stream_table(spark, folder, "orders"))
    found = feeds.failed_run_alerts(runs, tables.jobs(spark, folder))
    return feeds.run_available(found.select("run_id", "job_id", "job_name"), "alerts")


@query
def error_bursts(spark, folder):
    lines = tables.lines_from_events(spark.read.parquet(f"{folder}/events.parquet"))
    found = matching.find_matches(tables.with_file_columns(
        lines.withColumnRenamed("line", "content").withColumnRenamed("ts", "last_modified")))
    timed = found.withColumn("event_time", classify.line_event_time(F.col("line")).cast("timestamp"))
    return _windows(feeds.sliced_bursts(timed, "6 hours"))


@query
def stream_error_sessions(spark, folder):
    matches = _event_stream_matches(spark, folder).withColumn(
        "event_time", classify.line_event_time(F.col("line")).cast("timestamp")).filter("event_time IS NOT NULL")
    return _windows(feeds.run_to_end(feeds.error_bursts(matches, "6 hours"), "bursts"))


@query
def stream_failure_diagnosis(spark, folder):
    runs = tables.runs_from_orders(feeds.stream_table(spark, folder, "orders"))
    span = timespan.look_back(tables.RUNS_AS_OF, tables.LOOK_BACK_HOURS)
    return flat_diagnosis(feeds.diagnose_alerts(
        runs.filter(timespan.in_range("start_time", span)), tables.jobs(spark, folder), tables.run_tasks(spark, folder),
        tables.event_contents(spark, folder), "diagnoses"))


def _fed(spark, folder, name):
    """Event logs that arrive in two waves, with a byte that is no UTF-8 in some files, taken in after each wave."""
    root, place = feeds.scratch_path(spark, f"{name}-in"), feeds.scratch_path(spark, name)
    bad = F.col("file_name") == "stdout"
    contents = tables.event_contents(spark, folder).withColumn(
        "content", F.when(bad, F.concat("content", F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("content")))
    for wave in (0, 1):
        mine = contents.filter(F.pmod(F.crc32("cluster_id"), F.lit(2)) == wave)
        layout = files.write_contents(mine, f"{root}/wave={wave}", folder_files=FOLDER_FILES)
        feeds.take_in_files(spark, root, place, max_size_mb=CAP_MB, layout=f"wave=[01]/{layout}")
    return place


@query
def stream_file_matches(spark, folder):
    return feeds.fed_matches(spark, _fed(spark, folder, "fed-matches")).select(
        "cluster_id", "file", "category", "pattern_idx", "pattern", "matched_text", "line", "line_number", "context",
        "timestamp", "position", "severity")


@query
def stream_file_outcomes(spark, folder):
    found = feeds.fed_files(spark, _fed(spark, folder, "fed-files"))
    return found.groupBy("cluster_id", "outcome").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
