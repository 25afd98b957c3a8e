"""The star-schema tables seen as jobs, runs, tasks, clusters and log files.

========== =========== ==========================================================
model      table       mapping
========== =========== ==========================================================
log lines  events      cluster ``c<user_id>``, file chosen by ``event_id % 6``
big texts  documents   cluster = source, one file per document
jobs       customer    name ``c_name``
runs       orders      F failed, O succeeded, P running; urgent and P = internal error
run tasks  lineitem    cluster ``c<l_suppkey>``
clusters   supplier    log destination for even keys only
========== =========== ==========================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.functions.classify import log_type
from runscope.functions.text import basename

EVENTS_AS_OF = "2024-01-31 00:00:00"
RUNS_AS_OF = "2001-08-01 00:00:00"
LOOK_BACK_HOURS = 24 * 31

# Event ids per rotation. An id occurs once and a cluster's file takes every
# sixth one, so no file can hold more than a sixth of this many lines.
ROTATE_EVENTS = 120_000

LOG_NAMES = (
    "driver/stderr",
    "driver/stdout",
    "driver/log4j-active.log",
    "executor/stderr",
    "executor/app.log.gz",
    "misc/notes.txt",
)

# Messages of error events, chosen by event_id % 25.
ERROR_MESSAGES = (
    "FATAL ERROR: block manager halted",
    "ERROR java.lang.OutOfMemoryError: Java heap space",
    "ERROR org.apache.spark.sql.AnalysisException: Table or view not found: sales",
    "ERROR java.io.FileNotFoundException: /data/in.csv",
    "ERROR Connection refused: cannot reach the metastore",
    "ERROR java.lang.NullPointerException\n    at com.example.Job.run(Job.java:42)",
    "ERROR Authentication failed: invalid credentials",
    "ERROR Configuration error: missing configuration for warehouse",
    "WARN Job 17 failed, stage 4 failed, task failed",
    "WARN container killed by the node manager for exceeding memory",
    "ERROR org.apache.spark.SparkException: executor lost",
    "ERROR GC overhead limit exceeded",
    "WARN permission denied while listing the bucket",
    "CRITICAL segmentation fault, core dumped",
    "ERROR disk: no space left on device",
    "WARN broken pipe and connection reset by peer",
    "ERROR java.lang.ClassNotFoundException: com.example.Missing",
    "WARN access token expired",
    "WARN environment variable not set: DATA_HOME",
    "ERROR shuffle\nfetch failed: retry",
    "WARN deadlock detected, transaction failed",
    "WARN slow query and queue full",
    "ERROR panic in thread 7: aborted after error",
    "WARN network is unreachable",
    "WARN task not serializable",
)

# Words that occur in the documents; ASCII and without word boundaries.
DOCUMENT_PATTERNS = {
    "endings": [r"tion[a-z]*\s+the", r"ment[a-z]*\.\n"],
    "articles": [r"the\s+of", r"der\s+sch"],
    "marks": [r"\?\s*\n", r"[0-9]{3}-[0-9]{4}"],
}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def event_file() -> tuple[Column, Column]:
    """Cluster and path of an event's file."""
    cluster = F.concat(F.lit("c"), "user_id")
    path = F.concat_ws(
        "/", cluster, F.concat(F.lit("r"), F.floor(F.col("event_id") / ROTATE_EVENTS)),
        pick(F.col("event_id") % len(LOG_NAMES), LOG_NAMES),
    )
    return cluster, path


def lines_from_events(events: DataFrame) -> DataFrame:
    """One log message per event; a few messages take two lines."""
    cluster, path = event_file()
    stamp = F.substring(F.col("ts").cast("string"), 1, 19)
    message = F.when(
        F.col("event_type") == "error", pick(F.col("event_id") % len(ERROR_MESSAGES), ERROR_MESSAGES)
    ).otherwise(F.concat(F.lit("INFO worker handled "), "event_type", F.lit(" item "), "event_id"))
    return events.select(
        cluster.alias("cluster_id"), path.alias("file_path"), "event_id", "ts",
        F.concat_ws(" ", stamp, message).alias("line"),
    )


def event_contents(spark: SparkSession, folder: str) -> DataFrame:
    """``log_contents`` of the event log: lines joined per file, by time.

    The rotation bounds the number of lines that meet in one group. The number
    of partitions is the session's, not merged at run time by size: the text
    work that follows takes far longer per byte than the shuffle. Events are
    dealt out before they become lines, which are three times as long.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "line")))
    files = (
        lines_from_events(_read(spark, folder, "events").repartition(partitions, *event_file()))
        .groupBy("cluster_id", "file_path")
        .agg(ordered.alias("l"), F.max("ts").alias("last_modified"))
        .withColumn("content", F.array_join(F.transform("l", lambda x: x.line), "\n"))
    )
    return with_file_columns(files)


def document_contents(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """``log_contents`` of the documents: one file per document.

    A table of one row group is read by one task. Where heavy text work
    follows, ``partitions`` deals the rows out before it; a table of many
    splits needs no such shuffle.
    """
    documents = _read(spark, folder, "documents").select("doc_id", "source", "text")
    return contents_from_documents(documents if partitions is None else documents.repartition(partitions))


def contents_from_documents(documents: DataFrame) -> DataFrame:
    path = F.concat_ws(
        "/", "source", F.format_string("d%08d", F.col("doc_id")),
        pick(F.col("doc_id") % len(LOG_NAMES), LOG_NAMES),
    )
    files = documents.select(
        F.col("source").alias("cluster_id"), path.alias("file_path"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_modified"),
        F.col("text").alias("content"),
    )
    return with_file_columns(files)


def with_file_columns(files: DataFrame) -> DataFrame:
    return files.select(
        "cluster_id", "file_path", basename(F.col("file_path")).alias("file_name"),
        F.octet_length("content").cast("bigint").alias("size"), "last_modified",
        log_type(F.col("file_path")).alias("log_type"), "content",
    )


def document_pattern_table(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns as a table: the first words of every benchmark item in any spacing, plain ones and broken ones."""
    words = F.regexp_extract_all("text", F.lit(r"[^\s\[\](){}.*+?^$|\\,;:!-]+"), F.lit(0))
    items = _read(spark, folder, "benchmark").select(
        F.lit("benchmark").alias("category"), F.col("item_id").cast("int").alias("pattern_idx"),
        F.array_join(F.slice(words, 1, 3), r"\s+").alias("pattern"))
    names = _read(spark, folder, "nation").select(
        F.lit("broken").alias("category"), F.col("n_nationkey").cast("int").alias("pattern_idx"),
        F.concat(F.lit("["), F.lower("n_name")).alias("pattern"))
    given = [(category, idx, pattern) for category, own in DOCUMENT_PATTERNS.items() for idx, pattern in enumerate(own)]
    plain = spark.createDataFrame(given, "category STRING, pattern_idx INT, pattern STRING")
    return items.filter("pattern <> ''").unionByName(names).unionByName(plain)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "customer").select(
        F.col("c_custkey").alias("job_id"), F.col("c_name").alias("job_name"),
        F.lit("1995-01-01 00:00:00").cast("timestamp_ntz").alias("created_time"),
        F.col("c_mktsegment").alias("creator_user_name"),
    )


def runs_from_orders(orders: DataFrame) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    running = status == "P"
    life = (
        F.when(running & (F.col("o_orderpriority") == "1-URGENT"), "INTERNAL_ERROR")
        .when(running, "RUNNING").otherwise("TERMINATED")
    )
    result = F.when(status == "F", "FAILED").when(status == "O", "SUCCESS")
    return orders.select(
        key.alias("run_id"), F.col("o_custkey").alias("job_id"),
        F.when(key % 2 == 0, F.concat(F.lit("c"), (key % 10).cast("string"))).alias("cluster_id"),
        F.concat(F.lit("run-"), key).alias("run_name"),
        F.struct(
            life.alias("life_cycle_state"), result.alias("result_state"),
            F.col("o_orderpriority").alias("state_message"),
        ).alias("state"),
        F.col("o_orderdate").alias("start_time"),
        F.when(~running, F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS")).alias("end_time"),
        F.when(~running, F.lit(7_200_000)).cast("bigint").alias("execution_duration"),
        F.lit(None).cast("string").alias("creator_user_name"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs_from_orders(_read(spark, folder, "orders"))


def run_tasks(spark: SparkSession, folder: str) -> DataFrame:
    failed = F.col("l_returnflag") == "R"
    return _read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("task_key"),
        F.concat(F.lit("c"), "l_suppkey").alias("cluster_id"),
        F.struct(
            F.lit("TERMINATED").alias("life_cycle_state"),
            F.when(failed, "FAILED").otherwise("SUCCESS").alias("result_state"),
        ).alias("state"),
        F.col("l_shipdate").alias("start_time"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
    )


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    conf = F.struct(
        F.lit("s3://logs/jobs").alias("destination"), F.lit("us-west-2").alias("region"),
        F.lit(True).alias("enable_encryption"),
    )
    return _read(spark, folder, "supplier").select(
        F.concat(F.lit("c"), key).alias("cluster_id"), F.col("s_name").alias("cluster_name"),
        F.lit("4.1").alias("spark_version"), F.lit("RUNNING").alias("state"),
        F.when(key % 2 == 0, conf).alias("log_conf"),
    )
