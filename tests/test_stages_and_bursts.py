"""Staged levels, bursts of a busy cluster, and alerts that lead to a diagnosis."""

import re

from pyspark.sql import functions as F

from runscope.operators import matching
from runscope.plans import diagnose
from runscope.sources import tables
from runscope.streaming import feeds

FILES = {"c1/a": "FATAL ERROR\nconnection refused\npermission denied", "c2/a": "connection refused\ntask failed",
         "c3/a": "OutOfMemoryError\n" * 30 + "access denied", "c4/a": "fine", "c5/a": "java.io.IOException: disk\nbroken pipe"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_give_the_rows_of_one_pass(contents_of):
    contents = contents_of(FILES)
    for levels in (1, 2, 3):
        assert rows(matching.search_by_level_staged(contents, max_levels=levels)) == rows(
            matching.search_by_level(contents, max_levels=levels))
    caps = (None, 1, None)
    assert rows(matching.search_by_level_staged(contents, caps=caps, keep_order=True)) == rows(
        matching.search_by_level(contents, caps=caps, keep_order=True))


def test_deeper_levels_do_not_read_clusters_that_stopped(contents_of):
    found = matching.search_by_level_staged(contents_of(FILES))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # below the text work of the second look
    assert re.search(r"regexp_extract_all[\s\S]*LeftAnti", plan)


def lines(spark, minutes):
    return spark.createDataFrame(minutes, "cluster_id STRING, m BIGINT").select(
        "cluster_id", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60).alias("event_time"))


def test_sliced_bursts_equal_plain_ones(spark):
    minutes = [("hot", m) for k in range(60) for m in range(k * 97, k * 97 + 40, 1 + k % 7)]
    minutes += [("hot", 360 * k + d) for k in range(1, 9) for d in (-1, 0, 1)] + [("c", 0), ("c", 30), ("c", 59), ("d", None)]
    df = lines(spark, minutes + minutes[:50])
    for gap in ("5 minutes", "30 minutes", "10 hours"):
        assert rows(feeds.sliced_bursts(df, gap, 1)) == rows(
            feeds.error_bursts(df.filter("event_time IS NOT NULL"), gap)), gap


def test_a_busy_cluster_is_spread(spark):
    hot = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 97)).alias(
        "cluster_id"), (F.col("id") * 7 % 20_000).alias("m"))
    df = hot.select("cluster_id", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60).alias("event_time"))
    assert rows(feeds.sliced_bursts(df, "5 minutes", 1)) == rows(feeds.error_bursts(df, "5 minutes"))
    place = F.floor(F.unix_seconds("event_time") / 3600)
    sizes = [r["count"] for r in df.withColumn("slice", place).repartition(8, "cluster_id", "slice").groupBy(
        F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def model(spark):
    states = [(1, 7, "c1", "FAILED"), (2, 7, "c2", "SUCCESS"), (3, 8, "c3", "FAILED"), (4, 8, None, "FAILED"), (5, 9, "c5", "FAILED")]
    runs = spark.createDataFrame(states, "run_id BIGINT, job_id BIGINT, cluster_id STRING, r STRING").select(
        "run_id", "job_id", "cluster_id", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz").alias("start_time"),
        F.struct(F.lit("TERMINATED").alias("life_cycle_state"), F.col("r").alias("result_state")).alias("state"))
    tasks = spark.createDataFrame([(4, "c2"), (5, "c5")], "run_id BIGINT, cluster_id STRING")
    names = spark.createDataFrame([(7, "etl"), (8, "ml"), (9, "web")], "job_id BIGINT, job_name STRING")
    return names, runs, tasks


def test_alerts_lead_to_the_diagnosis_of_the_batch(spark, contents_of, tmp_path):
    names, runs, tasks = model(spark)
    contents = contents_of(FILES)
    runs.repartition(3, "run_id").write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
    got = feeds.diagnose_alerts(stream, names, tasks, contents, "d")
    want = diagnose.failure_diagnosis(names, runs, tasks, contents, "2024-01-31 00:00:00", limit=None)
    assert rows(got) == rows(want.select(*got.columns)) and not want.isEmpty()


def test_repeated_batches_and_runs_count_once(spark, contents_of, tmp_path):
    names, runs, tasks = model(spark)
    place = str(tmp_path / "place")
    assert feeds.latest_diagnoses(spark, place).isEmpty()
    write = feeds.diagnosis_writer(place, names, tasks, contents_of(FILES))
    failed = runs.filter("state.result_state = 'FAILED'")
    write(failed, 0)
    once = rows(feeds.latest_diagnoses(spark, place))
    write(failed, 0)                                        # the batch is repeated
    assert rows(feeds.latest_diagnoses(spark, place)) == once
    later = feeds.diagnosis_writer(place, names, tasks, contents_of({"c1/a": "fine", "c3/a": "FATAL ERROR"}))
    later(failed.filter("run_id IN (1, 3)").union(failed.filter("run_id = 3")), 1)
    now = {(r.run_id, r.category) for r in feeds.latest_diagnoses(spark, place).collect()}
    assert 1 not in {run for run, _ in now} and (3, "critical_errors") in now
    assert {run for run, _ in now} == {3, 4, 5} & ({r[0] for r in once} | {3})


def test_streams_merge_sessions_before_the_shuffle(spark, folder, tmp_path):
    before = spark.conf.get(feeds.MERGE_FIRST)
    events = feeds.stream_table(spark, folder, "events").select(
        F.lit("one").alias("cluster_id"), F.col("ts").cast("timestamp").alias("event_time"))
    got = feeds.run_to_end(feeds.error_bursts(events, "20 minutes"), "s")
    batch = spark.read.parquet(f"{folder}/events.parquet").select(
        F.lit("one").alias("cluster_id"), F.col("ts").cast("timestamp").alias("event_time"))
    assert rows(got) == rows(feeds.sliced_bursts(batch, "20 minutes"))
    assert spark.conf.get(feeds.MERGE_FIRST) == before
    assert tables.RUNS_AS_OF
