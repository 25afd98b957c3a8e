"""Log files on disk: plain, gzip, broken, large, nested and split into blocks."""

import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from runscope.functions import classify
from runscope.operators import matching, snippets
from runscope.sources import files
from runscope.streaming import feeds


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("log root+1")
    def put(path, data):
        target = base / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    put("c1/driver/stderr", b"one\r\nfatal\rerror here\nlast")
    put("c1/executor/stderr", b"job 7\nfailed\n")
    put("c1/executor/log4j-active.log.gz", gzip.compress("é OutOfMemoryError\n".encode()))
    put("c1/a b%20.log", b"odd name\n")
    put("c1/empty", b"")
    put("c10/driver/stdout", b"\xff\xfe broken")
    put("c10/driver/large.log", b"x" * 5000)
    return str(base)


def test_inventory_has_exact_clusters_and_types(spark, root):
    rows = files.log_inventory(spark, root).collect()
    got = {(r.cluster_id, r.file_name): (r.log_type, r.size) for r in rows}
    assert got["c1", "log4j-active.log.gz"][0] == "log4j"
    assert got["c1", "a b%20.log"] == ("unknown", 9)
    assert ("c1", "empty") not in got  # the engine's file sources skip empty files
    assert got["c10", "large.log"] == ("unknown", 5000)
    assert len(rows) == 6
    assert files.log_inventory(spark, root, "c999").count() == 0


def test_one_cluster_does_not_list_its_namesake(spark, root):
    got = files.log_inventory(spark, root, "c1").collect()
    assert {r.cluster_id for r in got} == {"c1"} and len(got) == 4


def test_newest_first(spark, root):
    times = [r.last_modified for r in files.newest_first(files.log_inventory(spark, root)).collect()]
    assert times == sorted(times, reverse=True)


def test_contents_and_rejects(spark, root):
    got = {r.file_path.rsplit("c1", 1)[-1]: r.content
           for r in files.log_contents(spark, root, max_size_mb=0.003).collect()}
    assert got["/driver/stderr"] == "one\nfatal\nerror here\nlast"
    assert got["/executor/log4j-active.log.gz"] == "é OutOfMemoryError\n"
    rejected = {(r.cluster_id, r.reason) for r in files.rejected_files(spark, root, 0.003).collect()}
    assert rejected == {("c10", "not_utf8"), ("c10", "too_large")}


def test_type_filter_and_matches_across_lines(spark, root):
    contents = files.log_contents(spark, root, log_types=["stderr"], cluster_id="c1")
    assert {r.file_name for r in contents.collect()} == {"stderr"}
    texts = {r.matched_text for r in matching.find_matches(contents).collect()}
    assert texts == {"fatal\nerror", "job 7\nfailed"}


def test_lines_of_a_split_file_are_numbered_in_order(spark, tmp_path):
    target = tmp_path / "c1" / "driver"
    target.mkdir(parents=True)
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(5000)]
    (target / "stderr").write_text("\n".join(lines) + "\n")
    (target / "stdout").write_text("a\nb\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.log_lines(spark, str(tmp_path))
        assert df.select(F.spark_partition_id()).distinct().count() > 4
        rows = df.filter(F.col("file_path").endswith("stderr")).orderBy("line_number").collect()
        other = df.filter(F.col("file_path").endswith("stdout")).orderBy("line_number").collect()
        windows = snippets.line_windows(df, "^line 4999 ", 2).orderBy("line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in rows] == lines
    assert [r.line_number for r in rows] == list(range(1, 5001))
    assert [(r.line_number, r.line) for r in other] == [(1, "a"), (2, "b")]
    assert [r.text[:9] for r in windows] == ["    4998:", "    4999:", ">>> 5000:"]


def test_streamed_files_give_the_same_matches(spark, root):
    stream = feeds.error_feed(feeds.stream_log_contents(spark, root))
    got = feeds.run_available(stream, "files").select("file_path", "matched_text", "position")
    want = matching.find_matches(files.log_contents(spark, root, files.SEARCH_MB)).select(
        "file_path", "matched_text", "position"
    )
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4


def test_log_types(spark):
    names = {
        "stderr": "stderr", "stdout": "stdout", "log4j-active.log": "log4j", "driver.log": "driver",
        "executor-1.log": "executor", "app.log.gz": "compressed", "unknown.txt": "unknown",
        "driver/notes.txt": "unknown", "STDERR.gz": "stderr",
    }
    df = spark.createDataFrame([(n,) for n in names], "p STRING").select(
        "p", classify.log_type(F.col("p")).alias("t"),
        classify.log_type(F.col("p"), compressed=False).alias("u"),
    )
    for r in df.collect():
        assert r.t == names[r.p]
        assert r.u == ("unknown" if r.t == "compressed" else r.t)


def test_unreadable_and_misplaced_files_are_reported(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "good.log").write_text("fatal\n")
    (tmp_path / "c1" / "cut.log.gz").write_bytes(gzip.compress(b"error " * 4000)[:40])
    (tmp_path / "stray.log").write_text("error\n")
    root = str(tmp_path)
    layout = r"(c[0-9]+)/(?:.*/)?([^/]+)$"
    texts = files.log_contents(spark, root, layout=layout).collect()
    assert [r.file_name for r in texts] == ["good.log"]
    found = {r.file_path.rsplit("/", 1)[1]: r.reason for r in files.rejected_files(spark, root, layout=layout).collect()}
    assert found == {"cut.log.gz": "unreadable", "stray.log": "off_layout"}


@pytest.mark.parametrize("gzipped", [False, True])
def test_written_texts_lie_where_the_engine_puts_them(spark, tmp_path, gzipped):
    rows = [("c1", "c1/r0/driver/stderr", "one\ntwo"), ("c1", "c1/r0/a:b=%2 ü.log", "é\r\n"), ("c1", "c1/r0/a:b=%2 ü.log", "again"),
            (None, "c2/x", "lost"), ("c3", "c3/", ""), ("c3", "c3/none", None), ("c[4]", "c[4]/x?", "x")]
    contents = spark.createDataFrame(rows, "cluster_id STRING, file_path STRING, content STRING").coalesce(1)
    ours, engine = tmp_path / "ours", tmp_path / "engine"
    files.write_contents(contents, str(ours), gzipped)
    writer = contents.selectExpr("cluster_id", "replace(substr(file_path, length(cluster_id) + 2), '/', '_') AS log", "content")
    writer.write.partitionBy("cluster_id", "log").option("compression", "gzip" if gzipped else "none").text(str(engine))

    def found(root):
        read = gzip.decompress if gzipped else bytes
        return sorted((str(f.parent.relative_to(root)), sorted(read(f.read_bytes()).split(b"\n")))
                      for f in root.rglob("part-*"))

    assert len(found(ours)) == 6 and found(ours) == found(engine)
    # the engine's writer leaves a checksum beside each file and starts processes for both of them
    assert not [f for f in ours.rglob("*") if f.is_file() and f.name.startswith((".", "_"))]
    with pytest.raises(FileExistsError):
        files.write_contents(contents, str(ours), gzipped)


def test_only_local_paths_are_written_by_the_tasks(spark):
    local = {p: files._is_local(spark, p) for p in ("/a", "a/b", "file:/a", "file:///a", "hdfs://h/a", "s3a://b/a", "viewfs:/a")}
    assert [p for p, own in local.items() if own] == ["/a", "a/b", "file:/a", "file:///a"]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    context, most = spark.sparkContext, 4 * spark.sparkContext.defaultParallelism
    for i in range(most + 40):
        (tmp_path / f"c{i}").mkdir()
        (tmp_path / f"c{i}" / "stderr").write_text("one\n")
    before = spark.conf.get(files.LISTING_LIMIT)
    context.setJobGroup("listing", "")
    try:
        assert files.log_contents(spark, str(tmp_path)).count() == most + 40
        assert files.log_inventory(spark, str(tmp_path)).count() == most + 40
        assert files.log_lines(spark, str(tmp_path)).count() == most + 40
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("listing") for s in status.getJobInfo(job).stageIds}
    tasks = [info.numTasks for info in map(status.getStageInfo, stages) if info]
    assert tasks and max(tasks) <= most and spark.conf.get(files.LISTING_LIMIT) == before
    with files.few_listing_tasks(spark), files.few_listing_tasks(spark):
        assert int(spark.conf.get(files.LISTING_LIMIT)) <= most
    assert spark.conf.get(files.LISTING_LIMIT) == before


def test_streams_list_files_by_few_tasks_to_their_end(spark, tmp_path, monkeypatch):
    (tmp_path / "in" / "c1").mkdir(parents=True)
    (tmp_path / "in" / "c1" / "stderr").write_text("FATAL ERROR a\n")
    before, seen, match = spark.conf.get(files.LISTING_LIMIT), [], feeds.find_matches

    def watched(*args):
        seen.append(int(spark.conf.get(files.LISTING_LIMIT)))
        return match(*args)

    monkeypatch.setattr(feeds, "find_matches", watched)
    feeds.take_in_files(spark, str(tmp_path / "in"), str(tmp_path / "fed"), {"mine": [r"FATAL\s+ERROR"]})
    assert feeds.fed_matches(spark, str(tmp_path / "fed")).count() == 1
    assert seen and max(seen) <= 4 * spark.sparkContext.defaultParallelism and spark.conf.get(files.LISTING_LIMIT) == before


@pytest.fixture
def a_split_each(spark):
    """Every small file is a split of its own."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_small_files_are_read_by_few_tasks(spark, tmp_path, a_split_each):
    most = files.READING_TASKS * spark.sparkContext.defaultParallelism
    (tmp_path / "c1").mkdir()
    for i in range(most + 20):
        (tmp_path / "c1" / f"stderr{i}").write_text("one\ntwo\n")
    for found, rows in ((files.log_contents, 1), (files.log_inventory, 1), (files._line_rows, 2)):
        df = found(spark, str(tmp_path), cluster_id=None, layout=files.LAYOUT)
        assert df.rdd.getNumPartitions() <= most and df.count() == rows * (most + 20)
    assert files.log_lines(spark, str(tmp_path)).filter("line = 'two' AND line_number = 2").count() == most + 20


def test_only_small_files_share_a_task(spark, tmp_path, a_split_each):
    most = files.READING_TASKS * spark.sparkContext.defaultParallelism
    (tmp_path / "c1").mkdir()
    for i in range(most + 20):
        (tmp_path / "c1" / f"stderr{i}").write_text("one\n")
    for i in range(9):
        (tmp_path / "c1" / f"large{i}").write_bytes(b"x" * (files.MB + 1))
    tasks = files.log_contents(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).groupBy("task").agg(
        F.count("*").alias("files"), F.count_if(F.col("size") > files.MB).alias("large")).collect()
    assert sorted((r.files, r.large) for r in tasks if r.large) == [(1, 1)] * 9
    assert sum(r.files for r in tasks) == most + 29 and len([r for r in tasks if not r.large]) <= most


ODD = {"end": b"a\nb\n", "no_end": b"a\n\nb", "mac": b"a\rb\r\rc", "dos": b"a\r\nb\r\n", "mark": b"\xef\xbb\xbfa\xef\xbb\xbf\nb",
       "only_mark": b"\xef\xbb\xbf", "mark_end": b"\xef\xbb\xbf\n", "blank": b"\n\n", "bytes": b"a\xff\xfe\nb\xc3\n\x00\x85\xa0",
       "wide": "é ß\x0bx\x0cy\n𝄞".encode()}


@pytest.mark.parametrize("cap", [None, 1 / files.MB])
def test_lines_inside_a_row_are_those_of_the_engine(spark, tmp_path, monkeypatch, cap):
    (tmp_path / "c1").mkdir()
    for name, data in ODD.items():
        (tmp_path / "c1" / name).write_bytes(data)
        (tmp_path / "c1" / f"{name}.gz").write_bytes(gzip.compress(data))

    def found():
        df = files.log_lines(spark, str(tmp_path)) if cap is None else files.oversize_lines(spark, str(tmp_path), cap)
        return sorted((r.file_path, r.line_number, bytes(r.b)) for r in df.select(
            "file_path", "line_number", F.col("line").cast("binary").alias("b")).collect())

    small = found()
    monkeypatch.setattr(files, "SMALL_MB", 0)
    assert small == found() and len({r[0] for r in small}) > len(ODD)


def test_packed_texts_are_unpacked_and_plain_ones_kept_byte_by_byte(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "a.log.gz").write_bytes(gzip.compress(b"packed\r\n"))
    (tmp_path / "c1" / "b.log.bz2").write_bytes(bz2.compress(b"also"))
    (tmp_path / "c1" / "c.GZ").write_bytes(b"plain\rtext")
    (tmp_path / "c1" / "d").write_bytes(b"\xef\xbb\xbf\x00mark")
    got = {r.file_name: r.content for r in files.log_contents(spark, str(tmp_path)).collect()}
    assert got == {"a.log.gz": "packed\n", "b.log.bz2": "also", "c.GZ": "plain\ntext", "d": "\ufeff\x00mark"}


def test_a_file_that_grows_between_two_listings_counts_once(spark):
    rows = [("c1", "c1/a", "a", size, "unknown", 0, i, f"line {i}") for size, n in ((10, 2), (20, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "cluster_id STRING, file_path STRING, file_name STRING, size BIGINT, log_type STRING, "
                               "block BIGINT, row_id BIGINT, line STRING").withColumn("last_modified", F.current_timestamp())
    got = files._numbered(df, files._line_blocks(df)).select("line_number", "line").collect()
    assert sorted(map(tuple, got)) == [(1, "line 0"), (2, "line 1")]


def test_sizes_of_settings(spark, a_split_each):
    assert files._setting_bytes(spark, "spark.sql.files.maxPartitionBytes") == 4 * files.MB


def test_arriving_files_are_listed_in_one_micro_batch(spark, tmp_path):
    root, place = tmp_path / "in" / "c1", tmp_path / "fed"
    root.mkdir(parents=True)
    for i in range(5):
        (root / f"stderr{i}").write_text("FATAL ERROR a\n")
    feeds.take_in_files(spark, str(root.parent), str(place), {"mine": [r"FATAL\s+ERROR"]}, files_a_batch=2)
    batches = {name: len([f for f in (place / name / "commits").iterdir() if f.name.isdigit()])
               for name in ("progress-listed", "progress-read")}
    assert batches == {"progress-listed": 1, "progress-read": 3}
    assert feeds.fed_files(spark, str(place)).filter("outcome = 'read'").count() == 5
