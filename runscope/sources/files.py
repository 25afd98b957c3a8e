"""Log files on any Hadoop file system: inventory, whole texts, lines, rejects.

Files lie under ``root/<cluster_id>/...``. A ``layout`` regex, applied to the
path below ``root``, yields the cluster (group 1) and the file name (group 2).
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import partial
from itertools import groupby

from py4j.protocol import Py4JError
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F

from runscope.functions.classify import log_type
from runscope.functions.text import normalize_newlines, quote_regex
from runscope.operators.ranking import cut_lineage, join_checked, scratch_path

LAYOUT = r"([^/]+)/(?:.*/)?([^/]+)$"
MB = 1024 * 1024
# Size caps in MB for plain reads, search, analysis and snippets.
READ_MB, SEARCH_MB, ANALYSIS_MB, SNIPPET_MB = 50, 25, 20, 10

# Tasks per core that list folders. The default of the setting is a task per folder, or per file of a micro-batch.
LISTING_TASKS = 4
LISTING_LIMIT = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Up to so many folders the driver lists itself; those of a wave may each hold many files.
LISTED_BY_DRIVER, FEW_FOLDERS = "spark.sql.sources.parallelPartitionDiscovery.threshold", 2

# Files that the driver lists at once; of more, it knows about 2 KB each. Folders of the first look at how many files they hold.
FILES_A_WAVE, FIRST_FOLDERS = 25_000, 32
# What a small file counts in the engine's splits while waves are read; the default of 4 MB makes a split of a few files.
OPEN_COST, OPEN_COST_BYTES = "spark.sql.files.openCostInBytes", 64 * 1024

# Tasks per core that read small files, and the engine's splits that one of them takes at most.
READING_TASKS, SPLITS_A_TASK = 4, 16
# Plain files up to this size are small; where lines are wanted they are split inside their row, unless they are above a split.
SMALL_MB = 1
# Names that the engine may unpack; it reads them itself.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|lzo|lzo_deflate|passthrough)$"
LINE_END = r"\r\n|\r|\n"

LINE_COLUMNS = ["cluster_id", "file_path", "file_name", "size", "last_modified", "log_type"]
INVENTORY = (
    "cluster_id STRING, file_path STRING, file_name STRING, size BIGINT, "
    "last_modified TIMESTAMP, log_type STRING"
)


@contextmanager
def _at_most(spark: SparkSession, name: str, most: int, before: int) -> Iterator[None]:
    """A setting of the session, lowered for a while."""
    given = spark.conf.get(name)
    spark.conf.set(name, str(min(before, most)))
    try:
        yield
    finally:
        spark.conf.set(name, given)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Lists folders in some tasks per core instead of one task per folder, while readers are made or streams run.

    A reader lists its folders when it is made, a stream those of its source and each micro-batch's files again.
    """
    with _at_most(spark, LISTING_LIMIT, LISTING_TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get(LISTING_LIMIT))):
        yield


def few_splits(spark: SparkSession):
    """Puts more small files into one of the engine's splits; large files have the same splits as before."""
    return _at_most(spark, OPEN_COST, OPEN_COST_BYTES, _setting_bytes(spark, OPEN_COST))


def _few_by_driver(spark: SparkSession):
    return _at_most(spark, LISTED_BY_DRIVER, FEW_FOLDERS, int(spark.conf.get(LISTED_BY_DRIVER)))


def _place(root: str) -> str:
    """Regex for the path of ``root`` without its scheme."""
    bare = root.split("://", 1)[-1]
    if "://" not in root:
        bare = bare.removeprefix("file:")
    return quote_regex(bare.rstrip("/"))


def described(raw: DataFrame, root: str, layout: str, off_layout: bool = False) -> DataFrame:
    """Adds the inventory columns from the hidden file metadata.

    Paths that do not fit the layout have an empty cluster and are left out
    unless ``off_layout`` is set. The driver applies what is known of metadata alone to
    one file after the other, so names of binary files wait for the tasks; sizes do not.
    """
    named = F.col("_metadata.file_path")
    if "length" in raw.columns and not raw.isStreaming:
        named = F.when(F.col("length") >= 0, named)
    path = F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B")))
    pattern = _place(root) + "/+" + layout
    out = raw.withColumns({
        "file_path": path,
        "size": F.col("_metadata.file_size"),
        "last_modified": F.col("_metadata.file_modification_time"),
        "cluster_id": F.regexp_extract(path, pattern, 1),
        "file_name": F.regexp_extract(path, pattern, 2),
    }).withColumn("log_type", log_type(F.col("file_name")))
    return out if off_layout else out.filter(F.col("cluster_id") != "")


def _path(root: str, cluster_id: str | None) -> str:
    """One cluster is one directory, so its neighbours are not even listed."""
    return root if cluster_id is None else f"{root.rstrip('/')}/{cluster_id}"


def log_inventory(
    spark: SparkSession, root: str, cluster_id: str | None = None, layout: str = LAYOUT,
    off_layout: bool = False,
) -> DataFrame:
    """One row per non-empty file, without reading any content.

    Spark's file sources leave out files of length 0. For the usual order see
    :func:`newest_first`.
    """
    def found(raw: DataFrame, _) -> DataFrame:
        return _in_few_tasks(raw, described(raw, root, layout, off_layout)).select(
            "cluster_id", "file_path", "file_name", "size", "last_modified", "log_type"
        )

    try:
        return _in_waves(spark, root, cluster_id, found)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND" or cluster_id is None:
            raise
        return spark.createDataFrame([], INVENTORY)


def newest_first(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy(F.col("last_modified").desc(), "file_path")


def _reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("recursiveFileLookup", "true").option(
        "ignoreCorruptFiles", "true"
    ).option("ignoreMissingFiles", "true")


def _in_few_tasks(raw: DataFrame, files: DataFrame) -> DataFrame:
    """``files``, rows of ``raw`` that no shuffle moved, in some tasks per core, each for a bounded number of splits.

    The engine counts a file as 4 MB at least, so small files make a task per 32
    of them, whose start and output file take longer than the reading.
    """
    splits = raw.rdd.getNumPartitions()
    most = max(READING_TASKS * raw.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS_A_TASK))
    return files.coalesce(most) if splits > most else files


def _plain(spark: SparkSession) -> Column:
    """Whether a file's bytes are its text. Where the session names its codecs, only the engine knows."""
    return F.lit(False) if _names_codecs(spark) else ~F.col("file_path").rlike(PACKED)


def _small_gzip(spark: SparkSession) -> Column:
    """Whether a file is unpacked in its row."""
    return F.lit(False) if _names_codecs(spark) else F.col("file_path").endswith(".gz") & (F.col("size") <= SMALL_MB * MB)


def _names_codecs(spark: SparkSession) -> bool:
    return bool(spark.sparkContext._jsc.hadoopConfiguration().get("io.compression.codecs"))


def _setting_bytes(spark: SparkSession, name: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)(?:i?b)?", spark.conf.get(name).strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def _longest_binary(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))


def _below(spark: SparkSession, path: str) -> list[str]:
    """What the engine would list below ``path``: right below it, or deeper where that is little."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def children(at: str) -> list[str]:
        place = fs.Path(at)
        found = place.getFileSystem(conf).listStatus(place)      # of a file: itself
        try:        # all names in one call
            names = spark._jvm.scala.runtime.ScalaRunTime.genericWrapArray(fs.FileUtil.stat2Paths(found)).mkString("\0").split("\0")
        except Py4JError:       # an array of the file system's own type
            names = [status.getPath().toString() for status in found]
        return [x for x in names if x and (x == at or not _hidden(x.rpartition("/")[2]))]

    if not fs.Path(path).getFileSystem(conf).exists(fs.Path(path)):
        return [path]
    level, deeper = [], [path]
    while len(deeper) < FIRST_FOLDERS and level != deeper:
        level, deeper = deeper, [x for at in deeper for x in children(at)]
    return deeper


def _hidden(name: str) -> bool:
    """Names that the engine's file sources leave out."""
    out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _listed(spark: SparkSession, paths: list[str], kind: str = "binaryFile", patterns: bool = False, **options: bool) -> DataFrame:
    """The files below some paths; names that were listed are no patterns."""
    with few_listing_tasks(spark):
        return _reader(spark).option("__globPaths__", str(patterns).lower()).format(kind).load(paths, **options)


# From the files below some folders, as bytes, and a function that reads them as texts, to rows.
Found = Callable[[DataFrame, Callable[..., DataFrame]], DataFrame]


def _in_waves(spark: SparkSession, root: str, cluster_id: str | None, found: Found) -> DataFrame:
    """``found(raw, texts)`` of all files, each folder listed once for ``raw`` and again only where ``texts`` is called.

    The driver keeps what it has listed for as long as a reader is in use. So many
    files are listed and read in waves of folders, one after the other, each
    written to a table in the shared folder; the number of folders in a wave
    follows the files in those before. Few files are read when the result is.
    """
    path = _path(root, cluster_id)
    folders, step = _below(spark, path), FIRST_FOLDERS
    with _few_by_driver(spark):
        some = folders[:step]
        if len(some) <= FEW_FOLDERS or len(_names_of(_listed(spark, some))) * len(folders) <= FILES_A_WAVE * len(some):
            return found(_listed(spark, [path], patterns=True), partial(_listed, spark, [path], "text", True))
        place, start, waves = scratch_path(spark, "waves"), 0, []
        with few_splits(spark):
            while start < len(folders):
                paths = folders[start:start + step]
                raw = _listed(spark, paths)
                files = len(_names_of(raw))
                if files > 2 * FILES_A_WAVE and len(paths) > 1:
                    step = max(1, len(paths) * FILES_A_WAVE // files)
                    continue
                part = found(raw, partial(_listed, spark, paths, "text"))
                part.write.option("compression", "zstd").parquet(f"{place}/{len(waves)}")
                waves.append(f"{place}/{len(waves)}")
                start += len(paths)
                step = max(1, min(8 * step, len(paths) * FILES_A_WAVE // max(files, 1)))
    return spark.read.schema(part.schema).parquet(*waves)


def _names_of(raw: DataFrame) -> list[str]:
    names = raw.sparkSession._jvm.scala.runtime.ScalaRunTime.genericWrapArray(raw._jdf.inputFiles()).mkString("\0")
    return names.split("\0") if names else []


def _has_larger(raw: DataFrame, most_bytes: int) -> bool:
    return not raw.filter(F.col("_metadata.file_size") > most_bytes).select("length").isEmpty()


def _small_and_large(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Only small files share tasks."""
    small = F.col("size") <= SMALL_MB * MB
    return _in_few_tasks(raw, files.filter(small)).unionByName(files.filter(~small))


def _unpack() -> Callable[[bytes], bytes | None]:
    """What Hadoop's codec makes of the bytes of a gzip file; null if it breaks off or is none.

    The function brings along all it needs, because executors may lack this package.
    """
    def unpack(data):
        out = []
        try:
            while data:
                member = zlib.decompressobj(31)
                out.append(member.decompress(data))
                if not member.eof:
                    return None
                data = member.unused_data
        except zlib.error:
            return None
        return b"".join(out)

    return unpack


def _whole_texts(raw: DataFrame, texts: Callable[..., DataFrame], root: str, layout: str) -> DataFrame:
    """The engine's text reader copies the Hadoop configuration and makes all codecs anew for every file, its reader of
    binary files does not. So only packed files that are large, or no gzip files, are left to the text reader."""
    spark, columns = raw.sparkSession, ["cluster_id", "file_path", "file_name", "size", "last_modified", "log_type", "value"]
    listed, plain, gzip = described(raw, root, layout), _plain(raw.sparkSession), _small_gzip(raw.sparkSession)
    found = _small_and_large(raw, listed.filter(plain & (F.col("size") <= _longest_binary(spark)))).withColumn(
        "value", F.col("content").cast("string")).select(*columns)
    packed_names = [name for name in _names_of(raw) if re.search(PACKED, name)]
    if any(name.endswith(".gz") for name in packed_names) and not _names_codecs(spark):
        unpack = F.udf(_unpack(), "binary").asNondeterministic()      # else a filter on the text would unpack it again
        unpacked = _in_few_tasks(raw, listed.filter(gzip)).withColumn("value", unpack("content")).filter("value IS NOT NULL")
        found = found.unionByName(unpacked.withColumn("value", F.col("value").cast("string")).select(*columns))
    other_names = not all(name.endswith(".gz") for name in packed_names)
    if other_names or _names_codecs(spark) or packed_names and _has_larger(raw, SMALL_MB * MB):
        packed = described(texts(wholetext=True), root, layout).filter(~plain & ~gzip)
        found = found.unionByName(packed.select(*columns))
    return found


def log_contents(
    spark: SparkSession,
    root: str,
    max_size_mb: float | None = None,
    log_types: Sequence[str] | None = None,
    cluster_id: str | None = None,
    layout: str = LAYOUT,
) -> DataFrame:
    """Whole texts, one row per file; gzip is unpacked by its suffix.

    Every file is read unless a cap on the stored size or types are given.
    Files that are left out for the cap, that are no valid UTF-8 or cannot be
    read are reported by :func:`rejected_files`.
    """
    return _in_waves(spark, root, cluster_id, lambda raw, texts: usable_texts(
        _whole_texts(raw, texts, root, layout), max_size_mb, log_types))


def usable_texts(
    texts: DataFrame, max_size_mb: float | None, log_types: Sequence[str] | None = None
) -> DataFrame:
    """Size cap, type filter, UTF-8 check and newline rule on described whole texts."""
    wanted = texts if max_size_mb is None else texts.filter(F.col("size") <= int(max_size_mb * MB))
    if log_types:
        wanted = wanted.filter(F.col("log_type").isin(*log_types))
    return wanted.filter(F.is_valid_utf8("value")).select(
        "cluster_id", "file_path", "file_name", "size", "last_modified", "log_type",
        normalize_newlines(F.col("value")).alias("content"),
    )


def rejected_files(
    spark: SparkSession,
    root: str,
    max_size_mb: float | None = None,
    cluster_id: str | None = None,
    layout: str = LAYOUT,
) -> DataFrame:
    """Files that :func:`log_contents` leaves out, with the reason.

    ``too_large``: above a given cap; ``not_utf8``: bytes that are no UTF-8;
    ``unreadable``: listed but without a text, such as a cut gzip file;
    ``off_layout``: a path outside ``layout``, so that its cluster is unknown.
    """
    columns = ["cluster_id", "file_path", "size"]
    fits = F.lit(True) if max_size_mb is None else F.col("size") <= int(max_size_mb * MB)

    def found(raw: DataFrame, texts: Callable[..., DataFrame]) -> DataFrame:
        listed = _in_few_tasks(raw, described(raw, root, layout, off_layout=True)).select(*columns)
        read = _whole_texts(raw, texts, root, layout).filter(fits).select("file_path", F.is_valid_utf8("value").alias("valid"))
        reason = F.when(F.col("cluster_id") == "", "off_layout").when(~fits, "too_large").when(
            F.col("valid").isNull(), "unreadable").when(~F.col("valid"), "not_utf8")
        return listed.join(read, "file_path", "left").select(*columns, reason.alias("reason")).filter("reason IS NOT NULL")

    return _in_waves(spark, root, cluster_id, found)


def lines_of(contents: DataFrame) -> DataFrame:
    """``log_lines`` of whole texts, numbered from 1."""
    return contents.select(
        "cluster_id", "file_path",
        F.posexplode_outer(F.split("content", "\n", -1)).alias("line_number", "line"),
    ).filter("line IS NOT NULL").withColumn("line_number", F.col("line_number") + 1)


def log_lines(
    spark: SparkSession, root: str, cluster_id: str | None = None, layout: str = LAYOUT
) -> DataFrame:
    """``log_lines`` read line by line, for files too large for one row.

    Plain files are split into blocks. The rows of a block are numbered in
    order by the engine, so a line's number is its place in the block plus the
    lines of the blocks before it; only per-block counts are aggregated. Plain
    files of up to a megabyte are one block, split inside their row.
    Gzip files cannot be split and come as one block. A file that breaks off
    keeps the lines before the break; :func:`rejected_files` reports it.
    """
    columns = ["cluster_id", "file_path", "line_number", "line"]

    def found(raw: DataFrame, texts: Callable[..., DataFrame]) -> DataFrame:
        numbered = _small_lines(raw, root, layout).withColumn("line_number", F.col("place") + 1).select(*columns)
        rows = _block_rows(raw, texts, root, layout)
        return numbered if rows is None else numbered.unionByName(_numbered(rows, _line_blocks(rows)).select(*columns))

    return _in_waves(spark, root, cluster_id, found)


def _line_rows(spark: SparkSession, root: str, cluster_id: str | None, layout: str) -> DataFrame:
    """Lines with the columns of their file, their block and their order in it; the lines of a small file are block 0."""
    def found(raw: DataFrame, texts: Callable[..., DataFrame]) -> DataFrame:
        small, rows = _small_lines(raw, root, layout), _block_rows(raw, texts, root, layout)
        small = small.select(*LINE_COLUMNS, "line", F.lit(0).cast("bigint").alias("block"), F.col("place").alias("row_id"))
        return small if rows is None else small.unionByName(rows)

    return _in_waves(spark, root, cluster_id, found)


def _most_small(spark: SparkSession) -> int:
    """Bytes of the files that are split inside their row."""
    return min(SMALL_MB * MB, _setting_bytes(spark, "spark.sql.files.maxPartitionBytes"), _longest_binary(spark))


def _small_lines(raw: DataFrame, root: str, layout: str, whole: bool = False) -> DataFrame:
    """Lines of small plain files, with their place counted from 0; for ``whole`` see :func:`oversize_lines`."""
    listed = described(raw, root, layout).filter(_plain(raw.sparkSession) & (F.col("size") <= _most_small(raw.sparkSession)))
    # a character a byte, because a split replaces bytes that are no UTF-8; a byte order mark goes, as in the engine's reader
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "^\u00ef\u00bb\u00bf", "")
    lines = _in_few_tasks(raw, listed).withColumn("l", F.split(text, LINE_END, -1)).withColumn(
        "l", F.expr("if(element_at(l, -1) = '', slice(l, 1, size(l) - 1), l)"))
    if whole:
        ends = "size - aggregate(l, 0L, (n, x) -> n + length(x)) IN (size(l), 2 * size(l))"      # one byte a line end, or two
        lines = lines.filter(F.is_valid_utf8("content") & (F.size("l") > 0)).withColumn(
            "l", F.expr(f"if({ends}, concat(l, array('')), l)"))
    return lines.select(*LINE_COLUMNS, F.posexplode_outer("l").alias("place", "line")).filter("line IS NOT NULL").select(
        *LINE_COLUMNS, F.encode("line", "ISO-8859-1").cast("string").alias("line"), F.col("place").cast("bigint").alias("place"))


def _block_rows(raw: DataFrame, texts: Callable[..., DataFrame], root: str, layout: str) -> DataFrame | None:
    """Lines of the other files as the engine reads them, if there are such files; a file that grows meanwhile stays small."""
    small = _plain(raw.sparkSession) & (F.col("size") <= _most_small(raw.sparkSession))
    packed = _names_codecs(raw.sparkSession) or any(re.search(PACKED, name) for name in _names_of(raw))
    if not packed and not _has_larger(raw, _most_small(raw.sparkSession)):
        return None
    others = described(raw, root, layout).filter(~small).select("file_path")
    rows = described(texts(), root, layout).filter(~small).select(
        *LINE_COLUMNS, F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    return rows.join(F.broadcast(others), "file_path", "left_semi").select(*LINE_COLUMNS, "line", "block", "row_id")


def _line_blocks(rows: DataFrame) -> DataFrame:
    """One row per block of a file: its first row, and its lines, bytes and lines before it.

    Small and other files are listed one after the other; a file that grows meanwhile counts with its first size.
    """
    blocks = rows.groupBy("cluster_id", "file_path", "file_name", "size", "last_modified", "log_type", "block").agg(
        F.min("row_id").alias("first_row"), F.count("*").alias("block_lines"),
        F.sum(F.octet_length("line")).alias("block_bytes"),
        F.bool_and(F.is_valid_utf8("line")).alias("valid"),
    ).withColumn("first_size", F.expr("min(size) OVER (PARTITION BY file_path)")).filter("size = first_size")
    before = F.expr(
        "coalesce(sum(block_lines) OVER (PARTITION BY file_path ORDER BY block "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    return blocks.drop("first_size").withColumn("before", before)


def _numbered(rows: DataFrame, blocks: DataFrame, placed: bool = False) -> DataFrame:
    starts = blocks.select("file_path", "size", "block", "first_row", "before")
    return join_checked(rows, starts, ["file_path", "size", "block"], placed=placed).withColumn(
        "line_number", F.col("before") + F.col("row_id") - F.col("first_row") + 1)


def oversize_lines(
    spark: SparkSession,
    root: str,
    max_size_mb: float,
    log_types: Sequence[str] | None = None,
    cluster_id: str | None = None,
    layout: str = LAYOUT,
) -> DataFrame:
    """Numbered lines, with the columns of their file, of the files that a size cap leaves out.

    The lines are those of the text that :func:`log_contents` would give: a plain
    file that ends with a line end has an empty last line, which the bytes of the
    file tell (they are not known of a gzip file, which never gets one). Files
    with bytes that are no UTF-8 are left out, as there.
    """
    wanted = F.col("size") > int(max_size_mb * MB)
    if log_types:
        wanted = wanted & F.col("log_type").isin(*log_types)

    def found(raw: DataFrame, texts: Callable[..., DataFrame]) -> DataFrame:
        small = _small_lines(raw, root, layout, whole=True).filter(wanted).select(
            *LINE_COLUMNS, (F.col("place") + 1).alias("line_number"), "line")
        rows = _block_rows(raw, texts, root, layout)
        return small if rows is None else small.unionByName(_oversize_blocks(rows.filter(wanted)))

    return _in_waves(spark, root, cluster_id, found)


def _oversize_blocks(rows: DataFrame) -> DataFrame:
    blocks = cut_lineage(_line_blocks(rows))
    whole = blocks.groupBy(*LINE_COLUMNS).agg(
        F.sum("block_lines").alias("n"), F.sum("block_bytes").alias("bytes"), F.bool_and("valid").alias("valid"))
    ends = F.col("size") - F.col("bytes")      # one byte a line end, or two
    last = whole.filter(
        F.col("valid") & ~F.lower("file_path").endswith(".gz") & ((ends == F.col("n")) | (ends == 2 * F.col("n")))
    ).select(*LINE_COLUMNS, (F.col("n") + 1).alias("line_number"), F.lit("").alias("line"))
    bad = whole.filter(~F.col("valid")).select("file_path")
    numbered = _numbered(rows, blocks, placed=True).select(*LINE_COLUMNS, "line_number", "line")
    return join_checked(numbered, bad, ["file_path"], "left_anti").unionByName(last)


def write_contents(contents: DataFrame, root: str, gzip: bool = False, folder_files: int | None = None) -> str:
    """Write texts as files ``root/cluster_id=<id>/log=<name>/part-*``; returns the layout regex.

    On a local file system without Hadoop's native library the engine's writer
    starts processes for every file to set its mode, and its commit moves the
    files one after the other. There each task writes its files itself, under a
    hidden name first, so that a repeated task replaces its own files. A folder
    takes as much disk as a small file; with ``folder_files`` the tasks put
    that many files into a folder of theirs, named ``cluster_id=<id>=log=<name>=part-*``.
    """
    name = F.replace(F.expr("substr(file_path, length(cluster_id) + 2)"), F.lit("/"), F.lit("_"))
    out = contents.select("cluster_id", name.alias("log"), "content")
    if _is_local(contents.sparkSession, root):
        place, run = os.path.abspath(root.removeprefix("file://").removeprefix("file:")), uuid.uuid4().hex
        os.makedirs(place)      # a folder that is there already is an error, as with the engine's writer
        ordered = out.select(
            *(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("cluster_id", "log")), F.col("content").cast("binary"))
        ordered.sortWithinPartitions("cluster_id", "log").foreachPartition(
            _text_writer(place, run, gzip, folder_files))
        if folder_files:
            return r"[^/]+/cluster_id=([^/=]+)=log=([^/=]+)=[^/]+$"
    else:
        writer = out.write.partitionBy("cluster_id", "log")
        if gzip:
            writer = writer.option("compression", "gzip")
        writer.text(root)
    return r"cluster_id=([^/]+)/log=([^/]+)/[^/]+$"


def _is_local(spark: SparkSession, root: str) -> bool:
    """Whether Hadoop takes ``root`` for a path of the machine's own file system."""
    scheme, found, _ = root.partition(":/")
    if not found:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
        scheme = (default or "file:///").partition(":")[0]
    return scheme == "file"


def _text_writer(place: str, run: str, gzip: bool, folder_files: int | None) -> Callable[[Iterable[Row]], None]:
    """Writes one file per (cluster, log) of a task's sorted rows, each text with a line end behind it.

    Folders are named as the engine names those of a partitioned table. The
    function brings along all it needs, because executors may lack this package.
    """
    def folder(column, value):
        kept = "__HIVE_DEFAULT_PARTITION__" if value is None else re.sub(
            r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)
        return f"{column}={kept}"

    def put(path, rows):
        packed = zlib.compressobj(9, zlib.DEFLATED, 31) if gzip else None
        with open(path, "wb") as out:
            for row in rows:
                text = bytes(row["content"] or b"") + b"\n"
                out.write(packed.compress(text) if packed else text)
            if packed:
                out.write(packed.flush())

    def show(hidden, at):
        if os.path.isdir(at):      # of an earlier try of this task
            shutil.rmtree(at)
        os.rename(hidden, at)

    def write(rows):
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}"
        unseen = f".{task.taskAttemptId()}-{run}"
        ending = ".txt.gz" if gzip else ".txt"
        files = groupby(rows, key=lambda r: (r["cluster_id"], r["log"]))
        at = None
        for number, ((cluster_id, log), texts) in enumerate(files):
            parts = folder("cluster_id", cluster_id), folder("log", log)
            if folder_files is None:
                at = os.path.join(place, *parts)
                os.makedirs(at, exist_ok=True)
                put(os.path.join(at, unseen), texts)
                os.replace(os.path.join(at, unseen), os.path.join(at, f"{name}-{run}{ending}"))
                continue
            if number % folder_files == 0:
                if number:
                    show(at, os.path.join(place, f"{name}-{number // folder_files - 1:06d}"))
                at = os.path.join(place, f"{unseen}-{number}")
                os.mkdir(at)
            put(os.path.join(at, "=".join(parts) + f"={name}{ending}"), texts)
        if folder_files is not None and at:
            show(at, os.path.join(place, f"{name}-{number // folder_files:06d}"))

    return write
