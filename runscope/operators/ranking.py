"""Per-group top-n and running totals that hold when one group is huge."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 32


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int | None,
    salt_on: Sequence[str],
    rank: str = "rn",
    salts: int = SALTS,
) -> DataFrame:
    """First ``n`` rows of every group, in ``order``, numbered from 1 in ``rank``.

    Rows are ranked inside (group, salt) first and only the survivors meet in
    one task per group, at most ``n * salts`` of them. Spark also drops rows
    beyond ``n`` before each shuffle (WindowGroupLimit). ``order`` must be
    total, which makes the result independent of the salt. ``None`` keeps and
    numbers all rows, by range partitions instead of one task a group.
    """
    if n is None:
        numbered = preceding_total(df.withColumn("__one", F.lit(1)), keys, order, "__one", "__ahead")
        return numbered.withColumn(rank, (F.col("__ahead") + 1).cast("int")).drop("__one", "__ahead")
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= n)
        .withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)
        .drop("__salt")
    )


def top_n_with_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: Column,
    total: str,
    salt_on: Sequence[str],
    rank: str = "rn",
    salts: int = SALTS,
) -> DataFrame:
    """Top rows per group plus the group's sum of ``total`` on its first row.

    One pass gives both: a salted part of the group keeps its top rows and puts
    its sum on the first of them, and the same step then joins the parts.
    """
    out = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    for part in ([*keys, "__salt"], list(keys)):
        group = Window.partitionBy(*part)
        out = (
            out.withColumns({
                rank: F.row_number().over(group.orderBy(*order)),
                "__sum": F.sum(total).over(group),
            })
            .filter(F.col(rank) <= limit)
            .withColumn(total, F.when(F.col(rank) == 1, F.col("__sum")).otherwise(0))
        )
    return out.drop("__salt", "__sum")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def kept_packed(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut_lineage`, for rows with texts: packed columns take a fraction of a checkpoint's disk."""
    place = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is
    made only for a local master without that setting, as in tests; elsewhere
    a missing setting is an error, because a machine-local folder would not
    outlive its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="runscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


# Largest row count and row width for which a key table is broadcast: 100 MB.
BROADCAST_ROWS = 500_000
BROADCAST_ROW_BYTES = 200


def join_checked(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", placed: bool = False,
    width: Column | None = None,
) -> DataFrame:
    """Join texts with a slim table without moving the texts, if the table is small.

    The slim table is written once (unless it is ``placed`` already), and its
    rows and key lengths are counted.
    Below the bound it is broadcast; above it the engine shuffles both sides,
    with its runtime filters and its handling of skewed keys. ``width`` measures
    what the slim table has besides its keys, if that is of any length.
    """
    table = small if placed else cut_lineage(small)
    chars_of = sum((F.coalesce(F.length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0))
    if width is not None:
        chars_of = chars_of + width
    rows, chars = table.agg(F.count("*"), F.coalesce(F.sum(chars_of), F.lit(0))).first()
    fits = rows <= BROADCAST_ROWS and chars <= BROADCAST_ROWS * BROADCAST_ROW_BYTES
    return big.join(F.broadcast(table) if fits else table, list(keys), how)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables an operator writes."""
    unique = os.urandom(6).hex()
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{unique}"


def preceding_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: str,
    out: str,
    partitions: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group (0 for the first).

    A plain running window would put a whole group into one task. Instead rows
    are range-partitioned by (keys, order), so a large group spans many
    partitions; the placement is fixed by a checkpoint, per-partition totals
    give each partition its start, and the running sum stays inside one
    (group, partition) pair. ``df`` should be slim, e.g. one row per file.
    """
    spark = df.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_cols = [F.col(k) for k in keys]
    placed = cut_lineage(
        df.repartitionByRange(partitions, *key_cols, *order)
        .withColumn("__part", F.spark_partition_id())
    )
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "__part").agg(F.sum(value).alias("__total"))
        .withColumn("__start", F.coalesce(F.sum("__total").over(ahead), F.lit(0)))
        .drop("__total")
    )
    inside = (
        Window.partitionBy(*keys, "__part").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("__before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*keys, "__part"])
        .withColumn(out, F.col("__before") + F.col("__start"))
        .drop("__before", "__start", "__part")
    )
