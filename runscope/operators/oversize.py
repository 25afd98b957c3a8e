"""Files too large for one row, seen as blocks of text or as chunks, from their numbered lines.

Input is ``oversize_lines`` (:func:`runscope.sources.files.oversize_lines`): a row
per line with the columns of its file and ``line_number``. No row ever holds a
file, and a file of any size is spread over tasks: places come from sums over
groups of lines, which are added up over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.catalogs import ANALYSIS_CATALOG, Catalog
from runscope.functions.text import WORD
from runscope.operators.chunking import (
    FILE_COLUMNS,
    LINES_PER_CHUNK,
    file_order,
    indicators_sql,
    score_sql,
    scored_texts,
)
from runscope.operators.ranking import cut_lineage, join_checked, preceding_total, top_n_per_group

GROUP_LINES = 64
BLOCK_CHARS = 1 << 20
HALO_LINES = 32
CONTEXT_LINES = 2


def log_blocks(
    lines: DataFrame, block_chars: int = BLOCK_CHARS, halo_lines: int = HALO_LINES, group_lines: int = GROUP_LINES
) -> DataFrame:
    """Blocks of about ``block_chars`` characters, whole groups of lines, for
    :func:`runscope.operators.matching.find_block_matches`.

    ``content`` goes ``halo_lines`` into the next block, ``own_chars`` says how
    many characters are the block's own, and ``before`` has the two lines in
    front. ``offset`` and ``first_line`` place the block in its file. A block is
    larger than ``block_chars`` by one group of ``group_lines`` lines at most.
    """
    if not CONTEXT_LINES <= halo_lines <= group_lines:
        raise ValueError(f"halo_lines must lie between {CONTEXT_LINES} and group_lines")
    group = F.floor((F.col("line_number") - 1) / group_lines)
    rows = lines.withColumn("grp", group)
    sums = rows.groupBy("file_path", "grp").agg(
        F.sum(F.length("line") + 1).alias("chars"), F.max("line_number").alias("last_line"))
    placed = preceding_total(sums, ["file_path"], [F.col("grp")], "chars", "before_chars").withColumn(
        "block", F.floor(F.col("before_chars") / block_chars))
    placed = cut_lineage(placed)
    # one row per block: a small share of what a row per group is
    blocks = placed.groupBy("file_path", "block").agg(
        F.min("grp").alias("first_grp"), F.max("grp").alias("last_grp"), F.max("last_line").alias("last_line"),
        F.min("before_chars").alias("offset"), F.sum("chars").alias("own_chars"))
    order = "OVER (PARTITION BY file_path ORDER BY block)"
    blocks = cut_lineage(blocks.withColumns({
        "previous_block": F.expr(f"lag(block) {order}"), "next_block": F.expr(f"lead(block) {order}")}))
    groups = placed.select("file_path", "grp", "block").join(blocks, ["file_path", "block"]).select(
        "file_path", "grp", "block", F.when(F.col("grp") == F.col("first_grp"), F.col("previous_block")).alias("halo_of"),
        F.when(F.col("grp") == F.col("last_grp"), F.col("next_block")).alias("before_of"), "last_line")
    known = join_checked(rows, groups, ["file_path", "grp"])
    in_group = F.col("line_number") - F.col("grp") * group_lines       # from 1
    roles = F.array_compact(F.array(
        F.struct(F.col("block"), F.lit("own").alias("role")),
        F.when(in_group <= halo_lines, _role("halo_of", "halo")),
        F.when(F.col("line_number") > F.col("last_line") - CONTEXT_LINES, _role("before_of", "before"))))
    spread = known.select(*FILE_COLUMNS, "line_number", "line", F.inline_outer(roles))
    held = spread.groupBy(*FILE_COLUMNS, "block").agg(
        F.array_sort(F.collect_list(F.struct("line_number", "role", "line"))).alias("l"))
    text = F.array_join(F.transform(F.filter("l", lambda x: x.role != "before"), lambda x: x.line), "\n")
    return held.join(
        blocks.select("file_path", "block", "next_block", "first_grp", "offset", "own_chars"), ["file_path", "block"]
    ).select(
        *FILE_COLUMNS, "block", "next_block", (F.col("first_grp") * group_lines + 1).alias("first_line"), "offset",
        "own_chars", F.transform(F.filter("l", lambda x: x.role == "before"), lambda x: x.line).alias("before"),
        text.alias("content"),
    )


def _role(block: str, role: str) -> Column:
    return F.when(F.col(block).isNotNull(), F.struct(F.col(block).alias("block"), F.lit(role).alias("role")))


def line_chunks(
    lines: DataFrame,
    search_query: str | None = None,
    lines_per_chunk: int = LINES_PER_CHUNK,
    catalog: Catalog = ANALYSIS_CATALOG,
) -> DataFrame:
    """``log_chunks`` of files that are read as lines: one row per chunk that is not blank.

    Lines are put together per (file, chunk), first inside a task, so that only
    chunks at the borders of tasks move in halves. The number of a chunk counts
    the chunks before it that are not blank, added up over range partitions.
    """
    if lines_per_chunk < 1:
        raise ValueError("lines_per_chunk must be at least 1")
    place = F.floor((F.col("line_number") - 1) / lines_per_chunk).alias("place")
    pieces = lines.groupBy(*FILE_COLUMNS, place).agg(
        F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("l")
    ).select(*FILE_COLUMNS, "place", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("content"))
    scored = scored_texts(
        pieces.filter(F.col("content").rlike(WORD)).select(*FILE_COLUMNS, "place", F.array("content").alias("texts")),
        search_query, catalog, ["place"]
    ).select(*FILE_COLUMNS, "place", F.col("chunks")[0].alias("c"))
    rows = cut_lineage(scored)
    numbers = preceding_total(
        rows.select("file_path", "place", F.lit(1).cast("bigint").alias("one")), ["file_path"], [F.col("place")], "one",
        "chunk_no")
    return rows.join(numbers.select("file_path", "place", F.col("chunk_no").cast("int").alias("chunk_no")),
                     ["file_path", "place"]).select(
        *FILE_COLUMNS, "chunk_no", "c.content", F.expr(score_sql(catalog)).alias("priority_score"),
        F.expr(indicators_sql(catalog)).alias("error_indicators"),
    )


def top_line_chunks(
    lines: DataFrame,
    n: int = 10,
    search_query: str | None = None,
    lines_per_chunk: int = LINES_PER_CHUNK,
    catalog: Catalog = ANALYSIS_CATALOG,
) -> DataFrame:
    """The ``n`` best chunks of each cluster, ranked by slim keys; texts are fetched for these only."""
    rows = cut_lineage(line_chunks(lines, search_query, lines_per_chunk, catalog))
    slim = rows.drop("content").withColumn("negative_score", -F.col("priority_score"))
    order = [F.col("negative_score"), *file_order(), F.col("chunk_no")]
    best = top_n_per_group(slim, ["cluster_id"], order, n, ["file_path", "chunk_no"], rank="chunk_rank").select(
        "cluster_id", "chunk_rank", "file_path", "chunk_no")
    return join_checked(rows, best, ["cluster_id", "file_path", "chunk_no"]).select(
        "cluster_id", "chunk_rank", "file_path", "file_name", "log_type", "chunk_no", "priority_score",
        "error_indicators", "content")
