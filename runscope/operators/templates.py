"""Templates of lines: what repeats in lines that no pattern names.

Variable parts (times, ids, paths, numbers) are masked, and equal masked lines
are counted before anything else moves. The distinct masked lines form a prefix
tree by number of words and then by their first words; a node with more children
than ``WIDE`` has a variable in that place, and its children become one. The
words behind the depth of the tree stay where all lines of a leaf agree. A level
of the tree is one count per (node, word) and one per node, both combined before
the shuffle, and only wide nodes are joined back. Lines are written once, packed,
because a checkpoint takes several times the disk of the texts; levels see beginnings only.

Defined results: null, empty and blank lines are left out; lines that are equal
after masking are one template; the result does not depend on the order of rows;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.operators.ranking import cut_lineage, join_checked, kept_packed

# Masks in the order in which they apply; the syntax is common to Java and RE2.
MASKS = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?", "<time>"),
    (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|0x[0-9a-fA-F]+", "<id>"),
    (r"([A-Za-z][A-Za-z0-9]*:/)?(/[A-Za-z0-9_.=%+-]+)+", "<path>"),
    (r"[0-9]+([.:][0-9]+)*", "<num>"),
)
ANY = "<*>"
DEPTH = 4
WIDE = 20
_EDGE = "\u0001"


def masked(line: Column) -> Column:
    """The line with its variable parts replaced and one blank between words."""
    for pattern, name in MASKS:
        line = F.regexp_replace(line, pattern, name)
    return F.trim(F.regexp_replace(line, r"[ \t]+", " "))


def _masked_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with ``masked``; a filter on a plain column would mask every line a second time."""
    return lines.select(
        "cluster_id", "file_path", "line_number", "line", F.explode_outer(F.array(masked(F.col("line")))).alias("masked")
    ).filter("masked <> ''")


def line_templates(lines: DataFrame, depth: int = DEPTH, wide: int = WIDE) -> DataFrame:
    """``template, words, lines, clusters, distinct_lines, example_file, example_number, example``.

    ``lines`` has ``cluster_id, file_path, line_number, line``. The example is the
    first line of a template by path and number. ``distinct_lines`` counts the
    masked lines that went into it. Runs a few jobs on slim rows while it is called.
    """
    if depth < 0 or wide < 1:
        raise ValueError("depth must not be negative and wide must be at least 1")
    first = F.min(F.struct("file_path", "line_number", "line"))
    counted = kept_packed(
        _masked_lines(lines).groupBy("masked", "cluster_id").agg(F.count("*").alias("n"), first.alias("first"))
        .withColumn("first", F.col("first").withField("line", F.nullif("first.line", "masked"))), "lines")
    counted = counted.withColumn("first", F.col("first").withField("line", F.coalesce("first.line", "masked"))).withColumn(
        "t", F.split("masked", " ")).withColumn("node", F.size("t").cast("string"))
    # a node follows from the number of words and the first of them, so the levels need no whole line
    heads = kept_packed(counted.select("node", F.slice("t", 1, max(depth, 1)).alias("t")).distinct(), "heads")
    for level in range(depth):
        broad = cut_lineage(_broad(heads, level, wide))
        heads, counted = (_resolved(df, broad, level) for df in (heads, counted))
    behind = counted.select("node", F.posexplode_outer(F.slice("t", depth + 1, F.greatest(F.size("t"), F.lit(1))))
                            .alias("place", "word")).filter("word IS NOT NULL")
    tails = behind.groupBy("node", "place").agg(F.min("word").alias("low"), F.max("word").alias("high")).groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct(
            "place", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(ANY).alias("word")))).alias("tail"))
    sums = (
        counted.groupBy("node", "cluster_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        .groupBy("node").agg(F.sum("n").alias("lines"), F.count("*").alias("clusters"), F.min("first").alias("first"))
        .join(counted.select("node", "masked").distinct().groupBy("node").agg(F.count("*").alias("distinct_lines")), "node")
        .join(tails, "node", "left")
    )
    head = F.slice(F.split("node", _EDGE), 2, max(depth, 1))
    words = F.concat(head, F.coalesce(F.transform("tail", lambda x: x.word), F.array().cast("array<string>")))
    return sums.select(
        F.array_join(words, " ").alias("template"), F.size(words).alias("words"), "lines", "clusters", "distinct_lines",
        F.col("first.file_path").alias("example_file"), F.col("first.line_number").alias("example_number"),
        F.col("first.line").alias("example"),
    )


def _broad(heads: DataFrame, level: int, wide: int) -> DataFrame:
    """Nodes with too many children."""
    return (
        heads.select("node", F.get("t", F.lit(level)).alias("word")).filter("word IS NOT NULL").distinct()
        .groupBy("node").agg(F.count("*").alias("children")).filter(F.col("children") > wide)
        .select("node", F.lit(True).alias("broad"))
    )


def _resolved(rows: DataFrame, broad: DataFrame, level: int) -> DataFrame:
    """The nodes one word deeper; in nodes with too many children that word is a variable."""
    word = F.get("t", F.lit(level))
    deeper = F.concat_ws(_EDGE, "node", F.when(word.isNotNull() & F.col("broad"), ANY).otherwise(word))
    return join_checked(rows, broad, ["node"], "left", placed=True).withColumn("node", deeper).drop("broad")
