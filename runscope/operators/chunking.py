"""Fixed-size chunks of log lines, scored by the errors they show.

Chunks are cut inside the row of their file, so splitting and scoring need no
shuffle. ``file_chunks`` keeps them as an array per file, which later steps use
to reduce a file before anything is shuffled; ``log_chunks`` is the flat form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.catalogs import ANALYSIS_CATALOG, LOG_TYPE_WEIGHT, SCORE_KEYWORDS, Catalog
from runscope.functions.classify import analysis_rank
from runscope.functions.guard import Guards, low_sql
from runscope.functions.text import WORD, quote_regex, sql_text
from runscope.operators.ranking import (
    cut_lineage,
    join_checked,
    preceding_total,
    top_n_per_group,
)

SCORE_FLAGS = "(?id)"
LINES_PER_CHUNK = 100
QUERY_WEIGHT = 2.0

FILE_COLUMNS = ("cluster_id", "file_path", "file_name", "log_type", "size", "last_modified")


def _counter(catalog: Catalog):
    """Guards for all patterns and keywords, and SQL that counts one in chunk ``c``."""
    words = [rf"\b{word}\b" for word, _ in SCORE_KEYWORDS]
    guards = Guards([*(p for cat in catalog for p in cat.patterns), *words])

    def count(pattern: str) -> str:
        matches = f"regexp_count(c.content, {sql_text(SCORE_FLAGS + pattern)})"
        return f"coalesce({guards.sql('c.low', 'c.flags', pattern, matches)}, 0)"

    return guards, count


def _hits_sql(catalog: Catalog, count) -> str:
    """Matches per category, in catalog order."""
    per_category = (" + ".join(count(p) for p in cat.patterns) or "0" for cat in catalog)
    return f"array({', '.join(per_category)})"


def _base_sql(search_query: str | None, count) -> str:
    """The part of the score that does not depend on the catalog."""
    types = ", ".join(f"'{kind}', {weight}D" for kind, weight in LOG_TYPE_WEIGHT.items())
    parts = [f"coalesce(element_at(map({types}), log_type), {LOG_TYPE_WEIGHT['unknown']}D)"]
    parts += [f"{count(rf'\b{word}\b')} * {weight}D" for word, weight in SCORE_KEYWORDS]
    if search_query:
        literal = sql_text(SCORE_FLAGS + quote_regex(search_query))
        parts.append(f"regexp_count(c.content, {literal}) * {QUERY_WEIGHT}D")
    return " + ".join(parts)


def score_sql(catalog: Catalog, categories: int | None = None, chunk: str = "c") -> str:
    """Priority score of a chunk when only the first ``categories`` count."""
    terms = [
        f"{chunk}.hits[{i}] * {cat.weight!r}D" for i, cat in enumerate(catalog[:categories])
    ]
    return f"round({' + '.join([f'{chunk}.base', *terms])}, 6)"


def indicators_sql(catalog: Catalog, categories: int | None = None, chunk: str = "c") -> str:
    """Names of the categories with a match, in catalog order."""
    names = ", ".join(
        f"if({chunk}.hits[{i}] > 0, {sql_text(cat.name)}, NULL)"
        for i, cat in enumerate(catalog[:categories])
    )
    return f"array_compact(array({names}))"


def split_chunks(contents: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Adds ``texts``: the chunks of a file that are not blank."""
    if lines_per_chunk < 1:
        raise ValueError("lines_per_chunk must be at least 1")
    n = lines_per_chunk
    lines = contents.select(*FILE_COLUMNS, F.split("content", "\n", -1).alias("l"))
    pieces = (
        f"filter(transform(sequence(0, size(l) - 1, {n}), "
        f"i -> array_join(slice(l, i + 1, {n}), '\\n')), x -> x RLIKE {sql_text(WORD)})"
    )
    return lines.select(*FILE_COLUMNS, F.expr(pieces).alias("texts"))


def file_chunks(
    contents: DataFrame,
    search_query: str | None = None,
    lines_per_chunk: int = LINES_PER_CHUNK,
    catalog: Catalog = ANALYSIS_CATALOG,
) -> DataFrame:
    """Adds ``chunks``: ``(chunk_no, content, hits, base)`` for every chunk of a file.

    ``hits`` holds the match count of each category, so every later score and
    indicator list comes from one pass over the text.
    """
    return scored_texts(split_chunks(contents, lines_per_chunk), search_query, catalog)


def scored_texts(
    split: DataFrame, search_query: str | None = None, catalog: Catalog = ANALYSIS_CATALOG, extra: Sequence[str] = ()
) -> DataFrame:
    """``chunks`` as in :func:`file_chunks`, from rows with ``texts``; ``extra`` columns are kept."""
    split = split.withColumn(
        # compressed files have no weight of their own
        "log_type", F.when(F.col("log_type") == "compressed", "unknown").otherwise(F.col("log_type")),
    )
    guards, count = _counter(catalog)
    lowered = f"transform(texts, x -> named_struct('content', x, 'low', {low_sql('x')}))"
    flagged = (
        f"transform({lowered}, c -> named_struct('content', c.content, 'low', c.low, "
        f"'flags', {guards.flags_sql('c.low')}))"
    )
    scored = (
        f"transform({flagged}, (c, i) -> named_struct('chunk_no', i, 'content', c.content, "
        f"'hits', {_hits_sql(catalog, count)}, 'base', {_base_sql(search_query, count)}))"
    )
    return split.select(*FILE_COLUMNS, *extra, F.expr(scored).alias("chunks"))


def log_chunks(
    contents: DataFrame,
    search_query: str | None = None,
    lines_per_chunk: int = LINES_PER_CHUNK,
    catalog: Catalog = ANALYSIS_CATALOG,
) -> DataFrame:
    """One row per chunk with its priority score and error indicators."""
    files = file_chunks(contents, search_query, lines_per_chunk, catalog)
    # outer generators, because the others add a filter that computes the chunks twice
    rows = files.select(*FILE_COLUMNS, F.explode_outer("chunks").alias("c")).filter("c IS NOT NULL")
    return rows.select(
        *FILE_COLUMNS, "c.chunk_no", "c.content",
        F.expr(score_sql(catalog)).alias("priority_score"),
        F.expr(indicators_sql(catalog)).alias("error_indicators"),
    )


def file_key() -> Column:
    """Sort key for the input order of files: by type, largest first, newest first."""
    age = F.coalesce(-F.unix_micros(F.col("last_modified").cast("timestamp")), F.lit(2**63 - 1))
    return F.struct(
        analysis_rank(F.col("log_type")).alias("type_rank"), (-F.col("size")).alias("smallness"),
        age.alias("age"), F.col("file_path"),
    )


def file_order() -> list[Column]:
    return [file_key()]


def number_chunks(contents: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Chunks with ``chunk_id``: consecutive over all files of a cluster, from 0.

    Only the chunk counts of the files take part in the running total, and a
    cluster with very many files is spread over tasks.
    """
    split = split_chunks(contents, lines_per_chunk)
    counts = split.select(
        "cluster_id", "file_path", "log_type", "size", "last_modified",
        F.size("texts").cast("bigint").alias("chunk_count"),
    )
    starts = preceding_total(counts, ["cluster_id"], file_order(), "chunk_count", "first_id")
    return (
        join_checked(
            split, starts.select("cluster_id", "file_path", "first_id"), ["cluster_id", "file_path"]
        )
        .select("cluster_id", "file_path", "file_name", "log_type", "first_id",
                F.posexplode_outer("texts").alias("chunk_no", "content"))
        .filter("content IS NOT NULL")
        .withColumn("chunk_id", F.col("first_id") + F.col("chunk_no"))
        .drop("first_id")
    )


def pick_files(inventory: DataFrame, max_files: int = 10) -> DataFrame:
    """The files of each cluster that are analyzed: error-prone types, then large ones."""
    slim = inventory.select("cluster_id", "file_path", "log_type", "size", "last_modified")
    return top_n_per_group(slim, ["cluster_id"], file_order(), max_files, ["file_path"])


def with_texts(
    ranked: DataFrame, contents: DataFrame, lines_per_chunk: int, shown: str = "true"
) -> DataFrame:
    """Adds ``content`` to a few ranked chunks, in a second look at their files.

    ``ranked`` holds keys and scores only, so ranking never moves any text.
    Rows that ``shown`` (SQL) rules out get a null.
    """
    placed = cut_lineage(ranked)
    keys = ["cluster_id", "file_path", "chunk_no"]
    pieces = split_chunks(contents, lines_per_chunk).select(
        "cluster_id", "file_path", F.posexplode_outer("texts").alias("chunk_no", "content")
    ).filter("content IS NOT NULL")
    texts = join_checked(pieces, placed.filter(shown).select(*keys), keys, "left_semi", placed=True)
    content = F.when(F.expr(shown), F.col("content")).alias("content")
    return placed.join(texts, keys, "left").select(*placed.columns, content)


def top_chunk_keys(
    contents: DataFrame,
    n: int = 10,
    search_query: str | None = None,
    lines_per_chunk: int = LINES_PER_CHUNK,
    catalog: Catalog = ANALYSIS_CATALOG,
) -> DataFrame:
    """Keys and scores of the ``n`` best chunks of each cluster, without their texts.

    Every file is reduced to its own best ``n`` chunks before the shuffle.
    """
    best = (
        "slice(array_sort(transform(chunks, c -> named_struct("
        f"'negative_score', -({score_sql(catalog)}), 'chunk_no', c.chunk_no, "
        f"'error_indicators', {indicators_sql(catalog)}))), 1, {n})"
    )
    rows = file_chunks(contents, search_query, lines_per_chunk, catalog).select(
        *FILE_COLUMNS, F.expr(f"inline_outer({best})")
    ).filter("chunk_no IS NOT NULL")
    order = [F.col("negative_score"), *file_order(), F.col("chunk_no")]
    ranked = top_n_per_group(rows, ["cluster_id"], order, n, ["file_path"], rank="chunk_rank")
    return ranked.select(
        "cluster_id", "chunk_rank", "file_path", "file_name", "log_type", "chunk_no",
        (-F.col("negative_score")).alias("priority_score"), "error_indicators",
    )


def top_chunks(
    contents: DataFrame,
    n: int = 10,
    search_query: str | None = None,
    lines_per_chunk: int = LINES_PER_CHUNK,
    catalog: Catalog = ANALYSIS_CATALOG,
) -> DataFrame:
    """The ``n`` chunks of each cluster with the highest score, ties in input order."""
    keys = top_chunk_keys(contents, n, search_query, lines_per_chunk, catalog)
    return with_texts(keys, contents, lines_per_chunk)
