"""Chunk analysis per cluster: error summary, best chunks and a text report.

Each file is reduced to the keys of its best chunks and its per-category counts
inside its row. Only those few slim rows are shuffled, in two salted steps, and
from then on a cluster is a bounded set of rows. The texts of the chunks that
are shown are fetched at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.catalogs import ANALYSIS_CATALOG, SEVERITY_RANK, Catalog, solution_text
from runscope.functions.text import WORD, limit_tokens, sql_text, token_estimate
from runscope.operators.chunking import (
    FILE_COLUMNS,
    LINES_PER_CHUNK,
    file_chunks,
    file_key,
    indicators_sql,
    pick_files,
    score_sql,
    with_texts,
)
from runscope.operators.ranking import cut_lineage, join_checked, top_n_per_group, top_n_with_total
from runscope.plans.reports import iterative_report, standard_report

TOKEN_LIMIT = 100_000
MAX_SIZE_MB = 20
EXAMPLES = 3
TOP_CHUNKS = 10
# Fixed values of the rounds: categories searched (None = all) and chunks kept.
ROUNDS = ((3, 5), (6, 10), (None, 20))
ROUND_CHUNKS = 15
SAMPLE_CHUNKS, SAMPLE_CHARS = 5, 500
MIN_BUDGET = 1000

_CHUNK = (
    "named_struct('file_path', {c}.file_path, 'file_name', {c}.file_name, 'log_type', {c}.log_type, "
    "'chunk_no', {c}.chunk_no, 'content', {c}.content, 'priority_score', -{c}.neg, "
    "'error_indicators', {c}.error_indicators)"
)


def _lookup(catalog: Catalog, value, key: str) -> str:
    """SQL that maps a category name to a fixed value of the catalog."""
    pairs = ", ".join(f"{sql_text(cat.name)}, {value(cat)}" for cat in catalog)
    return f"element_at(map({pairs}), {key})"


def _category_columns(catalog: Catalog, key: str) -> dict[str, str]:
    return {
        "description": f"concat({_lookup(catalog, lambda c: sql_text(c.label), key)}, "
                       "' related issues detected')",
        "severity": _lookup(catalog, lambda c: sql_text(c.severity), key),
        "suggested_solution": _lookup(catalog, lambda c: sql_text(solution_text(c.label)), key),
        "severity_rank": _lookup(catalog, lambda c: str(SEVERITY_RANK.get(c.severity, 0)), key),
        "place": _lookup(catalog, lambda c: str([x.name for x in catalog].index(c.name)), key),
    }


def _groups(files: DataFrame, catalog: Catalog, top: int) -> DataFrame:
    """Top rows of each (cluster, category), and of all chunks under the name ''.

    ``n`` on the first row of a group counts the chunks that belong to it.
    """
    ranked = files.select(
        "cluster_id", "file_path", "file_name", "log_type", file_key().alias("file_key"),
        F.expr(
            "array_sort(transform(chunks, c -> named_struct("
            f"'neg', -({score_sql(catalog)}), 'chunk_no', c.chunk_no, "
            f"'error_indicators', {indicators_sql(catalog)})))"
        ).alias("r"),
    )
    names = ", ".join(sql_text(cat.name) for cat in catalog)
    every = (
        f"transform(slice(r, 1, {top}), (c, i) -> named_struct('category', '', 'neg', c.neg, "
        "'chunk_no', c.chunk_no, 'n', if(i = 0, CAST(size(r) AS BIGINT), 0L), "
        "'error_indicators', c.error_indicators))"
    )
    shown = (
        f"flatten(transform(array({names}), t -> flatten(transform("
        "array(filter(r, c -> array_contains(c.error_indicators, t))), s -> "
        f"transform(slice(s, 1, {EXAMPLES}), (c, i) -> named_struct('category', t, 'neg', c.neg, "
        "'chunk_no', c.chunk_no, 'n', if(i = 0, CAST(size(s) AS BIGINT), 0L), "
        "'error_indicators', CAST(NULL AS ARRAY<STRING>)))))))"
    )
    rows = ranked.select(
        "cluster_id", "file_path", "file_name", "log_type", "file_key",
        F.expr(f"inline_outer(concat({every}, {shown}))"),
    ).filter("chunk_no IS NOT NULL")
    limit = F.when(F.col("category") == "", top).otherwise(EXAMPLES)
    order = [F.col("neg"), F.col("file_key"), F.col("chunk_no")]
    return top_n_with_total(rows, ["cluster_id", "category"], order, limit, "n", ["file_path"])


def _summaries(groups: DataFrame, catalog: Catalog) -> DataFrame:
    """One row per (cluster, category): count, example files and sort keys."""
    columns = ["rn", "file_path", "file_name", "log_type", "chunk_no", "neg", "error_indicators"]
    if "content" in groups.columns:
        columns.append("content")
    items = F.array_sort(F.collect_list(F.struct(*columns)))
    grouped = groups.groupBy("cluster_id", "category").agg(
        F.sum("n").alias("frequency"), items.alias("items"),
        F.min(F.struct("neg", "file_key", "chunk_no")).alias("first"),
    )
    return grouped.withColumns(
        {name: F.expr(sql) for name, sql in _category_columns(catalog, "category").items()}
    )


def error_summary(
    contents: DataFrame,
    search_query: str | None = None,
    lines_per_chunk: int = LINES_PER_CHUNK,
    catalog: Catalog = ANALYSIS_CATALOG,
) -> DataFrame:
    """Per (cluster, category): chunks showing it, severity, remedies, example files.

    ``place_in_report`` orders by severity, then frequency, then first sight.
    """
    files = file_chunks(contents, search_query, lines_per_chunk, catalog)
    found = _summaries(_groups(files, catalog, 1).filter("category <> ''"), catalog)
    # at most one row per category and cluster
    rank = F.expr(
        "row_number() OVER (PARTITION BY cluster_id "
        "ORDER BY severity_rank DESC, frequency DESC, first, place)"
    )
    return found.select(
        "cluster_id", F.col("category").alias("error_type"), "description", "frequency",
        "severity", "suggested_solution",
        F.expr("transform(items, x -> x.file_name)").alias("relevant_logs"),
        rank.alias("place_in_report"),
    )


def analyze_logs(
    contents: DataFrame,
    search_query: str | None = None,
    lines_per_chunk: int = LINES_PER_CHUNK,
    token_limit: int = TOKEN_LIMIT,
    catalog: Catalog = ANALYSIS_CATALOG,
) -> DataFrame:
    """One row per cluster: summary, ten best chunks, report text and token estimate."""
    files = file_chunks(contents, search_query, lines_per_chunk, catalog)
    groups = with_texts(
        _groups(files, catalog, TOP_CHUNKS), contents, lines_per_chunk, "category = ''"
    )
    found = _summaries(groups, catalog)
    entry = F.when(F.col("category") != "", F.struct(
        (-F.col("severity_rank")).alias("a"), (-F.col("frequency")).alias("b"), "first", "place",
        F.struct(
            F.col("category").alias("error_type"), "description", "frequency", "severity",
            "suggested_solution", F.expr("transform(items, x -> x.file_name)").alias("relevant_logs"),
        ).alias("e"),
    ))
    whole = F.col("category") == ""
    per_cluster = found.groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.e).alias("error_summary"),
        F.max(F.when(whole, F.expr(f"transform(items, c -> {_CHUNK.format(c='c')})")))
        .alias("prioritized_chunks"),
        F.max(F.when(whole, F.col("frequency"))).alias("chunk_count"),
    )
    return (
        per_cluster.withColumn("optimized_content", standard_report())
        .withColumn("optimized_content", limit_tokens(F.col("optimized_content"), token_limit))
        .withColumn("token_estimate", token_estimate(F.col("optimized_content")))
    )


def _rounds(
    contents: DataFrame, search_query: str | None, lines_per_chunk: int, catalog: Catalog,
    max_iterations: int,
) -> tuple[DataFrame, DataFrame]:
    """One row per (cluster, round): its chunks in rank order; and per cluster, the chunks that show each category.

    A file is reduced in its own row to the keys of its best chunks and to its
    totals, and these slim rows are written once, so the text is scored once.
    """
    files = file_chunks(contents, search_query, lines_per_chunk, catalog)
    plan = [ROUNDS[min(i, len(ROUNDS) - 1)] for i in range(max_iterations)]
    per_round = []
    for number, (categories, keep) in enumerate(plan, start=1):
        per_round.append(
            "transform(slice(array_sort(transform(chunks, c -> named_struct("
            f"'neg', -({score_sql(catalog, categories)}), 'chunk_no', c.chunk_no, "
            f"'error_indicators', {indicators_sql(catalog, categories)}"
            f"))), 1, {keep}), c -> named_struct('iteration', {number}, 'neg', c.neg, "
            "'chunk_no', c.chunk_no, 'error_indicators', c.error_indicators))"
        )
    showing = ", ".join(
        f"CAST(size(filter(chunks, c -> c.hits[{i}] > 0)) AS BIGINT)" for i in range(len(catalog)))
    reduced = cut_lineage(files.select(
        "cluster_id", "file_path", "file_name", "log_type", file_key().alias("file_key"),
        F.expr(f"concat({', '.join(per_round)})").alias("best"), F.expr(f"array({showing})").alias("showing"),
    ))
    totals = reduced.groupBy("cluster_id").agg(
        F.array(*[F.sum(F.get("showing", F.lit(i))) for i in range(len(catalog))]).alias("totals"))
    rows = reduced.select(
        "cluster_id", "file_path", "file_name", "log_type", "file_key", F.expr("inline_outer(best)"),
    ).filter("chunk_no IS NOT NULL")
    order = [F.col("neg"), F.col("file_key"), F.col("chunk_no")]
    best = top_n_per_group(
        rows, ["cluster_id", "iteration"], order, max(keep for _, keep in plan), ["file_path"]
    )
    limits = ", ".join(f"{number}, {keep}" for number, (_, keep) in enumerate(plan, start=1))
    kept = best.filter(F.expr(f"rn <= element_at(map({limits}), iteration)"))
    return with_texts(kept, contents, lines_per_chunk).groupBy("cluster_id", "iteration").agg(
        F.array_sort(F.collect_list(F.struct(
            "rn", "iteration", "file_path", "file_name", "log_type", "chunk_no", "content", "neg",
            "error_indicators",
        ))).alias("chunks")
    ), totals


def _round_errors(catalog: Catalog) -> str:
    """Error summary of one round from its chunks, most severe first."""
    names = ", ".join(sql_text(cat.name) for cat in catalog)
    columns = _category_columns(catalog, "t")
    return (
        f"transform(array_sort(flatten(transform(array({names}), t -> transform(filter("
        "array(filter(chunks, c -> array_contains(c.error_indicators, t))), s -> size(s) > 0), "
        "s -> named_struct("
        f"'a', -{columns['severity_rank']}, 'b', -size(s), 'first', s[0].rn, 'place', {columns['place']}, "
        f"'e', named_struct('error_type', t, 'description', {columns['description']}, "
        f"'frequency', CAST(size(s) AS BIGINT), 'severity', {columns['severity']}, "
        f"'suggested_solution', {columns['suggested_solution']}, "
        f"'relevant_logs', transform(slice(s, 1, {EXAMPLES}), c -> c.file_name), "
        "'seen_in', transform(s, c -> concat(c.file_path, '#', c.chunk_no)))))))), x -> x.e)"
    )


def _merged_errors(catalog: Catalog) -> str:
    """Errors of all rounds with equal type merged; frequencies are added up."""
    names = ", ".join(sql_text(cat.name) for cat in catalog)
    rank = _lookup(catalog, lambda c: str(SEVERITY_RANK.get(c.severity, 0)), "t")
    place = _category_columns(catalog, "t")["place"]
    return (
        f"transform(array_sort(flatten(transform(array({names}), t -> transform(filter("
        "array(filter(found, f -> f.e.error_type = t)), s -> size(s) > 0), s -> named_struct("
        f"'a', -{rank}, 'b', -aggregate(s, 0L, (x, f) -> x + f.e.frequency), "
        "'iteration', s[0].iteration, 'place', s[0].place, 'e', named_struct("
        "'error_type', t, 'description', s[0].e.description, "
        "'frequency', aggregate(s, 0L, (x, f) -> x + f.e.frequency), "
        "'distinct_chunks', CAST(size(array_distinct(flatten(transform(s, f -> f.e.seen_in)))) AS BIGINT), "
        f"'frequency_total', totals[{place}], "
        "'severity', s[0].e.severity, 'suggested_solution', s[0].e.suggested_solution, "
        "'relevant_logs', s[0].e.relevant_logs)))))), x -> x.e)"
    )


def analyze_iteratively(
    contents: DataFrame,
    search_query: str | None = None,
    max_iterations: int = 3,
    lines_per_chunk: int = LINES_PER_CHUNK,
    token_limit: int = TOKEN_LIMIT,
    catalog: Catalog = ANALYSIS_CATALOG,
) -> DataFrame:
    """Up to three rounds over more and more categories, one row per cluster.

    All rounds are scored from one pass over the text. A cluster whose first
    round shows a critical category stops there; a cluster also stops once its
    token budget falls below 1000. Frequencies add up over rounds;
    ``distinct_chunks`` counts each chunk once. Rounds take the categories of
    highest priority first, whatever the order of the catalog.

    A round keeps a few chunks only, and the names above count these. What ends
    in ``_total``, and ``category_totals``, count all chunks of the cluster: a
    category is listed there if a round that ran searched it and any chunk shows
    it, in the order of the catalog. ``max_iterations`` beyond the fixed rounds
    repeats the last one. Slim tables are written while the plan is built.
    """
    catalog = tuple(sorted(catalog, key=lambda c: -c.priority))
    sample = (
        f"aggregate(slice(chunks, 1, {SAMPLE_CHUNKS}), 0, "
        f"(x, c) -> x + regexp_count(substring(c.content, 1, {SAMPLE_CHARS}), {sql_text(WORD)})) * 1.3D"
    )
    kept, totals = _rounds(contents, search_query, lines_per_chunk, catalog, max_iterations)
    rounds = (
        kept.withColumn("errors", F.expr(_round_errors(catalog)))
        .withColumn("estimate", F.expr(sample))
    )
    per_cluster = rounds.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("iteration", "chunks", "errors", "estimate"))).alias("all")
    ).join(totals, "cluster_id")
    searched = {
        number: catalog[: ROUNDS[min(number, len(ROUNDS)) - 1][0]] for number in range(1, max_iterations + 1)
    }
    names = "map(" + ", ".join(
        f"{n}, {sql_text(', '.join(cat.name for cat in own))}" for n, own in searched.items()) + ")"
    sizes = "map(" + ", ".join(f"{n}, {len(own)}" for n, own in searched.items()) + ")"
    seen = f"slice(totals, 1, element_at({sizes}, r.iteration))"
    entry = (
        "struct<iteration:int,patterns_searched:string,errors_found:int,"
        "chunks_analyzed:int,token_usage:double,errors_total:int,frequency_total:bigint>"
    )
    # the walk over the rounds carries the budget left and whether to go on
    walk = (
        f"aggregate(all, named_struct('left', {float(token_limit)}D, 'go', true, "
        f"'done', CAST(array() AS ARRAY<{entry}>)), (s, r) -> if(NOT s.go, s, named_struct("
        "'left', s.left - least(r.estimate, s.left), "
        "'go', NOT (r.iteration = 1 AND exists(r.errors, e -> e.severity = 'critical')) "
        f"AND s.left - least(r.estimate, s.left) >= {MIN_BUDGET}, "
        "'done', concat(s.done, array(named_struct('iteration', r.iteration, "
        f"'patterns_searched', element_at({names}, r.iteration), 'errors_found', size(r.errors), "
        "'chunks_analyzed', size(r.chunks), 'token_usage', least(r.estimate, s.left), "
        f"'errors_total', size(filter({seen}, n -> n > 0)), "
        f"'frequency_total', aggregate({seen}, 0L, (x, n) -> x + n)))))), "
        "s -> s.done)"
    )
    walked = per_cluster.withColumn("iteration_breakdown", F.expr(walk))
    ran = walked.withColumn("ran", F.expr("slice(all, 1, size(iteration_breakdown))"))
    chunk = _CHUNK.format(c="c").replace("named_struct(", "named_struct('iteration', c.iteration, ", 1)
    places = ", ".join(f"named_struct('error_type', {sql_text(cat.name)}, 'frequency_total', totals[{i}])"
                       for i, cat in enumerate(catalog))
    gathered = ran.select(
        "cluster_id", "iteration_breakdown", "totals",
        F.expr(f"filter(slice(array({places}), 1, element_at({sizes}, size(iteration_breakdown))), "
               "x -> x.frequency_total > 0)").alias("category_totals"),
        F.expr("flatten(transform(ran, r -> transform(r.errors, (e, i) -> "
               "named_struct('iteration', r.iteration, 'place', i, 'e', e))))").alias("found"),
        F.expr(f"flatten(transform(ran, r -> transform(r.chunks, c -> {chunk})))").alias("chunks"),
    )
    merged = gathered.select(
        "cluster_id", F.expr(_merged_errors(catalog)).alias("error_summary"),
        F.slice("chunks", 1, ROUND_CHUNKS).alias("prioritized_chunks"), "chunks",
        "iteration_breakdown", F.size("iteration_breakdown").alias("total_iterations"), "category_totals",
    )
    return (
        merged.withColumn("optimized_content", iterative_report())
        .withColumn("optimized_content", limit_tokens(F.col("optimized_content"), token_limit))
        .withColumn("token_estimate", token_estimate(F.col("optimized_content")))
        .drop("chunks")
    )


def analyze_cluster_logs(
    contents: DataFrame,
    search_pattern: str | None = None,
    max_files: int | None = 10,
    max_size_mb: float | None = None,
    method: str = "standard",
    lines_per_chunk: int = LINES_PER_CHUNK,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Analysis of the ``max_files`` most telling files of every cluster.

    The files are chosen on the inventory, without reading any text, before
    a size cap applies, if one is given. ``max_files=None`` takes all.
    """
    if method not in ("standard", "iterative"):
        raise ValueError("method must be 'standard' or 'iterative'")
    chosen = pick_files(contents if inventory is None else inventory, max_files)
    small = contents if max_size_mb is None else contents.filter(F.col("size") <= int(max_size_mb * 1024 * 1024))
    wanted = join_checked(
        small, chosen.select("cluster_id", "file_path"), ["cluster_id", "file_path"], "left_semi"
    )
    counted = wanted.groupBy("cluster_id").agg(F.count("*").alias("files_analyzed"))
    run = analyze_logs if method == "standard" else analyze_iteratively
    result = run(wanted, search_pattern, lines_per_chunk=lines_per_chunk)
    return result.join(counted, "cluster_id").withColumns({
        "search_pattern": F.lit(search_pattern).cast("string"), "analysis_method": F.lit(method),
    })
