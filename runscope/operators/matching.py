"""Error-pattern search over whole file texts.

Input is ``log_contents``: one row per file with at least ``cluster_id,
file_path, file_name, log_type, last_modified, content``. A file is one row and
its size is bounded by the size cap of the reader, so everything up to the
match rows is a narrow projection: no shuffle, no Python, text read once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.catalogs import (
    LEVEL_CAPS,
    LEVEL_CATALOGS,
    SEARCH_CATALOG,
    Catalog,
    as_catalog,
)
from runscope.functions.classify import line_timestamp, match_severity, search_rank
from runscope.functions.guard import Guards, low_sql
from runscope.functions.text import newlines_sql, sql_text, strip_sql
from runscope.operators.ranking import cut_lineage, join_checked, top_n_per_group

# Case-insensitive, multi-line anchors, and "\n" as the only line terminator.
SEARCH_FLAGS = "(?idm)"

FILE_COLUMNS = ("cluster_id", "file_path", "file_name", "log_type", "last_modified")
MATCH_COLUMNS = (
    "cluster_id", "file_path", "file", "file_type", "category", "pattern_idx", "pattern",
    "matched_text", "line", "line_number", "context", "timestamp", "position", "severity",
)

_SPOT = "struct<matched_text:string,position:int,line_number:int,breaks:int>"
_BLOCK = 128

# Array of spots (offset and line of a match) from ``h.texts``, the texts that
# ``h.regex`` matches in ``content``. The text before, between and after the
# matches is split by the same regex, so offsets are running sums over gap and
# match lengths. The sums are built in blocks, which keeps the growth of arrays
# cheap when a pattern is frequent. split() drops an empty piece in front of a
# zero-width match at offset 0; it is put back.
_PAIRS = f"""
transform(array(split(content, h.regex, -1)), gaps -> zip_with(
  slice(if(size(gaps) = size(h.texts), concat(array(''), gaps), gaps), 1, size(h.texts)),
  h.texts,
  (gap, text) -> named_struct(
    'text', text, 'chars', length(text), 'breaks', {newlines_sql('text')},
    'gap_chars', length(gap), 'gap_lines', {newlines_sql('gap')})))[0]"""
_BLOCKS = f"""
transform(array({_PAIRS}), p -> transform(
  sequence(0, CAST((size(p) - 1) DIV {_BLOCK} AS INT)), b -> slice(p, b * {_BLOCK} + 1, {_BLOCK})))[0]"""
_IN_BLOCK = f"""
aggregate(block,
  named_struct('position', s.position, 'line_number', s.line_number,
               'spots', CAST(array() AS ARRAY<{_SPOT}>)),
  (x, m) -> named_struct(
    'position', x.position + m.gap_chars + m.chars,
    'line_number', x.line_number + m.gap_lines + m.breaks,
    'spots', concat(x.spots, array(named_struct(
      'matched_text', m.text, 'position', x.position + m.gap_chars,
      'line_number', x.line_number + m.gap_lines, 'breaks', m.breaks)))))"""
_SPOTS = f"""
aggregate({_BLOCKS},
  named_struct('position', 0, 'line_number', 1, 'spots', CAST(array() AS ARRAY<ARRAY<{_SPOT}>>)),
  (s, block) -> transform(array({_IN_BLOCK}), d -> named_struct(
    'position', d.position, 'line_number', d.line_number,
    'spots', concat(s.spots, array(d.spots))))[0],
  s -> flatten(s.spots))"""

# Match rows of one category ``cat``: its patterns in order, cut at its cap, each
# with the enclosing line and two lines of context on either side.
_KEPT = f"""
transform(array(flatten(transform(cat.ids, (id, i) -> transform(
  coalesce(try_element_at(__spots, id), CAST(array() AS ARRAY<{_SPOT}>)),
  spot -> named_struct('idx', i, 'spot', spot))))),
  rows -> slice(rows, 1, coalesce(cat.cap, size(rows))))[0]"""


def _rows_sql(number: str = "row.spot.line_number") -> str:
    """SQL for the match rows; ``number`` is the place of a match's first line in ``__lines``."""
    first = f"greatest({number} - 2, 1)"
    line = f"array_join(slice(__lines, {number}, row.spot.breaks + 1), '\\n')"
    return f"""
transform({_KEPT}, row -> named_struct(
  'level', cat.level, 'category', cat.category, 'pattern_idx', row.idx,
  'pattern', cat.patterns[row.idx], 'matched_text', row.spot.matched_text,
  'line', {strip_sql(line)}, 'line_number', row.spot.line_number,
  'context', array_join(slice(__lines, {first}, {number} + 3 - {first}), '\\n'),
  'position', row.spot.position))"""


# What a block of a large file adds to the columns of its file.
BLOCK_COLUMNS = ("block", "next_block", "first_line", "offset", "own_chars", "before")
_BLOCK_ROWS = _rows_sql("row.spot.line_number + size(before)")
_ROWS = _rows_sql()


Plan = Sequence[tuple[int | None, Catalog, int | None]]


def _file_matches(contents: DataFrame, plan: Plan, blocks: bool = False) -> DataFrame:
    """Match rows of every (level, catalog, cap) in ``plan``, one scan for all.

    A pattern used by several levels is matched once. Within a file a category
    keeps its first ``cap`` matches by pattern, then position; that is what a
    file can contribute to the capped result.
    """
    spots, categories, columns = _file_spots(contents, plan, blocks)
    each = _BLOCK_ROWS if blocks else _ROWS
    return _exploded(spots, F.expr(f"flatten(transform({categories}, cat -> {each}))"), columns)


def _file_spots(contents: DataFrame, plan: Plan, blocks: bool = False) -> tuple[DataFrame, str, list[str]]:
    """Per file the places of all matches by pattern, the categories of ``plan`` as SQL, and the columns kept."""
    patterns = list(dict.fromkeys(p for _, cats, _ in plan for cat in cats for p in cat.patterns))
    number = {pattern: i for i, pattern in enumerate(patterns)}
    guards = Guards(patterns)
    columns = [*FILE_COLUMNS, *(BLOCK_COLUMNS if blocks else ())]
    base = contents.select(
        *columns, "content", F.expr(low_sql("content")).alias("__low")
    ).withColumn("__flags", F.expr(guards.flags_sql("__low")))

    candidates = []
    for pattern, i in number.items():
        regex = sql_text(SEARCH_FLAGS + pattern)
        texts = guards.sql(
            "__low", "__flags", pattern, f"regexp_extract_all(content, {regex}, 0)"
        )
        candidates.append(f"named_struct('id', {i}, 'regex', {regex}, 'texts', {texts})")
    hits = base.select(
        *columns, "content",
        F.expr(f"filter(array({', '.join(candidates)}), h -> size(h.texts) > 0)").alias("__hits"),
    )
    spots = hits.select(
        *columns,
        _lines(blocks).alias("__lines"),
        F.expr(f"map_from_entries(transform(__hits, h -> struct(h.id, {_SPOTS})))").alias("__spots"),
    )
    categories = []
    for level, catalog, cap in plan:
        for cat in catalog:
            ids = ", ".join(str(number[p]) for p in cat.patterns)
            texts = ", ".join(sql_text(p) for p in cat.patterns)
            if cat.patterns:
                categories.append(
                    f"named_struct('level', {'CAST(NULL AS INT)' if level is None else level}, "
                    f"'category', {sql_text(cat.name)}, "
                    f"'cap', {'CAST(NULL AS INT)' if cap is None else cap}, "
                    f"'ids', array({ids}), 'patterns', array({texts}))"
                )

    return spots, f"array({', '.join(categories)})", columns


def _lines(blocks: bool) -> Column:
    lines = F.split("content", "\n", -1)
    return F.concat("before", lines) if blocks else lines


def _exploded(spots: DataFrame, rows: Column, columns: Sequence[str]) -> DataFrame:
    """One row per match, from an array of match rows in the row of the file or block."""
    # the outer form, because explode would add a filter that computes the rows twice
    hit = spots.select(*columns, F.explode_outer(rows).alias("m")).filter("m IS NOT NULL")
    return hit.select(
        "cluster_id", "file_path",
        F.col("file_name").alias("file"),
        F.col("log_type").alias("file_type"),
        "last_modified", *columns[len(FILE_COLUMNS):], "m.*",
    ).withColumns({
        "timestamp": line_timestamp(F.col("line")),
        "severity": match_severity(F.col("line"), F.col("category")),
    })


def search_order() -> list[Column]:
    """Files by type and newest first, then by pattern and place in the file."""
    return [
        search_rank(F.col("file_type")), F.col("last_modified").desc_nulls_last(),
        F.col("file_path"), F.col("pattern_idx"), F.col("position"),
    ]


def find_matches(
    contents: DataFrame, patterns: Catalog | Mapping[str, Iterable[str]] = SEARCH_CATALOG
) -> DataFrame:
    """Every match of every pattern, uncapped: one row per match."""
    found = _file_matches(contents, [(None, as_catalog(patterns), None)])
    return found.select(*MATCH_COLUMNS)


def unmatched_lines(
    contents: DataFrame, patterns: Catalog | Mapping[str, Iterable[str]] = SEARCH_CATALOG, looks_like: str | None = None
) -> DataFrame:
    """``cluster_id, file_path, line_number, line`` of the lines that no match of a pattern touches.

    ``looks_like`` is a regex that a line must contain. Lines are picked in the
    row of their file, from the places of its matches. Blank lines are left out.
    """
    spots, _, _ = _file_spots(contents, [(None, as_catalog(patterns), None)])
    touched = ("flatten(transform(flatten(map_values(__spots)), "
               "s -> sequence(s.line_number, s.line_number + s.breaks)))")
    wanted = "x.line RLIKE '\\\\S'" if looks_like is None else f"x.line RLIKE {sql_text(looks_like)}"
    left = (
        f"filter(transform(array_except(sequence(1, size(__lines)), {touched}), "
        f"n -> named_struct('line_number', n, 'line', __lines[n - 1])), x -> {wanted})"
    )
    return spots.select("cluster_id", "file_path", F.expr(f"inline_outer({left})")).filter("line IS NOT NULL")


def find_block_matches(
    blocks: DataFrame, patterns: Catalog | Mapping[str, Iterable[str]] = SEARCH_CATALOG
) -> DataFrame:
    """Every match in files that are read in blocks, the same rows as on their whole texts.

    A block's text goes on into the next block as far as its halo, and a match
    belongs to the block in which it starts. Where it ends in the next block, the
    search of its pattern there must start behind it; these few (block, pattern)
    pairs are searched again from that place, until nothing changes. The rows
    are the same for patterns whose matches can span at most as many line ends as
    the halo has lines; ``cut_by_halo`` marks matches that reach the end of a halo.
    ``\\A`` and ``\\z`` stand for the ends of a block. Runs jobs while it is called.
    """
    catalog = as_catalog(patterns)
    kept = cut_lineage(blocks)
    found = _file_matches(kept, [(None, catalog, None)], blocks=True)
    own = cut_lineage(_own_matches(found, kept))
    keys = ["file_path", "block", "category", "pattern_idx"]
    carried, matches = None, own
    while True:
        beyond = matches.filter("end > own_chars AND next_block IS NOT NULL").groupBy(
            "file_path", F.col("next_block").alias("block"), "category", "pattern_idx", "pattern"
        ).agg(F.max(F.col("end") - F.col("own_chars")).cast("int").alias("carry"))
        now = cut_lineage(beyond)
        if carried is None:
            if now.isEmpty():
                break
        elif now.exceptAll(carried).isEmpty() and carried.exceptAll(now).isEmpty():
            break
        carried = now
        again = _own_matches(_matches_behind(kept, carried), kept)
        matches = cut_lineage(own.join(carried.select(*keys), keys, "left_anti").unionByName(again))
    return matches.withColumns({
        "line_number": (F.col("line_number") + F.col("first_line") - 1).cast("int"),
        "position": (F.col("position") + F.col("offset")).cast("int"),
    }).select(*MATCH_COLUMNS, "last_modified", "level", "cut_by_halo")


def _own_matches(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Matches that start in the block itself, with their end in its text."""
    sized = found.withColumn("end", F.col("position") + F.length("matched_text"))
    sizes = blocks.select("file_path", "block", F.length("content").alias("__chars"))
    return sized.filter(F.col("position") < F.col("own_chars")).join(sizes, ["file_path", "block"]).withColumn(
        "cut_by_halo", (F.col("end") == F.col("__chars")) & F.col("next_block").isNotNull()
    ).drop("__chars", "before")


def _matches_behind(blocks: DataFrame, carried: DataFrame) -> DataFrame:
    """Matches of single patterns in single blocks, searched from ``carry`` characters on.

    The first alternative takes the skipped text as a match of its own, so the
    pattern still sees what stands before the place where its search starts.
    """
    columns = [*FILE_COLUMNS, *BLOCK_COLUMNS]
    regex = F.concat(F.lit("\\A(?s:.{"), F.col("carry").cast("string"), F.lit("})|(?idm:"), F.col("pattern"), F.lit(")"))
    rows = join_checked(blocks, carried, ["file_path", "block"], placed=True).withColumn("__regex", regex)
    hits = rows.select(*columns, "content", "category", "pattern_idx", "pattern", F.array(F.struct(
        F.col("__regex").alias("regex"), F.regexp_extract_all("content", F.col("__regex"), F.lit(0)).alias("texts")
    )).alias("__hits"))
    spots = hits.select(
        *columns, "category", "pattern_idx", "pattern", _lines(True).alias("__lines"),
        F.expr(f"transform(transform(__hits, h -> {_SPOTS}), x -> slice(x, 2, size(x)))[0]").alias("__own"),
    )
    cat = ("named_struct('level', CAST(NULL AS INT), 'category', category, 'cap', CAST(NULL AS INT), "
           "'ids', array(0), 'patterns', array(pattern))")
    each = _BLOCK_ROWS.replace("try_element_at(__spots, id)", "__own")
    found = spots.withColumn("__idx", F.col("pattern_idx")).select(
        *columns, "__lines", "__own", "category", "pattern", "__idx")
    rows = F.expr(f"flatten(transform(array({cat}), cat -> {each}))")
    rows = F.transform(rows, lambda m: m.withField("pattern_idx", F.col("__idx")))
    return _exploded(found, rows, columns)


def table_matches(texts: DataFrame) -> DataFrame:
    """Match rows of each text for its own ``candidates``: an array of (category, pattern_idx, pattern, words).

    A regex runs where all its ``words`` occur; null words stand for a regex that runs always.
    """
    # the array of one text is walked, because a column used once would be computed again for every candidate
    met = (f"transform(array({low_sql('content')}), low -> filter(candidates, "
           "c -> c.words IS NULL OR forall(c.words, w -> contains(low, w))))[0]")
    hits = texts.select(
        *FILE_COLUMNS, "content", F.expr(
            f"filter(transform({met}, (c, i) -> named_struct("
            f"'id', i, 'category', c.category, 'pattern_idx', c.pattern_idx, 'pattern', c.pattern, "
            f"'regex', {sql_text(SEARCH_FLAGS)} || c.pattern, "
            f"'texts', regexp_extract_all(content, {sql_text(SEARCH_FLAGS)} || c.pattern, 0))), h -> size(h.texts) > 0)"
        ).alias("__hits"))
    spots = hits.select(
        *FILE_COLUMNS, _lines(False).alias("__lines"),
        F.expr("transform(__hits, h -> named_struct('id', h.id, 'category', h.category, 'pattern_idx', h.pattern_idx, "
               "'pattern', h.pattern))").alias("__found"),
        F.expr(f"map_from_entries(transform(__hits, h -> struct(h.id, {_SPOTS})))").alias("__spots"))
    fields = ("level", "category", "pattern_idx", "pattern", "matched_text", "line", "line_number", "context", "position")
    named = ", ".join(f"'{f}', {'found.pattern_idx' if f == 'pattern_idx' else f'm.{f}'}" for f in fields)
    cat = ("named_struct('level', CAST(NULL AS INT), 'category', found.category, 'cap', CAST(NULL AS INT), "
           "'ids', array(found.id), 'patterns', array(found.pattern))")
    each = f"transform(transform(array({cat}), cat -> {_ROWS})[0], m -> named_struct({named}))"
    return _exploded(spots, F.expr(f"flatten(transform(__found, found -> {each}))"), FILE_COLUMNS)


def search_error_patterns(
    contents: DataFrame,
    patterns: Catalog | Mapping[str, Iterable[str]] | None = None,
    max_per_category: int | None = 50,
    keep_order: bool = False,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """First ``max_per_category`` matches per (cluster, category) over all files.

    ``None`` lifts the cap, ``keep_order`` adds the rank as ``rn``. A caller's own catalog replaces the default one;
    run it through :func:`runscope.catalogs.valid_patterns` first when its
    regexes come from outside. ``blocks`` are those of files above the size cap
    (:func:`runscope.operators.oversize.log_blocks`), which are searched too.
    """
    catalog = as_catalog(patterns) if patterns else SEARCH_CATALOG
    if max_per_category is None:
        found = find_matches(contents, catalog)
        return found if blocks is None else found.unionByName(find_block_matches(blocks, catalog).select(*MATCH_COLUMNS))
    found = _file_matches(contents, [(None, catalog, max_per_category)])
    if blocks is not None:
        found = found.unionByName(find_block_matches(blocks, catalog).select(*found.columns))
    capped = top_n_per_group(
        found, ["cluster_id", "category"], search_order(), max_per_category, ["file_path"]
    )
    extra = ["last_modified", "rn"] if keep_order else []
    return capped.select(*MATCH_COLUMNS, *extra)


def search_by_level(
    contents: DataFrame,
    levels: Sequence[Catalog] = LEVEL_CATALOGS,
    caps: Sequence[int | None] = LEVEL_CAPS,
    max_levels: int = 3,
    dedupe: bool = False,
    keep_order: bool = False,
) -> DataFrame:
    """Level 1 for every cluster; deeper levels only where level 1 found nothing critical.

    All levels are matched in one pass over the text. After the caps a cluster
    holds a bounded number of rows, so the stop flag is a small window.
    ``dedupe`` keeps a match found on several levels once, at its first level.
    """
    plan = [
        (number, catalog, cap)
        for number, (catalog, cap) in enumerate(zip(levels, caps, strict=True), start=1)
    ][:max_levels]
    capped = _capped(_file_matches(contents, plan), plan)
    per_cluster = F.expr(
        "max(level = 1 AND category = 'critical_errors') OVER (PARTITION BY cluster_id)"
    )
    kept = (
        capped.withColumn("__stop", per_cluster)
        .filter((F.col("level") == 1) | ~F.col("__stop"))
        .select(*MATCH_COLUMNS, "level", *(["last_modified", "rn"] if keep_order else []))
    )
    if dedupe:
        same = ["cluster_id", "file_path", "category", "position", "pattern"]
        first = F.expr(f"min(level) OVER (PARTITION BY {', '.join(same)})")
        kept = kept.withColumn("__first", first).filter("level = __first").drop("__first")
    return kept


def _capped(found: DataFrame, plan: Plan) -> DataFrame:
    """The first matches per (cluster, level, category), each level up to its own cap, numbered in ``rn``."""
    cap = F.lit(None).cast("int")
    for number, _, size in plan:
        cap = F.when(F.col("level") == number, F.lit(size).cast("int")).otherwise(cap)
    sizes = [size for _, _, size in plan]
    return top_n_per_group(
        found, ["cluster_id", "level", "category"], search_order(),
        None if None in sizes else max(sizes), ["file_path"],
    ).filter(cap.isNull() | (F.col("rn") <= cap))


def search_by_level_staged(
    contents: DataFrame,
    levels: Sequence[Catalog] = LEVEL_CATALOGS,
    caps: Sequence[int | None] = LEVEL_CAPS,
    max_levels: int = 3,
    keep_order: bool = False,
) -> DataFrame:
    """:func:`search_by_level` in two looks at the texts: deeper levels only meet clusters that go on.

    Level 1 alone runs first and its capped matches are checkpointed. Clusters
    that stop there are then taken out by an anti-join below the text work, so
    their files are not matched again. Cheaper than one look at all levels where
    many clusters stop; it runs jobs while it is called.
    """
    plan = [
        (number, catalog, cap)
        for number, (catalog, cap) in enumerate(zip(levels, caps, strict=True), start=1)
    ][:max_levels]
    columns = [*MATCH_COLUMNS, "level", *(["last_modified", "rn"] if keep_order else [])]
    first = cut_lineage(_capped(_file_matches(contents, plan[:1]), plan[:1]).select(*columns))
    if len(plan) == 1:
        return first
    stopped = first.filter("category = 'critical_errors'").select("cluster_id").distinct()
    rest = join_checked(contents, stopped, ["cluster_id"], "left_anti")
    return first.unionByName(_capped(_file_matches(rest, plan[1:]), plan[1:]).select(*columns))


# All matches of one category ``cat`` of a file, with their line.
_SEEN = f"""
named_struct('level', cat.level, 'category', cat.category, 'rows', flatten(transform(cat.ids, (id, i) -> transform(
  coalesce(try_element_at(__spots, id), CAST(array() AS ARRAY<{_SPOT}>)),
  spot -> named_struct('pattern_idx', i, 'position', spot.position, 'line_number', spot.line_number, 'line',
    {strip_sql("array_join(slice(__lines, spot.line_number, spot.breaks + 1), '\\n')")})))))"""
CRITICAL_EXAMPLES, HIGH_EXAMPLES = 3, 2


def _file_stats(contents: DataFrame, plan: Plan) -> DataFrame:
    """One row per (file, level, category) with matches: counts by severity and the first of each severity."""
    spots, categories, columns = _file_spots(contents, plan)
    met = f"filter({categories}, cat -> exists(cat.ids, id -> map_contains_key(__spots, id)))"
    seen = spots.select(*columns, F.expr(f"transform({met}, cat -> {_SEEN})").alias("__seen"))
    judged = F.transform("__seen", lambda c: F.struct(
        c.level.alias("level"), c.category.alias("category"), F.transform(c.rows, lambda r: F.struct(
            r.pattern_idx.alias("pattern_idx"), r.position.alias("position"), r.line_number.alias("line_number"),
            r.line.alias("line"), match_severity(r.line, c.category).alias("severity"))).alias("rows")))
    split = F.transform(judged, lambda c: F.struct(
        c.level.alias("level"), c.category.alias("category"), F.size(c.rows).cast("bigint").alias("matches_total"),
        F.exists(c.rows, lambda r: _out_of_memory(r.line, c.category)).alias("memory_hits"),
        F.filter(c.rows, lambda r: r.severity == "critical").alias("critical"),
        F.filter(c.rows, lambda r: r.severity == "high").alias("high")))
    counted = F.transform(split, lambda c: F.struct(
        c.level.alias("level"), c.category.alias("category"), c.matches_total.alias("matches_total"),
        c.memory_hits.alias("memory_hits"), F.size(c.critical).cast("bigint").alias("critical_total"),
        F.size(c.high).cast("bigint").alias("high_total"),
        F.concat(F.slice(c.critical, 1, CRITICAL_EXAMPLES), F.slice(c.high, 1, HIGH_EXAMPLES)).alias("examples")))
    return seen.select(*columns, F.inline_outer(counted)).filter("matches_total > 0")


def _out_of_memory(line: Column, category: Column) -> Column:
    return (category == "critical_errors") & F.lower(line).contains("outofmemory")


def _levels_that_ran(counts: DataFrame) -> DataFrame:
    """Level 1, and deeper levels of clusters where level 1 found nothing critical."""
    stop = F.expr("max(level = 1 AND category = 'critical_errors') OVER (PARTITION BY cluster_id)")
    return counts.withColumn("__stop", stop).filter((F.col("level") == 1) | ~F.col("__stop")).drop("__stop")


def _totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("cluster_id", "level", "category").agg(
        *[F.sum(name).alias(name) for name in ("matches_total", "critical_total", "high_total")],
        F.max("memory_hits").alias("memory_hits"))


def category_stats(
    contents: DataFrame, levels: Sequence[Catalog] = LEVEL_CATALOGS, max_levels: int = 3
) -> DataFrame:
    """``cluster_id, level, category`` with counts over all matches and the first examples, from one look at the texts.

    Counts are ``matches_total, critical_total, high_total``; ``memory_hits``
    tells of a critical out-of-memory line. ``critical`` and ``high`` have the
    first three and two matches of that severity in search order. A file is
    reduced to counts and these few lines in its own row; those slim rows are
    checkpointed and used for both. Levels stop as in :func:`search_by_level`.
    """
    plan = [(number, catalog, None) for number, catalog in enumerate(levels, start=1)][:max_levels]
    stats = cut_lineage(_file_stats(contents, plan).select(
        "cluster_id", "file_path", F.col("file_name").alias("file"), F.col("log_type").alias("file_type"),
        "last_modified", "level", "category", "matches_total", "critical_total", "high_total", "memory_hits", "examples"))
    keys = ["cluster_id", "level", "category"]
    lines = stats.select(*keys, "file_path", "file", "file_type", "last_modified", F.inline("examples"))
    first = top_n_per_group(lines, [*keys, "severity"], search_order(), CRITICAL_EXAMPLES, ["file_path"])
    row = F.struct("rn", F.struct("file", "line_number", "line", "severity").alias("m"))
    # five rows a group at most
    shown = first.groupBy(*keys).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when((F.col("severity") == name) & (F.col("rn") <= n), row))),
                    lambda x: x.m).alias(name)
        for name, n in (("critical", CRITICAL_EXAMPLES), ("high", HIGH_EXAMPLES))])
    return _levels_that_ran(_totals(stats)).join(shown, keys, "left")


def level_totals(
    contents: DataFrame, levels: Sequence[Catalog] = LEVEL_CATALOGS, max_levels: int = 3
) -> DataFrame:
    """``cluster_id, level, category, matches_total, critical_total, high_total`` without caps.

    Levels stop as in :func:`search_by_level`. Matches are counted in the row
    of their file, so a few rows per file move.
    """
    plan = [(number, catalog, None) for number, catalog in enumerate(levels, start=1)][:max_levels]
    return _levels_that_ran(_totals(_file_stats(contents, plan))).drop("memory_hits")


def level_summary(
    contents: DataFrame,
    levels: Sequence[Catalog] = LEVEL_CATALOGS,
    caps: Sequence[int | None] = LEVEL_CAPS,
    max_levels: int = 3,
) -> DataFrame:
    """Per cluster and level that ran: categories searched, errors found under the caps, and all of them."""
    steps = []
    for number, catalog in list(enumerate(levels, start=1))[:max_levels]:
        names = ", ".join(cat.name for cat in catalog)
        used = "comprehensive" if number == 3 else names
        steps.append(F.struct(F.lit(number).alias("iteration"), F.lit(names).alias("categories"),
                              F.lit(used).alias("patterns_used")))
    counts = level_totals(contents, levels, max_levels).groupBy("cluster_id", F.col("level").alias("iteration")).agg(
        F.sum(under_cap(caps)).alias("errors_found"), F.sum("matches_total").alias("errors_total"),
        F.max(F.col("category") == "critical_errors").alias("critical"))
    grid = contents.select("cluster_id").distinct().select("cluster_id", F.inline(F.array(*steps)))
    joined = grid.join(counts, ["cluster_id", "iteration"], "left").withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in ("errors_found", "errors_total")}
    )
    stopped = F.expr("coalesce(max(iteration = 1 AND critical) OVER (PARTITION BY cluster_id), false)")
    return (
        joined.withColumn("__stop", stopped)
        .filter((F.col("iteration") == 1) | ~F.col("__stop"))
        .select("cluster_id", "iteration", "patterns_used", "categories", "errors_found", "errors_total")
    )


def under_cap(caps: Sequence[int | None] = LEVEL_CAPS) -> Column:
    """How many of a category's matches its level shows."""
    cap = F.lit(None).cast("bigint")
    for number, size in enumerate(caps, start=1):
        cap = F.when(F.col("level") == number, F.lit(size).cast("bigint")).otherwise(cap)
    return F.least("matches_total", cap)        # a null cap is no limit


def pattern_counts(
    contents: DataFrame, patterns: Catalog | Mapping[str, Iterable[str]] = SEARCH_CATALOG
) -> DataFrame:
    """Matches per file and pattern, without their places: the cheap form."""
    catalog = as_catalog(patterns)
    guards = Guards(p for cat in catalog for p in cat.patterns)
    base = contents.select(
        "cluster_id", "file_path", "content", F.expr(low_sql("content")).alias("__low")
    ).withColumn("__flags", F.expr(guards.flags_sql("__low")))
    counts = []
    for cat in catalog:
        for idx, pattern in enumerate(cat.patterns):
            n = f"regexp_count(content, {sql_text(SEARCH_FLAGS + pattern)})"
            counts.append(
                f"named_struct('category', {sql_text(cat.name)}, 'pattern_idx', {idx}, "
                f"'pattern', {sql_text(pattern)}, "
                f"'matches', CAST({guards.sql('__low', '__flags', pattern, n)} AS BIGINT))"
            )
    return (
        base.select("cluster_id", "file_path", F.expr(f"inline_outer(array({', '.join(counts)}))"))
        .filter("matches > 0")
    )
