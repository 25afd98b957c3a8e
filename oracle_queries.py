"""DuckDB SQL with the same results as :mod:`bound_queries`, name by name.

The SQL is written from the definitions of the operators, not from their
Spark plans: patterns are a table, matches are counted row by row, and caps
and rounds are plain window functions.
"""

from __future__ import annotations

from bound_queries import (
    DOCUMENT_LINES,
    DOCUMENT_QUERY,
    ITERATIVE_TOKENS,
    JOB_PATTERN,
    LINES,
    SNIPPET,
    TOKENS,
)
from runscope import catalogs as cat
from runscope.functions import classify
from runscope.operators import templates
from runscope.plans import diagnose, reports
from runscope.sources import tables

NL = "chr(10)"
# White space beyond ASCII, for RE2.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = f"[^{SPACES}]+"


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def text(value: str) -> str:
    """A literal that may hold line ends."""
    return "(" + f" || {NL} || ".join(q(part) for part in value.split("\n")) + ")"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)


def case_rank(column: str, order) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {i}" for i, k in enumerate(order))
    return f"(CASE {column} {whens} ELSE 99 END)"


def log_type(path: str, compressed: bool = True) -> str:
    name = f"lower(split_part({path}, '/', -1))"
    whens = " ".join(
        f"WHEN contains({name}, '{k}') THEN '{k}'"
        for k in ("stderr", "stdout", "log4j", "driver", "executor")
    )
    gz = f"WHEN suffix({name}, '.gz') THEN 'compressed' " if compressed else ""
    return f"(CASE {whens} {gz}ELSE 'unknown' END)"


SEARCH_RANK = case_rank("log_type", classify.SEARCH_FILE_ORDER)
ANALYSIS_RANK = case_rank("log_type", classify.ANALYSIS_FILE_ORDER)

# ---- base tables -------------------------------------------------------------

EVENT_LINES = f"""
lines AS (
  SELECT 'c' || user_id AS cluster_id,
         'c' || user_id || '/r' || (event_id // {tables.ROTATE_EVENTS}) || '/'
           || ({array(tables.LOG_NAMES)})[event_id % {len(tables.LOG_NAMES)} + 1] AS file_path,
         event_id, ts, event_type,
         substr(CAST(ts AS VARCHAR), 1, 19) || ' ' || CASE WHEN event_type = 'error'
           THEN ([{', '.join(text(m) for m in tables.ERROR_MESSAGES)}])[event_id % {len(tables.ERROR_MESSAGES)} + 1]
           ELSE 'INFO worker handled ' || event_type || ' item ' || event_id END AS line
  FROM events)"""

FILE_COLUMNS = f"""split_part(file_path, '/', -1) AS file_name, strlen(content) AS size,
         last_modified, {log_type('file_path')} AS log_type, content"""

EVENTS = f"""{EVENT_LINES},
contents AS (
  SELECT cluster_id, file_path, {FILE_COLUMNS}
  FROM (SELECT cluster_id, file_path, max(ts) AS last_modified,
               string_agg(line, {NL} ORDER BY ts, event_id) AS content
        FROM lines GROUP BY ALL))"""

DOCUMENTS = f"""
contents AS (
  SELECT cluster_id, file_path, {FILE_COLUMNS}
  FROM (SELECT source AS cluster_id,
               source || '/d' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '/'
                 || ({array(tables.LOG_NAMES)})[doc_id % {len(tables.LOG_NAMES)} + 1] AS file_path,
               TIMESTAMP '2024-01-01 00:00:00' AS last_modified, text AS content
        FROM documents))"""

# ---- pattern matches ---------------------------------------------------------


def severity(line: str = "line", category: str = "category") -> str:
    def any_of(words):
        return "(" + " OR ".join(f"contains(lower({line}), {q(w)})" for w in words) + ")"

    def one_of(names):
        return f"{category} IN ({', '.join(q(n) for n in names)})"

    return (
        f"CASE WHEN {any_of(classify.CRITICAL_WORDS)} THEN 'critical' "
        f"WHEN {any_of(classify.HIGH_WORDS)} OR {one_of(classify.HIGH_CATEGORIES)} THEN 'high' "
        f"WHEN {one_of(classify.MEDIUM_CATEGORIES)} THEN 'medium' ELSE 'low' END"
    )


def pattern_rows(catalog, level=None):
    return [(level, c.name, i, p) for c in cat.as_catalog(catalog) for i, p in enumerate(c.patterns)]


def matches(rows) -> str:
    """CTEs ending in ``found``: one row per match of the given patterns."""
    return f"""
pats(level, category, pattern_idx, pattern) AS ({values(rows)}),
raw AS (
  SELECT c.*, p.*, regexp_extract_all(content, '(?im)' || pattern) AS m,
         string_split_regex(content, '(?im)' || pattern) AS g, string_split(content, {NL}) AS l
  FROM contents c, pats p WHERE regexp_matches(content, '(?im)' || pattern)),
spots AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw),
placed AS (
  SELECT *, m[i] AS matched_text,
         CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
  FROM spots),
lined AS (
  SELECT *, CAST(length(substr(content, 1, pos)) - length(replace(substr(content, 1, pos), {NL}, '')) + 1 AS BIGINT) AS ln,
         length(matched_text) - length(replace(matched_text, {NL}, '')) AS breaks
  FROM placed),
found0 AS (
  SELECT cluster_id, file_path, file_name AS file, log_type AS file_type, category, pattern_idx,
         pattern, matched_text,
         regexp_replace(array_to_string(l[ln:ln + breaks], {NL}), '^[{SPACES}]+|[{SPACES}]+$', '', 'g') AS line,
         ln AS line_number, array_to_string(l[greatest(ln - 2, 1):ln + 2], {NL}) AS context,
         CAST(pos AS BIGINT) AS position, last_modified, {SEARCH_RANK} AS type_rank, level
  FROM lined),
found AS (
  SELECT *, nullif(regexp_extract(line, '{classify.TIMESTAMP_PATTERN}', 0), '') AS "timestamp",
         {severity()} AS severity
  FROM found0)"""


MATCH = ('cluster_id, file_path, file, file_type, category, pattern_idx, pattern, matched_text, line, '
         'line_number, context, "timestamp", position, severity')
SEARCH = matches(pattern_rows(cat.SEARCH_CATALOG))
ORDER = "type_rank, last_modified DESC, file_path, pattern_idx, position"


def capped(cap: int) -> str:
    return f"""
capped AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, category ORDER BY {ORDER}) AS rn
           FROM found QUALIFY rn <= {cap})"""


LEVEL_ROWS = [row for n, c in enumerate(cat.LEVEL_CATALOGS, 1) for row in pattern_rows(c, n)]
LEVELS = matches(LEVEL_ROWS) + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, level, category ORDER BY {ORDER}) AS rn FROM found),
capped AS (SELECT * FROM ranked WHERE rn <= ({array(cat.LEVEL_CAPS)})[level]),
kept AS (SELECT * FROM capped c WHERE level = 1
         OR NOT EXISTS (SELECT 1 FROM capped x WHERE x.cluster_id = c.cluster_id AND x.level = 1)),
whole AS (SELECT * FROM ranked c WHERE level = 1
          OR NOT EXISTS (SELECT 1 FROM ranked x WHERE x.cluster_id = c.cluster_id AND x.level = 1))"""

FINDINGS = """,
findings AS (
  SELECT cluster_id, category, CASE WHEN nc > 0 THEN 'critical' ELSE 'high' END AS severity,
         CASE WHEN nc > 0 THEN nc ELSE nh END AS "count", nc AS critical_total, nh AS high_total,
         array_to_string(CASE WHEN nc > 0 THEN lc[1:3] ELSE lh[1:2] END, chr(10)) AS examples
  FROM (SELECT cluster_id, category,
               count(*) FILTER (severity = 'critical') AS nc, count(*) FILTER (severity = 'high') AS nh,
               list(file || '|' || line_number || '|' || line ORDER BY level, rn) FILTER (severity = 'critical') AS lc,
               list(file || '|' || line_number || '|' || line ORDER BY level, rn) FILTER (severity = 'high') AS lh
        FROM whole GROUP BY ALL)
  WHERE nc + nh > 0)"""

OUT_OF_MEMORY = "(category = 'critical_errors' AND contains(lower(line), 'outofmemory'))"
ADVICE = "(" + values(cat.RECOMMENDATIONS) + ") AS a(category, recommendation)"

# ---- chunks ------------------------------------------------------------------


def chunks(n: int, keep: str = "true") -> str:
    return f"""
split AS (SELECT * EXCLUDE (content), string_split(content, {NL}) AS l FROM contents WHERE {keep}),
pieces AS (SELECT *, unnest(range(0, len(l), {n})) AS skip FROM split),
texts AS (SELECT * EXCLUDE (l), array_to_string(l[skip + 1:skip + {n}], {NL}) AS content FROM pieces),
chunk AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY skip) - 1 AS chunk_no
          FROM texts WHERE regexp_matches(content, '[^{SPACES}]'))"""


CATEGORY_ROWS = [
    (i, c.name, c.severity, c.label, cat.SEVERITY_RANK[c.severity], c.weight, cat.solution_text(c.label))
    for i, c in enumerate(cat.ANALYSIS_CATALOG)
]


def scored(query: str | None = None) -> str:
    """CTEs: ``hits`` per (chunk, category) and ``score`` per chunk and round."""
    literal = "0"
    if query:
        # the queries used here hold no special characters
        literal = f"len(regexp_extract_all(content, '(?i){query}')) * 2.0"
    keywords = " + ".join(
        rf"len(regexp_extract_all(content, '(?i)\b{w}\b')) * {weight}" for w, weight in cat.SCORE_KEYWORDS
    )
    types = " ".join(f"WHEN '{k}' THEN {w}" for k, w in cat.LOG_TYPE_WEIGHT.items())
    return f""",
cats(place, category, severity, label, severity_rank, weight, solution) AS ({values(CATEGORY_ROWS)}),
apats(level, category, pattern_idx, pattern) AS ({values(pattern_rows(cat.ANALYSIS_CATALOG))}),
hits AS (
  SELECT file_path, chunk_no, category, sum(len(regexp_extract_all(content, '(?i)' || pattern))) AS n
  FROM chunk, apats WHERE regexp_matches(content, '(?i)' || pattern) GROUP BY ALL),
shown AS (SELECT h.*, c.* EXCLUDE (category) FROM hits h JOIN cats c USING (category)),
weights AS (
  SELECT file_path, chunk_no, sum(n * weight) AS w12,
         coalesce(sum(n * weight) FILTER (place < 6), 0) AS w6,
         coalesce(sum(n * weight) FILTER (place < 3), 0) AS w3,
         array_to_string(list(category ORDER BY place), ',') AS i12,
         array_to_string(list(category ORDER BY place) FILTER (place < 6), ',') AS i6,
         array_to_string(list(category ORDER BY place) FILTER (place < 3), ',') AS i3
  FROM shown GROUP BY ALL),
base AS (
  SELECT *, {ANALYSIS_RANK} AS type_rank,
         (CASE log_type {types} ELSE 0.1 END) + {keywords} + {literal} AS b
  FROM chunk),
score AS (
  SELECT b.*, round(CAST(b + coalesce(w12, 0) AS DOUBLE), 6) AS s12, round(CAST(b + coalesce(w6, 0) AS DOUBLE), 6) AS s6,
         round(CAST(b + coalesce(w3, 0) AS DOUBLE), 6) AS s3,
         coalesce(i12, '') AS i12, coalesce(i6, '') AS i6, coalesce(i3, '') AS i3
  FROM base b LEFT JOIN weights USING (file_path, chunk_no))"""


FILE_ORDER = "type_rank, size DESC, last_modified DESC, file_path"


def ranked_chunks(query: str | None = None, keep: str = "true") -> str:
    return chunks(LINES, keep) + scored(query) + f""",
best AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY s12 DESC, {FILE_ORDER}, chunk_no) AS chunk_rank
         FROM score),
marked AS (SELECT h.category, h.severity, h.label, h.severity_rank, h.place, h.solution, b.*
           FROM shown h JOIN best b USING (file_path, chunk_no)),
summary AS (
  SELECT cluster_id, category AS error_type, any_value(label) || ' related issues detected' AS description,
         count(*) AS frequency, any_value(severity) AS severity, any_value(solution) AS suggested_solution,
         array_to_string(list(file_name ORDER BY chunk_rank)[1:3], ',') AS relevant_logs,
         any_value(severity_rank) AS severity_rank, min(chunk_rank) AS first, any_value(place) AS place
  FROM marked GROUP BY cluster_id, category),
errors AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id
         ORDER BY severity_rank DESC, frequency DESC, first, place) AS place_in_report
  FROM summary)"""


def quoted(names: str) -> str:
    return f"'[' || CASE WHEN {names} = '' THEN '' ELSE '''' || replace({names}, ',', ''', ''') || '''' END || ']'"


def excerpt_lines(rank: str, score: str, names: str, chars: int) -> str:
    cut = f"CASE WHEN length(content) > {chars} THEN {NL} || {q(reports.TRUNCATED)} ELSE '' END"
    return (
        f"printf({text(reports.EXCERPT_LINE)}, {rank}, file_name) || {NL} || "
        f"printf({q(reports.SCORE_LINE)}, {score}, {quoted(names)}) || {NL} || "
        f"substr(content, 1, {chars}) || {cut}"
    )


STANDARD = f""",
report AS (
  SELECT cluster_id, {text(reports.STANDARD_TITLE)}
    || coalesce({NL} || {q(reports.STANDARD_ERRORS)} || {NL} || et, '')
    || {NL} || {q(reports.STANDARD_EXCERPTS)} || {NL} || ct AS optimized_content
  FROM (SELECT cluster_id, string_agg({excerpt_lines('chunk_rank', 's12', 'i12', 1000)}, {NL} ORDER BY chunk_rank) AS ct
        FROM best WHERE chunk_rank <= 5 GROUP BY cluster_id)
  LEFT JOIN (SELECT cluster_id, string_agg(
               printf({q(reports.STANDARD_ERROR_LINE)}, upper(error_type), severity, frequency) || {NL}
               || printf({q(reports.SOLUTION_LINE)}, substr(suggested_solution, 1, 200)) || {NL}, {NL} ORDER BY place_in_report) AS et
             FROM errors WHERE place_in_report <= 5 GROUP BY cluster_id) USING (cluster_id)),
per_cluster AS (
  SELECT b.cluster_id, b.chunk_count, coalesce(e.errors, '') AS errors, b.chunks, r.optimized_content,
         round(len(regexp_extract_all(r.optimized_content, '{WORD}')) * 1.3e0, 6) AS token_estimate
  FROM (SELECT cluster_id, count(*) AS chunk_count,
               string_agg(file_path || '#' || chunk_no, ',' ORDER BY chunk_rank) FILTER (chunk_rank <= 10) AS chunks
        FROM best GROUP BY cluster_id) b
  LEFT JOIN (SELECT cluster_id, string_agg(error_type || '=' || frequency || '=' || severity, ',' ORDER BY place_in_report) AS errors
             FROM errors GROUP BY cluster_id) e USING (cluster_id)
  JOIN report r USING (cluster_id))"""


def rounds(budget: int) -> str:
    """CTEs of the iterative analysis; ``ran`` lists the rounds that took place."""
    per_round = " UNION ALL ".join(
        f"SELECT {n} AS iteration, {keep} AS keep, *, s{k} AS s, i{k} AS names FROM score"
        for n, (k, keep) in enumerate(((3, 5), (6, 10), (12, 20)), 1)
    )
    searched = [
        (n, ", ".join(c.name for c in cat.ANALYSIS_CATALOG[:k])) for n, k in ((1, 3), (2, 6), (3, 12))
    ]
    return chunks(LINES) + scored() + f""",
top AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id, iteration ORDER BY s DESC, {FILE_ORDER}, chunk_no) AS rn
  FROM ({per_round}) QUALIFY rn <= keep),
searched(iteration, patterns_searched) AS ({values(searched)}),
usage AS (
  SELECT cluster_id, iteration, count(*) AS chunks_analyzed,
         sum(len(regexp_extract_all(substr(content, 1, 500), '{WORD}'))) FILTER (rn <= 5) * 1.3e0 AS estimate
  FROM top GROUP BY ALL),
marks AS (
  SELECT t.cluster_id, t.iteration, t.rn, t.file_path, t.file_name, t.chunk_no, c.*
  FROM (SELECT *, unnest(string_split(names, ',')) AS category FROM top WHERE names <> '') t
  JOIN cats c USING (category)),
found AS (
  SELECT cluster_id, iteration, category, count(*) AS frequency, min(rn) AS first,
         any_value(severity) AS severity, any_value(severity_rank) AS severity_rank, any_value(place) AS place,
         any_value(solution) AS solution, list(file_path || '#' || chunk_no) AS seen
  FROM marks GROUP BY ALL),
listed AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id, iteration
         ORDER BY severity_rank DESC, frequency DESC, first, place) AS spot
  FROM found),
steps AS (
  SELECT u.*, coalesce(f.errors_found, 0) AS errors_found, coalesce(f.critical, false) AS critical,
         {budget}.0 - coalesce(sum(estimate) OVER (PARTITION BY u.cluster_id ORDER BY u.iteration
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget
  FROM usage u LEFT JOIN (SELECT cluster_id, iteration, count(*) AS errors_found,
                                 bool_or(severity = 'critical') AS critical
                          FROM found GROUP BY ALL) f USING (cluster_id, iteration)),
ran AS (
  SELECT s.*, least(estimate, budget) AS token_usage FROM steps s
  WHERE NOT EXISTS (SELECT 1 FROM steps p WHERE p.cluster_id = s.cluster_id AND p.iteration < s.iteration
                    AND ((p.iteration = 1 AND p.critical) OR p.budget - least(p.estimate, p.budget) < 1000))),
totals AS (
  SELECT cluster_id, category, count(*) AS frequency_total, any_value(place) AS place
  FROM (SELECT cluster_id, unnest(string_split(i12, ',')) AS category FROM score WHERE i12 <> '') JOIN cats USING (category)
  GROUP BY ALL),
round_totals AS (
  SELECT r.cluster_id, r.iteration, t.category, t.frequency_total, t.place
  FROM ran r JOIN totals t USING (cluster_id) JOIN searched s
    ON s.iteration = r.iteration AND list_contains(string_split(s.patterns_searched, ', '), t.category)),
merged AS (
  SELECT l.cluster_id, category, sum(frequency) AS frequency, any_value(l.severity) AS severity,
         any_value(solution) AS solution, any_value(severity_rank) AS severity_rank,
         min(l.iteration * 1000 + spot) AS spot, len(list_distinct(flatten(list(seen)))) AS distinct_chunks
  FROM listed l JOIN ran USING (cluster_id, iteration) GROUP BY l.cluster_id, category),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY severity_rank DESC, frequency DESC, spot) AS o
  FROM merged),
gathered AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.cluster_id ORDER BY t.iteration, t.rn) AS o
  FROM top t JOIN ran USING (cluster_id, iteration))"""


def _error_lines(where: str) -> str:
    return f"""(SELECT cluster_id, string_agg(printf({q(reports.ITERATIVE_ERROR_LINE)}, upper(category), CAST(frequency AS BIGINT))
      || {NL} || printf({q(reports.SOLUTION_LINE)}, substr(solution, 1, 150)), {NL} ORDER BY o) AS t
    FROM {where} GROUP BY cluster_id)"""


ITERATIVE = f""",
unique_chunks AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, o) AS x
  FROM (SELECT * FROM gathered QUALIFY row_number() OVER (PARTITION BY file_path, chunk_no ORDER BY s DESC, o) = 1)),
high AS (SELECT * FROM ordered WHERE severity = 'high' QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY o) <= 3),
report AS (
  SELECT cluster_id, {q(reports.ITERATIVE_TITLE)} || {NL}
    || printf({text(reports.ITERATIVE_ROUNDS)}, r.n) || {NL} || {q(reports.ITERATIVE_BREAKDOWN)} || {NL} || r.t || {NL}
    || coalesce({NL} || {q(reports.ITERATIVE_CRITICAL)} || {NL} || c.t || {NL}, '')
    || coalesce({NL} || {q(reports.ITERATIVE_HIGH)} || {NL} || h.t || {NL}, '')
    || {NL} || {q(reports.ITERATIVE_EXCERPTS)} || {NL} || e.t AS optimized_content
  FROM (SELECT cluster_id, count(*) AS n, string_agg(printf({q(reports.ITERATIVE_ROUND_LINE)}, iteration,
          CAST(errors_found AS BIGINT), chunks_analyzed, CAST(token_usage AS DOUBLE)), {NL} ORDER BY iteration) AS t
        FROM ran GROUP BY cluster_id) r
  LEFT JOIN {_error_lines("(SELECT * FROM ordered WHERE severity = 'critical')")} c USING (cluster_id)
  LEFT JOIN {_error_lines('high')} h USING (cluster_id)
  JOIN (SELECT cluster_id, string_agg({excerpt_lines('x', 's', 'names', 800)}, {NL} ORDER BY x) AS t
        FROM unique_chunks WHERE x <= 3 GROUP BY cluster_id) e USING (cluster_id))"""

# ---- snippets ----------------------------------------------------------------


def snippet(pattern: str, max_lines: int, k: int, keep: str = "true") -> str:
    return f"""
ls AS (SELECT cluster_id, file_path, file_name, log_type, string_split(content, {NL}) AS l
       FROM contents WHERE {keep}),
numbered AS (SELECT * EXCLUDE (l), unnest(l) AS line, generate_subscripts(l, 1) AS n FROM ls),
hit AS (SELECT cluster_id, file_path, file_name, log_type, n AS h FROM numbered WHERE regexp_matches(line, '(?i){pattern}')),
shown AS (
  SELECT h.cluster_id, h.file_path, h.file_name, h.log_type, h, n,
         printf('%s %4d: %s', CASE WHEN h = n THEN '>>>' ELSE '   ' END, n, line) AS t
  FROM hit h JOIN numbered x ON h.file_path = x.file_path AND x.n BETWEEN h - {k} AND h + {k}
  UNION ALL SELECT cluster_id, file_path, file_name, log_type, h, h + {k} + 1, '---' FROM hit),
cut AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY h, n) AS o FROM shown QUALIFY o <= {2 * max_lines}),
snip AS (
  SELECT cluster_id, file_path, file_name, log_type, string_agg(t, {NL} ORDER BY o) AS matches, lines_matched
  FROM cut JOIN (SELECT file_path, count(*) AS lines_matched FROM hit GROUP BY ALL) USING (file_path)
  GROUP BY ALL)"""


# ---- runs --------------------------------------------------------------------

JOBS = "jobs AS (SELECT c_custkey AS job_id, c_name AS job_name, c_mktsegment AS creator_user_name FROM customer)"
RUNS = """
runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS job_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'c' || (o_orderkey % 10) END AS cluster_id, 'run-' || o_orderkey AS run_name,
         CASE WHEN o_orderstatus <> 'P' THEN 'TERMINATED' WHEN o_orderpriority = '1-URGENT' THEN 'INTERNAL_ERROR'
              ELSE 'RUNNING' END AS life_cycle_state,
         CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' END AS result_state,
         o_orderdate AS start_time, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 2 HOUR END AS end_time,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(7200000 AS BIGINT) END AS execution_duration
  FROM orders),
tasks AS (
  SELECT l_orderkey AS run_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS task_key,
         'c' || l_suppkey AS cluster_id, CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'SUCCESS' END AS task_result,
         l_shipdate AS task_start
  FROM lineitem)"""
RUN_COLUMNS = """run_id, job_id, cluster_id, run_name, life_cycle_state, result_state,
  substr(CAST(start_time AS VARCHAR), 1, 19) AS start_time, substr(CAST(end_time AS VARCHAR), 1, 19) AS end_time,
  execution_duration"""
NAMED = f"regexp_matches(job_name, '(?i){JOB_PATTERN}')"
FAILED = ("(result_state IN ('FAILED', 'CANCELED', 'TIMEOUT') OR "
          "(life_cycle_state = 'INTERNAL_ERROR' AND life_cycle_state IS NOT NULL))")


def latest(hours: int, limit: int, jobs: str = "true") -> str:
    return f"""
latest AS (
  SELECT r.*, j.job_name, row_number() OVER (PARTITION BY r.job_id ORDER BY start_time DESC, run_id DESC) AS rn
  FROM runs r JOIN jobs j USING (job_id)
  WHERE start_time BETWEEN TIMESTAMP '{tables.RUNS_AS_OF}' - INTERVAL {hours} HOUR AND TIMESTAMP '{tables.RUNS_AS_OF}'
    AND {jobs} QUALIFY rn <= {limit})"""


RECENT_FAILED = f"""{JOBS}, {RUNS}, {latest(tables.LOOK_BACK_HOURS, 20)},
failed AS (SELECT * FROM latest WHERE coalesce({FAILED}, false)),
used AS (
  SELECT run_id, cluster_id FROM failed WHERE cluster_id IS NOT NULL
  UNION SELECT run_id, t.cluster_id FROM tasks t SEMI JOIN failed USING (run_id)),
everything AS (SELECT * FROM contents_all SEMI JOIN used USING (cluster_id))"""
AFFECTED = EVENTS.replace("contents AS (", "contents_all AS (", 1) + ", " + RECENT_FAILED + (
    ", contents AS (SELECT * FROM everything)"
)

# ---- streams -----------------------------------------------------------------


def windows(size_hours: int, slide_hours: int) -> str:
    size, slide = size_hours * 3600, slide_hours * 3600
    return f"""WITH {EVENT_LINES},
contents AS (SELECT cluster_id, file_path, file_path AS file_name, ts AS last_modified, 'x' AS log_type, line AS content
             FROM lines WHERE event_type = 'error'), {SEARCH},
timed AS (SELECT category, severity, CAST("timestamp" AS TIMESTAMP) AS t FROM found),
slots AS (
  SELECT *, to_timestamp((CAST(epoch(t) AS BIGINT) // {slide}) * {slide} - k * {slide})::TIMESTAMP AS w
  FROM timed, (SELECT unnest(range(0, {size // slide})) AS k))
SELECT CAST(w AS VARCHAR) AS window_start, CAST(w + INTERVAL {size_hours} HOUR AS VARCHAR) AS window_end,
       category, severity, count(*) AS errors
FROM slots WHERE w IS NOT NULL GROUP BY ALL"""


ORACLES: dict[str, str] = {
    "log_inventory": f"""WITH {EVENTS} SELECT cluster_id, file_path, file_name, size,
        substr(CAST(last_modified AS VARCHAR), 1, 19) AS last_modified, log_type FROM contents""",
    "log_type_class": f"""WITH {DOCUMENTS} SELECT file_path, log_type,
        {log_type('file_path', False)} AS analysis_type, {SEARCH_RANK} AS search_rank,
        {ANALYSIS_RANK} AS analysis_rank FROM contents""",
    "log_lines_numbered": f"""WITH {EVENTS}, ls AS (SELECT *, string_split(content, {NL}) AS l FROM contents)
        SELECT cluster_id, file_path, generate_subscripts(l, 1) AS line_number, unnest(l) AS line FROM ls""",
    "document_lines_numbered": f"""WITH {DOCUMENTS}, ls AS (SELECT *, string_split(content, {NL}) AS l FROM contents)
        SELECT cluster_id, file_path, generate_subscripts(l, 1) AS line_number, unnest(l) AS line FROM ls""",
    "pattern_matches": f"WITH {EVENTS}, {SEARCH} SELECT {MATCH} FROM found",
    "pattern_matches_capped": f"WITH {EVENTS}, {SEARCH}, {capped(5)} SELECT {MATCH} FROM capped",
    "search_error_patterns": f"WITH {EVENTS}, {SEARCH}, {capped(50)} SELECT {MATCH} FROM capped",
    "search_custom_patterns": f"""WITH {DOCUMENTS}, {matches(pattern_rows(tables.DOCUMENT_PATTERNS))},
        {capped(50)} SELECT {MATCH} FROM capped""",
    "custom_matches_all": f"""WITH {DOCUMENTS}, {matches(pattern_rows(tables.DOCUMENT_PATTERNS))}
        SELECT {MATCH} FROM found""",
    "rejected_patterns": f"""WITH {EVENTS}, {matches([(None, 'broken', 0, 'Table' + chr(92) + 's+or'), (None, 'fine', 0, 'heap' + chr(92) + 's+space')])}
        SELECT category, pattern, count(*) AS matches FROM found GROUP BY ALL""",
    "pattern_counts": f"""WITH {EVENTS}, {SEARCH} SELECT cluster_id, file_path, category, pattern_idx, pattern,
        count(*) AS matches FROM found GROUP BY ALL""",
    "match_severity": f"WITH {EVENTS}, {SEARCH} SELECT category, severity, count(*) AS matches FROM found GROUP BY ALL",
    "match_timestamp": f"""WITH {EVENTS}, {SEARCH} SELECT substr("timestamp", 1, 10) AS day, count(*) AS matches,
        count("timestamp") AS stamped, min("timestamp") AS first, max("timestamp") AS last FROM found GROUP BY 1""",
    "search_leveled": f"WITH {EVENTS}, {LEVELS} SELECT {MATCH}, level FROM kept",
    "search_leveled_distinct": f"""WITH {EVENTS}, {LEVELS} SELECT {MATCH}, level FROM kept
        QUALIFY row_number() OVER (PARTITION BY cluster_id, file_path, category, position, pattern ORDER BY level) = 1""",
    "level_summary": f"""WITH {EVENTS}, {LEVELS},
        steps(iteration, categories) AS ({values([(n, ', '.join(c.name for c in x)) for n, x in enumerate(cat.LEVEL_CATALOGS, 1)])})
        SELECT c.cluster_id, iteration, CASE WHEN iteration = 3 THEN 'comprehensive' ELSE categories END AS patterns_used,
               categories, (SELECT count(*) FROM capped k WHERE k.cluster_id = c.cluster_id AND k.level = iteration) AS errors_found,
               (SELECT count(*) FROM ranked k WHERE k.cluster_id = c.cluster_id AND k.level = iteration) AS errors_total
        FROM (SELECT DISTINCT cluster_id FROM contents) c, steps
        WHERE iteration = 1 OR c.cluster_id NOT IN (SELECT cluster_id FROM capped WHERE level = 1)""",
    "snippet_context": f"WITH {EVENTS}, {snippet(SNIPPET, 4, 2)} SELECT * FROM snip",
    "snippet_head": f"""WITH {DOCUMENTS}, ls AS (SELECT *, string_split(content, {NL})[1:20] AS l FROM contents)
        SELECT cluster_id, file_path, file_name, log_type, array_to_string(list_transform(l, lambda x, i: printf('%4d: %s', i, x)), {NL}) AS snippet
        FROM ls""",
    "search_log_pattern": f"""WITH {EVENTS}, {snippet(SNIPPET, 50, 3, "log_type IN ('stderr', 'log4j')")} SELECT * FROM snip""",
    "log_pattern_totals": f"""WITH {DOCUMENTS}, {snippet('tion the|ment de', 50, 3)}
        SELECT cluster_id, count(*) AS files_matched, CAST(sum(lines_matched) AS BIGINT) AS lines_matched FROM snip GROUP BY ALL""",
    "line_windows": f"""WITH {EVENTS}, {snippet(SNIPPET, 50, 2)}
        SELECT cluster_id, file_path, h AS hit_line, n AS line_number, t AS text FROM shown WHERE t <> '---'""",
    "quick_scan": f"""WITH {EVENTS}, {matches(pattern_rows(cat.QUICK_CATALOG))}, {capped(10)},
        kinds AS (SELECT *, CASE WHEN contains(lower(line), 'outofmemory') THEN 'Memory Issues'
            WHEN contains(lower(line), 'job') AND contains(lower(line), 'failed') THEN 'Job Failures'
            WHEN contains(lower(line), 'analysisexception') THEN 'SQL Errors' ELSE 'Critical Errors' END AS kind FROM capped)
        SELECT cluster_id, count(*) AS critical_errors_found,
               (SELECT count(*) FROM found f WHERE f.cluster_id = kinds.cluster_id) AS total_errors,
               array_to_string(list_sort(list(DISTINCT kind) FILTER (rn <= 5)), ',') AS error_types,
               string_agg(file || '|' || line_number || '|' || severity || '|' || line, {NL} ORDER BY rn) FILTER (rn <= 3) AS sample_errors,
               {q(diagnose.RERUN_ADVICE)} AS recommendation
        FROM kinds GROUP BY cluster_id""",
    "smart_findings": f"WITH {EVENTS}, {LEVELS} {FINDINGS} SELECT * FROM findings",
    "focus_area": f"""WITH {EVENTS}, {LEVELS} SELECT cluster_id, category, count(*) AS matches FROM whole
        WHERE category IN ('memory_issues', 'critical_errors', 'io_errors', 'configuration_errors') GROUP BY ALL""",
    "recommendations": f"""WITH {EVENTS}, {LEVELS} SELECT DISTINCT cluster_id, category, recommendation
        FROM (SELECT cluster_id, CASE WHEN {OUT_OF_MEMORY} THEN 'memory_issues' ELSE category END AS category FROM whole)
        JOIN {ADVICE} USING (category)""",
    "smart_analysis": f"""WITH {EVENTS}, {LEVELS.replace('kept AS', 'kept_all AS').replace('whole AS', 'whole_all AS')},
        kept AS (SELECT * FROM kept_all WHERE category IN ('memory_issues', 'critical_errors', 'spark_errors', 'io_errors')),
        whole AS (SELECT * FROM whole_all WHERE category IN ('memory_issues', 'critical_errors', 'spark_errors', 'io_errors'))
        {FINDINGS},
        advice AS (SELECT cluster_id, string_agg(recommendation, '; ' ORDER BY place) AS recommendations
          FROM (SELECT DISTINCT cluster_id, CASE WHEN {OUT_OF_MEMORY} THEN 'memory_issues' ELSE category END AS category FROM whole)
          JOIN ({values([(i, *r) for i, r in enumerate(cat.RECOMMENDATIONS)])}) AS a(place, category, recommendation) USING (category)
          GROUP BY cluster_id)
        SELECT k.cluster_id, total_errors, errors_total, deepest_level, error_breakdown, coalesce(critical_findings, '') AS critical_findings,
               coalesce(recommendations, '') AS recommendations
        FROM (SELECT cluster_id, CAST(sum(n) AS BIGINT) AS total_errors, CAST(sum(w) AS BIGINT) AS errors_total,
                     max(deepest) AS deepest_level,
                     string_agg(category || '=' || n || '=' || w, ',' ORDER BY category) AS error_breakdown
              FROM (SELECT cluster_id, category, count(*) AS n, max(level) AS deepest FROM kept GROUP BY ALL)
              JOIN (SELECT cluster_id, category, count(*) AS w FROM whole GROUP BY ALL) USING (cluster_id, category)
              GROUP BY cluster_id) k
        LEFT JOIN (SELECT cluster_id, string_agg(category || '=' || severity || '=' || "count", ',' ORDER BY category) AS critical_findings
                   FROM findings GROUP BY cluster_id) f USING (cluster_id)
        LEFT JOIN advice USING (cluster_id)""",
    "chunk_split": f"WITH {DOCUMENTS}, {chunks(DOCUMENT_LINES)} SELECT cluster_id, file_path, chunk_no, content FROM chunk",
    "chunk_ids": f"""WITH {EVENTS}, {chunks(LINES)} SELECT cluster_id, file_path, row_number() OVER (PARTITION BY cluster_id
        ORDER BY {ANALYSIS_RANK}, size DESC, last_modified DESC, file_path, chunk_no) - 1 AS chunk_id, chunk_no,
        md5(content) AS digest FROM chunk""",
    "chunk_score": f"""WITH {EVENTS}, {chunks(LINES)} {scored('worker handled')}
        SELECT cluster_id, file_path, chunk_no, s12 AS priority_score FROM score""",
    "chunk_score_documents": f"""WITH {DOCUMENTS}, {chunks(DOCUMENT_LINES)} {scored(DOCUMENT_QUERY)}
        SELECT cluster_id, file_path, chunk_no, s12 AS priority_score, i12 AS error_indicators FROM score""",
    "chunk_indicators": f"""WITH {EVENTS}, {chunks(LINES)} {scored()}
        SELECT cluster_id, file_path, chunk_no, i12 AS error_indicators FROM score""",
    "chunk_topk": f"""WITH {EVENTS}, {ranked_chunks()} SELECT cluster_id, chunk_rank, file_path, chunk_no, content,
        s12 AS priority_score, i12 AS error_indicators FROM best WHERE chunk_rank <= 10""",
    "error_summary": f"""WITH {EVENTS}, {ranked_chunks()} SELECT cluster_id, error_type, description, frequency, severity,
        suggested_solution, relevant_logs, place_in_report FROM errors""",
    "analyze_logs": f"WITH {EVENTS}, {ranked_chunks()} {STANDARD} SELECT * FROM per_cluster",
    "analyze_cluster_logs": f"""WITH {EVENTS.replace('contents AS (', 'contents_all AS (', 1)},
        contents AS (SELECT * FROM contents_all QUALIFY row_number() OVER (PARTITION BY cluster_id
          ORDER BY {ANALYSIS_RANK}, size DESC, last_modified DESC, file_path) <= 3),
        {ranked_chunks('worker')} {STANDARD}
        SELECT p.* EXCLUDE (chunk_count), (SELECT count(*) FROM contents c WHERE c.cluster_id = p.cluster_id) AS files_analyzed,
               'worker' AS search_pattern, 'standard' AS analysis_method FROM per_cluster p""",
    "analyze_iterative": f"""WITH {EVENTS}, {rounds(ITERATIVE_TOKENS)}
        SELECT r.cluster_id, r.total_iterations, coalesce(e.errors, '') AS errors, coalesce(a.category_totals, '') AS category_totals, g.chunks
        FROM (SELECT cluster_id, count(*) AS total_iterations FROM ran GROUP BY ALL) r
        LEFT JOIN (SELECT cluster_id, string_agg(category || '=' || frequency || '=' || distinct_chunks || '=' || frequency_total
                     || '=' || severity, ',' ORDER BY o) AS errors
                   FROM ordered JOIN totals USING (cluster_id, category) GROUP BY ALL) e USING (cluster_id)
        LEFT JOIN (SELECT cluster_id, string_agg(category || '=' || frequency_total, ',' ORDER BY place) AS category_totals
                   FROM (SELECT DISTINCT cluster_id, category, frequency_total, place FROM round_totals) GROUP BY ALL) a USING (cluster_id)
        JOIN (SELECT cluster_id, string_agg(iteration || '#' || file_path || '#' || chunk_no, ',' ORDER BY o) AS chunks
              FROM gathered WHERE o <= 15 GROUP BY ALL) g USING (cluster_id)""",
    "iteration_breakdown": f"""WITH {EVENTS}, {rounds(ITERATIVE_TOKENS)}
        SELECT cluster_id, iteration, patterns_searched, errors_found, chunks_analyzed,
               round(CAST(token_usage AS DOUBLE), 6) AS token_usage, coalesce(errors_total, 0) AS errors_total,
               coalesce(frequency_total, 0) AS frequency_total
        FROM ran JOIN searched USING (iteration) LEFT JOIN (
          SELECT cluster_id, iteration, count(*) AS errors_total, CAST(sum(frequency_total) AS BIGINT) AS frequency_total
          FROM round_totals GROUP BY ALL) USING (cluster_id, iteration)""",
    "iterative_report": f"""WITH {EVENTS}, {rounds(100000)} {ITERATIVE} SELECT *,
        round(len(regexp_extract_all(optimized_content, '{WORD}')) * 1.3e0, 6) AS token_estimate FROM report""",
    "token_estimate": f"""WITH {DOCUMENTS} SELECT file_path,
        round(len(regexp_extract_all(content, '{WORD}')) * 1.3e0, 6) AS token_estimate FROM contents""",
    "token_truncate": f"""WITH {DOCUMENTS}, w AS (SELECT *, regexp_extract_all(content, '{WORD}') AS w FROM contents)
        SELECT file_path, CASE WHEN len(w) <= {int(TOKENS / 1.3)} THEN content ELSE array_to_string(w[1:{int(TOKENS / 1.3)}], ' ')
          || {NL} || {NL} || '... (Content truncated to stay within {TOKENS} token limit)' END AS content FROM w""",
    "jobs_search": f"""WITH {JOBS} SELECT job_id, job_name, '1995-01-01 00:00:00' AS created_time, creator_user_name
        FROM jobs WHERE {NAMED}""",
    "job_runs": f"WITH {JOBS}, {RUNS}, {latest(24 * 365, 3)} SELECT {RUN_COLUMNS} FROM latest",
    "job_runs_week": f"WITH {JOBS}, {RUNS}, {latest(24 * 7, 50)} SELECT {RUN_COLUMNS} FROM latest",
    "run_details": f"""WITH {RUNS} SELECT r.run_id, job_id, life_cycle_state, task_key, t.cluster_id AS task_cluster_id,
        task_result, substr(CAST(task_start AS VARCHAR), 1, 19) AS task_start
        FROM runs r LEFT JOIN tasks t ON r.run_id = t.run_id""",
    "failed_runs": f"""WITH {JOBS}, {RUNS}, {latest(tables.LOOK_BACK_HOURS, 20)}
        SELECT {RUN_COLUMNS}, job_name FROM latest WHERE coalesce({FAILED}, false)""",
    "failed_runs_by_name": f"""WITH {JOBS}, {RUNS}, {latest(24 * 365, 2, NAMED)}
        SELECT {RUN_COLUMNS}, job_name FROM latest WHERE coalesce({FAILED}, false)""",
    "cluster_log_info": """SELECT 'c' || s_suppkey AS cluster_id, s_name AS cluster_name, '4.1' AS spark_version,
        'RUNNING' AS state, CASE WHEN s_suppkey % 2 = 0 THEN 'us-west-2' END AS region,
        CASE WHEN s_suppkey % 2 = 0 THEN 's3://logs/jobs/c' || s_suppkey END AS log_path FROM supplier""",
    "cluster_ids_for_job": f"""WITH {JOBS}, {RUNS}, picked AS (
          SELECT r.* FROM runs r JOIN jobs USING (job_id) WHERE {NAMED}
            AND start_time BETWEEN TIMESTAMP '2001-01-01 00:00:00' AND TIMESTAMP '{tables.RUNS_AS_OF}'
          QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC, run_id DESC) <= 50)
        SELECT cluster_id FROM picked WHERE cluster_id IS NOT NULL
        UNION SELECT t.cluster_id FROM tasks t SEMI JOIN picked USING (run_id)""",
    "job_timeline": f"""WITH {JOBS}, {RUNS}, {latest(24 * 365, 20, NAMED)}
        SELECT job_name, run_id, cluster_id, result_state,
               concat_ws(' to ', substr(CAST(start_time AS VARCHAR), 1, 19), substr(CAST(end_time AS VARCHAR), 1, 19)) AS time_range,
               execution_duration AS execution_duration_ms, execution_duration / 1000 AS duration_seconds,
               epoch_ms(start_time) AS start_ms FROM latest""",
    "failure_diagnosis": f"""WITH {AFFECTED}, {LEVELS} {FINDINGS}
        SELECT f.run_id, f.job_id, f.job_name, substr(CAST(f.start_time AS VARCHAR), 1, 19) AS start_time, f.result_state,
               f.life_cycle_state, u.cluster_id, x.category, x.severity, x."count", x.critical_total, x.high_total, x.examples, a.recommendation
        FROM used u JOIN failed f USING (run_id) JOIN findings x ON x.cluster_id = u.cluster_id
        LEFT JOIN {ADVICE} ON a.category = x.category""",
    "common_failure_patterns": f"""WITH {AFFECTED}, {SEARCH} SELECT category, pattern, count(*) AS matches,
        count(DISTINCT file_path) AS files FROM found GROUP BY ALL""",
    "json_results": f"""WITH {JOBS} SELECT job_id, '{{"job_id":' || job_id || ',"job_name":"' || job_name || '"}}' AS json
        FROM jobs WHERE {NAMED}""",
    "empty_messages": f"""WITH {EVENTS}, {matches(pattern_rows(cat.QUICK_CATALOG))}, {capped(10)}
        SELECT c.cluster_id, coalesce(CAST(n AS VARCHAR), 'No critical errors found in cluster: ' || c.cluster_id) AS message
        FROM (SELECT DISTINCT cluster_id FROM contents) c
        LEFT JOIN (SELECT cluster_id, count(*) AS n FROM capped GROUP BY ALL) USING (cluster_id)""",
    "stream_error_feed": f"""WITH {DOCUMENTS}, {matches(pattern_rows(tables.DOCUMENT_PATTERNS))} SELECT {MATCH} FROM found""",
    "stream_error_windows": windows(6, 6),
    "stream_error_sliding": windows(24, 12),
    "stream_failed_runs": f"""WITH {JOBS}, {RUNS} SELECT run_id, job_id, job_name FROM runs JOIN jobs USING (job_id)
        WHERE coalesce({FAILED}, false)""",
    "stream_error_sessions": f"""WITH {EVENT_LINES},
        contents AS (SELECT cluster_id, file_path, file_path AS file_name, ts AS last_modified, 'x' AS log_type, line AS content
                     FROM lines), {SEARCH},
        e AS (SELECT cluster_id, CAST("timestamp" AS TIMESTAMP) AS ts, count(*) AS n FROM found
              WHERE "timestamp" IS NOT NULL GROUP BY ALL),
        marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY cluster_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY cluster_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked),
        bursts AS (SELECT cluster_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, CAST(sum(n) AS BIGINT) AS errors FROM numbered GROUP BY cluster_id, s)
        SELECT cluster_id, substr(CAST(a AS VARCHAR), 1, 19) AS burst_start, substr(CAST(b AS VARCHAR), 1, 19) AS burst_end, errors
        FROM bursts""",
}

_WRITTEN = f"""{EVENTS}, written AS (
  SELECT cluster_id, replace(substr(file_path, length(cluster_id) + 2), '/', '_') AS file_name, content || {NL} AS content
  FROM contents)"""
_FILE_CONTENTS = f"""WITH {_WRITTEN} SELECT cluster_id, file_name, {log_type('file_name')} AS log_type,
  strlen(content) AS bytes, len(string_split(content, {NL})) AS pieces, md5(content) AS digest FROM written"""
ORACLES["file_contents_plain"] = _FILE_CONTENTS
ORACLES["file_contents_gzip"] = _FILE_CONTENTS
ORACLES["file_lines"] = f"""WITH {_WRITTEN}, ls AS (SELECT cluster_id, file_name, string_split(content, {NL}) AS l FROM written),
  n AS (SELECT cluster_id, file_name, l[1:len(l) - 1] AS l FROM ls)
  SELECT cluster_id, file_name, generate_subscripts(l, 1) AS line_number, unnest(l) AS line FROM n"""
ORACLES["file_rejects"] = f"""WITH {_WRITTEN} SELECT cluster_id, 'too_large' AS reason, count(*) AS files,
  CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM written WHERE strlen(content) > 700 GROUP BY ALL"""

_OVERSIZE = f"""WITH contents AS (WITH {_WRITTEN}
  SELECT cluster_id, cluster_id || '/' || file_name AS file_path, file_name, strlen(content) AS size,
         TIMESTAMP '2024-01-01 00:00:00' AS last_modified, {log_type('file_name')} AS log_type, content
  FROM written WHERE strlen(content) > 700)"""
ORACLES["file_oversize_matches"] = f"""{_OVERSIZE}, {SEARCH}
  SELECT cluster_id, file, category, pattern_idx, pattern, matched_text, line, line_number, context, "timestamp",
         position, severity FROM found"""
ORACLES["file_oversize_chunks"] = f"""{_OVERSIZE}, {chunks(LINES)} {scored('worker handled')}
  SELECT cluster_id, file_name, chunk_no, content, s12 AS priority_score, i12 AS error_indicators FROM score"""

_TABLE_PATTERNS = f"""pats AS (
  SELECT CAST(NULL AS INTEGER) AS level, 'benchmark' AS category, CAST(item_id AS INTEGER) AS pattern_idx,
         array_to_string(regexp_extract_all(text, '[^\\s\\[\\](){{}}.*+?^$|\\\\,;:!-]+')[1:3], '\\s+') AS pattern
  FROM benchmark WHERE regexp_matches(text, '[^\\s\\[\\](){{}}.*+?^$|\\\\,;:!-]')
  UNION ALL {values(pattern_rows(tables.DOCUMENT_PATTERNS))})"""
_TABLE_MATCHES = matches([(None, "", 0, "")])
ORACLES["custom_patterns_table"] = (
    f"WITH {DOCUMENTS}, {_TABLE_PATTERNS}, {_TABLE_MATCHES[_TABLE_MATCHES.index('raw AS'):]} SELECT {MATCH} FROM found")
ORACLES["custom_patterns_rejected"] = """SELECT 'broken' AS category, CAST(n_nationkey AS INTEGER) AS pattern_idx,
  '[' || lower(n_name) AS pattern, true AS has_reason FROM nation"""
ORACLES["search_leveled_staged"] = ORACLES["search_leveled"]
ORACLES["error_bursts"] = ORACLES["stream_error_sessions"]
ORACLES["runs_from_export"] = f"WITH {RUNS} SELECT {RUN_COLUMNS} FROM runs"
ORACLES["tasks_from_export"] = f"""WITH {RUNS} SELECT run_id, task_key, t.cluster_id, task_result,
  substr(CAST(task_start AS VARCHAR), 1, 19) AS task_start FROM runs LEFT JOIN tasks t USING (run_id)"""
ORACLES["rejected_records"] = """SELECT 'not_json' AS reason, count(*) * 2 AS records,
  CAST(sum(length('{"run_id": ' || c_custkey || ', "job_id": "' || c_name || '"}')
           + length('{"run_id": ' || c_custkey || ', ')) AS BIGINT) AS characters FROM customer
  UNION ALL SELECT 'no_job_id', count(*),
  CAST(sum(length('{"run_id":' || (c_custkey + 1000000000) || ',"run_name":"' || c_name || '"}')) AS BIGINT) FROM customer"""
# the stream looks at all runs, not at the newest of every job
ORACLES["stream_failure_diagnosis"] = ORACLES["failure_diagnosis"].replace("QUALIFY rn <= 20", "")
ORACLES["file_contents_crlf"] = f"WITH {_WRITTEN} SELECT cluster_id, file_name, md5(content) AS digest FROM written"
ORACLES["file_not_utf8"] = f"""WITH {EVENTS} SELECT cluster_id,
  CASE WHEN file_name = 'stdout' THEN 'not_utf8' ELSE 'read' END AS outcome, count(*) AS files FROM contents GROUP BY ALL"""


def line_templates(found: str) -> str:
    """CTEs from ``contents`` and the matches ``found`` to a query of the templates of the lines between them."""
    line = "line"
    for pattern, name in templates.MASKS:
        line = f"regexp_replace({line}, {q(pattern)}, {q(name)}, 'g')"
    levels = []
    for k in range(templates.DEPTH):
        word = f"t[{k + 1}]"
        levels.append(f"""
b{k} AS (SELECT node FROM p{k} WHERE {word} IS NOT NULL GROUP BY node HAVING count(DISTINCT {word}) > {templates.WIDE}),
p{k + 1} AS (SELECT p.masked, p.t, CASE WHEN {word} IS NULL THEN p.node ELSE list_append(p.node,
  CASE WHEN b.node IS NULL THEN {word} ELSE {q(templates.ANY)} END) END AS node FROM p{k} p LEFT JOIN b{k} b ON b.node = p.node)""")
    return f"""{found},
touched AS (SELECT DISTINCT file_path, unnest(range(ln, ln + breaks + 1)) AS line_number FROM lined),
every AS (SELECT cluster_id, file_path, generate_subscripts(string_split(content, {NL}), 1) AS line_number,
                 unnest(string_split(content, {NL})) AS line FROM contents),
left_over AS (SELECT *, trim(regexp_replace({line}, '[ \\t]+', ' ', 'g')) AS masked
              FROM every ANTI JOIN touched USING (file_path, line_number)),
counted AS (SELECT * FROM left_over WHERE masked <> '' AND regexp_matches(line, '[^\\s\\x0b]')),
p0 AS (SELECT DISTINCT masked, string_split(masked, ' ') AS t, [CAST(len(string_split(masked, ' ')) AS VARCHAR)] AS node FROM counted),{",".join(levels)},
leaves AS (SELECT * FROM p{templates.DEPTH}),
tails AS (SELECT node, list(CASE WHEN low = high THEN low ELSE {q(templates.ANY)} END ORDER BY place) AS tail
  FROM (SELECT node, place, min(word) AS low, max(word) AS high
        FROM (SELECT node, generate_subscripts(t, 1) AS place, unnest(t) AS word FROM leaves)
        WHERE place > {templates.DEPTH} GROUP BY ALL) GROUP BY node)
SELECT array_to_string(list_concat(s.node[2:], coalesce(tail, [])), ' ') AS template, len(s.node) - 1 + len(coalesce(tail, [])) AS words,
       lines, clusters, distinct_lines, e.file_path AS example_file, e.line_number AS example_number, e.line AS example
FROM (SELECT node, count(*) AS lines, count(DISTINCT cluster_id) AS clusters, count(DISTINCT masked) AS distinct_lines,
             min({{'file_path': file_path, 'line_number': line_number, 'line': line}}) AS e
      FROM counted JOIN leaves USING (masked) GROUP BY node) s LEFT JOIN tails USING (node)"""


ORACLES["failure_templates"] = f"WITH {AFFECTED}, {line_templates(SEARCH)}"
ORACLES["document_templates"] = f"WITH {DOCUMENTS}, {line_templates(matches(pattern_rows(tables.DOCUMENT_PATTERNS)))}"
_FED = f"""WITH fed AS (WITH {_WRITTEN}
  SELECT *, strlen(content) + CASE WHEN ends_with(file_name, 'driver_stdout') THEN 1 ELSE 0 END AS size,
         CASE WHEN strlen(content) + CASE WHEN ends_with(file_name, 'driver_stdout') THEN 1 ELSE 0 END > 700 THEN 'too_large'
              WHEN ends_with(file_name, 'driver_stdout') THEN 'not_utf8' ELSE 'read' END AS outcome FROM written)"""
ORACLES["stream_file_outcomes"] = f"""{_FED} SELECT cluster_id, outcome, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
  FROM fed GROUP BY ALL"""
ORACLES["stream_file_matches"] = f"""{_FED}, contents AS (
  SELECT cluster_id, cluster_id || '/' || file_name AS file_path, file_name, size,
         TIMESTAMP '2024-01-01 00:00:00' AS last_modified, {log_type('file_name')} AS log_type, content
  FROM fed WHERE outcome = 'read'), {SEARCH}
  SELECT cluster_id, file, category, pattern_idx, pattern, matched_text, line, line_number, context, "timestamp",
         position, severity FROM found"""
