"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from runscope.llm.sharding import SHARDS, SLOTS, lookup_table

_OWNERS = ",".join(map(str, lookup_table()))

QUALITY = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT rid, i, words[i:i+4] AS g FROM (
    SELECT row_number() OVER () AS rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), numbered AS (SELECT row_number() OVER () AS rid, * FROM w),
g AS (
  SELECT rid, i, words[i:i+4] AS g FROM (
    SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM numbered WHERE len(words) >= 5)
), found AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM found, range(0, 5) AS r(k) GROUP BY rid
), base AS (
  SELECT n.doc_id, n.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(text, chr(10)),
                                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM numbered n LEFT JOIN covered c USING (rid)
), failed AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM failed WHERE source IS NOT NULL GROUP BY source
), prior AS (
  SELECT (sum(f) + 1) / (sum(n) + 2) AS m, coalesce(var_pop(f / n), 0) AS v, count(*) AS hosts FROM hosts
), strength AS (
  SELECT m, CASE WHEN hosts < 2 THEN 1.0 WHEN v > 1e-9 THEN greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM prior
), verdicts AS (
  SELECT source, (a / t - 2 * sqrt(a * (t - a) / (t * t * (t + 1))) > 0.5) AS rejected
  FROM (SELECT source, f + k * m AS a, n + k AS t FROM hosts, strength)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT coalesce(rejected, FALSE)) AS kept
FROM failed LEFT JOIN verdicts USING (source)
"""
QUALITY = QUALITY[:QUALITY.index("), grams AS")] + QUALITY[QUALITY.index("), numbered AS"):]

URLS = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), hit AS (
  SELECT doc_id AS page_id, count(*) AS n, sum(1 - quality) AS bad FROM labels
  WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), hosts0 AS (
  SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM parts LEFT JOIN hit USING (page_id) GROUP BY host
), named AS (
  SELECT *, list_filter(string_split(name, '.'), lambda x: x <> '') AS p,
         (regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[')) AS numeric
  FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM hosts0)
), wide AS (
  SELECT *, CASE WHEN array_to_string(p[-2:], '.') IN ('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za',
    'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'net.au', 'org.au', 'org.uk')
    THEN 2 ELSE 1 END AS w FROM named
), hosts AS (
  SELECT host, n, bad,
         CASE WHEN numeric THEN '' WHEN w = 2 THEN array_to_string(p[-2:], '.') ELSE coalesce(array_to_string(p[-1:], '.'), '') END AS suffix,
         CASE WHEN numeric THEN name WHEN w = 2 THEN array_to_string(p[-3:], '.') ELSE coalesce(array_to_string(p[-2:], '.'), '') END AS domain
  FROM wide
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
top AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean0 FROM suffixes),
k1 AS (SELECT sum(n) t, sum(bad) b, count(*) g, sum(bad * bad / n) s FROM suffixes WHERE n > 0),
k2 AS (SELECT sum(n) t, sum(bad) b, count(*) g, sum(bad * bad / n) s FROM domains WHERE n > 0),
k3 AS (SELECT sum(n) t, sum(bad) b, count(*) g, sum(bad * bad / n) s FROM hosts WHERE n > 0),
strengths AS (
  SELECT level, coalesce(CASE WHEN b = 0 OR b = t THEN 100.0 WHEN x <= 0.001 THEN 1000.0 WHEN x >= 0.5 THEN 1.0
                              ELSE (1 - x) / x END, 1.0)::DOUBLE AS k
  FROM (SELECT level, t, b, ((s - t * (b / t) * (b / t)) / t - (b / t) * (1 - b / t) * g / t) / ((b / t) * (1 - b / t)) AS x
        FROM (SELECT 1 AS level, * FROM k1 UNION ALL SELECT 2, * FROM k2 UNION ALL SELECT 3, * FROM k3))
), k AS (
  SELECT max(k) FILTER (level = 1) AS k1, max(k) FILTER (level = 2) AS k2, max(k) FILTER (level = 3) AS k3 FROM strengths
), m1 AS (SELECT suffix, (bad + k1 * mean0) / (n + k1) AS mean1 FROM suffixes, top, k),
m2 AS (SELECT domain, suffix, (bad + k2 * mean1) / (n + k2) AS mean2 FROM domains JOIN m1 USING (suffix), k),
judged AS (
  SELECT host, n, bad, (a / t - 2 * sqrt(a * (t - a) / (t * t * (t + 1))) > 0.5) AS blocked
  FROM (SELECT host, n, bad, bad + k3 * mean2 AS a, n + k3 AS t FROM hosts JOIN m2 USING (domain, suffix), k)
), ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
                 WHEN 'net/' THEN 'block' ELSE CASE WHEN blocked THEN 'block' ELSE 'allow' END END AS verdict,
       CAST(n AS BIGINT) AS host_labelled, CAST(bad AS BIGINT) AS host_bad
FROM ruled JOIN judged USING (host)
"""

NEAREST = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e) / (q.l * r.l) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, r.e) / (q.l * r.l) DESC, r.vec_id) AS rank
  FROM n q JOIN n r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 50 = 0)
WHERE rank <= 5
"""

SHARDING = f"""
WITH owners AS (SELECT [{_OWNERS}] AS o)
SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(CAST(o[slot + 1] AS VARCHAR), 2, '0') AS shard
FROM (SELECT doc_id, source, n_chars,
             ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), source, '')), 1, 15))::BIGINT % {SLOTS} AS slot
      FROM documents), owners
"""
assert len(SHARDS) == 64

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS g FROM (
    SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE c >= 0.8 * (x.n + y.n - c)
), reach AS (
  SELECT r AS a, r AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), classes AS (SELECT reach.a AS r, min(w.doc_id) AS class_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a)
SELECT doc_id, class_id, coalesce(l.n, 0) AS n_links FROM w JOIN classes USING (r)
LEFT JOIN (SELECT a AS r, count(*) AS n FROM links GROUP BY a) l USING (r)
"""

TRIE = """
WITH RECURSIVE crc AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''),
      lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
), said AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS who, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), digests AS (
  SELECT *, substr(sha256(CAST(strlen(who) AS VARCHAR) || ':' || who || text), 1, 32) AS digest,
         CAST(strlen(text) AS BIGINT) AS bytes FROM said
), own AS (
  SELECT c, list(struct_pack(digest, bytes) ORDER BY turn NULLS FIRST, digest) AS t FROM digests GROUP BY c
), rebuilt AS (
  SELECT own.c, list_concat(coalesce(b.t, [])[1:h], own.t[h + 1:]) AS t
  FROM own JOIN crc USING (c) LEFT JOIN own b ON b.c = own.c - own.c % 5
), walk AS (
  SELECT c, t, CAST(0 AS BIGINT) AS depth, '' AS path, CAST(NULL AS VARCHAR) AS above, CAST(0 AS BIGINT) AS bytes FROM rebuilt
  UNION ALL
  SELECT c, t, depth + 1, sha256(path || t[depth + 1].digest), path, t[depth + 1].bytes FROM walk WHERE depth < len(t)
), nodes AS (
  SELECT depth, path, any_value(above) AS above, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(t) = depth), '')) AS ends_sha256
  FROM walk GROUP BY depth, path
), kids AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (
  SELECT path AS top, path, above, depth FROM nodes
  UNION ALL
  SELECT below.above, n.path, parent.above, parent.depth FROM below JOIN nodes n ON n.path = below.path
  JOIN nodes parent ON parent.path = below.above
), sums AS (
  SELECT top AS path, sum((n.n_convs - 1) * n.bytes) AS saved_tokens, count_if(k.path IS NULL) AS n_leaves
  FROM below JOIN nodes n ON n.path = below.path LEFT JOIN kids k ON k.path = n.path GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.above LEFT JOIN kids ON kids.path = n.path JOIN sums ON sums.path = n.path
"""


def _codes(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Integer k-means, one set of CTEs a round; doubles are exact at the size of these components."""
    steps = [f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT row_number() OVER () AS r, vec_id, label, v, CAST(len(v) // {parts} AS BIGINT) AS w FROM kept
), x AS MATERIALIZED (
  SELECT r, vec_id, label, k, v[k * w + 1:(k + 1) * w] AS p FROM part, range({parts}) AS t(k)
), b0 AS MATERIALIZED (
  SELECT k, e, p FROM (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY vec_id NULLS LAST) - 1 AS e FROM x)
  WHERE e < {entries}
)"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, k, arg_min(e, d * {entries} + e) AS e, CAST(min(d) AS BIGINT) AS d FROM (
    SELECT r, x.k, e, CAST(list_inner_product(x.p, x.p) + list_inner_product(b.p, b.p)
                           - 2 * list_inner_product(x.p, b.p) AS BIGINT) AS d
    FROM x JOIN b{n} b ON b.k = x.k) GROUP BY r, k
)""")
        if n < rounds:
            steps.append(f"""b{n + 1} AS MATERIALIZED (
  SELECT k, e, coalesce(m.p, b.p) AS p FROM b{n} b LEFT JOIN (
    SELECT k, e, list(floor(s / c) ORDER BY i) AS p FROM (
      SELECT k, e, i, sum(p[i]) AS s, count(*) AS c FROM x JOIN a{n} USING (r, k), range(1, len(p) + 1) AS t(i)
      GROUP BY k, e, i) GROUP BY k, e) m USING (k, e)
)""")
    n = rounds
    steps.append(f"""done AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{n} GROUP BY r
), whole AS (
  SELECT sha256(string_agg(array_to_string(list_transform(p, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY k, e))
         AS codebooks_sha256 FROM b{n}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM part JOIN done USING (r), whole
""")
    return ", ".join(steps)


CODES = _codes()

ORACLES = {
    "op2_url_reputation": URLS,
    "op4_nearest_neighbours": NEAREST,
    "op5_sharding": SHARDING,
    "op8_jaccard_join": JACCARD,
    "op10_quality_rules": QUALITY,
    "op11_prefix_trie": TRIE,
    "op13_vector_codes": CODES,
}
