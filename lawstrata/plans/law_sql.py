"""The law queries in SQL, for the side-by-side check."""

_NORM = r"nullif(lower(regexp_replace({0}, '^[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+|[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '', 'g')), '')"


def _id(col: str) -> str:
    return _NORM.format(col)


def _link(col: str) -> str:
    bare = rf"regexp_replace(regexp_replace({col}, '^\s+|\s+$', '', 'g'), '\s*[?#](.|\n)*$', '')"
    full = rf"CASE WHEN lower(trim({col})) LIKE 'javascript:%' THEN NULL WHEN {bare} LIKE '//%' THEN substr({bare}, 3) WHEN {bare} LIKE '/%' THEN 'vanban.example' || {bare} ELSE regexp_replace({bare}, '^[A-Za-z][A-Za-z0-9+.\-]*://', '') END"
    cut = rf"regexp_replace({full}, '/+$', '')"
    return rf"nullif(lower(split_part({cut}, '/', 1)) || substr({cut}, length(split_part({cut}, '/', 1)) + 1), '')"


P3 = f"""
WITH RECURSIVE cur AS (
  SELECT k, arg_max(p, (loaded_at, coalesce(p, ''))) FILTER (WHERE true) AS p0, max(loaded_at) AS top FROM
    (SELECT {_id("chunk_id")} AS k, {_id("parent_chunk_id")} AS p, loaded_at FROM chunk) WHERE k IS NOT NULL GROUP BY k),
node AS (SELECT k, (SELECT max(p) FROM (SELECT {_id("chunk_id")} AS kk, {_id("parent_chunk_id")} AS p, loaded_at FROM chunk) x WHERE x.kk = cur.k AND x.loaded_at = cur.top) AS p FROM cur),
climb(k, cur, steps, seen, done) AS (
  SELECT k, k, 0, [k], false FROM node
  UNION ALL
  SELECT c.k, n.p, c.steps + 1, list_append(c.seen, n.p), (m.k IS NULL OR list_contains(c.seen, n.p))
  FROM climb c JOIN node n ON n.k = c.cur LEFT JOIN node m ON m.k = n.p
  WHERE NOT c.done AND n.p IS NOT NULL),
ends AS (SELECT * FROM climb c WHERE c.done OR EXISTS (SELECT 1 FROM node n WHERE n.k = c.cur AND n.p IS NULL)),
judged AS (SELECT k, cur, steps, seen, list_contains(seen[:len(seen) - 1], cur) AS ringed, list_position(seen, cur) - 1 AS first FROM ends)
SELECT k AS chunk_id,
  CASE WHEN ringed THEN list_min(seen[first + 1:]) ELSE cur END AS root_id,
  CAST(CASE WHEN ringed THEN first ELSE steps END AS INTEGER) AS node_depth,
  CASE WHEN NOT ringed THEN 'tree' WHEN first = 0 THEN 'cycle' ELSE 'below_cycle' END AS node_state
FROM judged
"""

_CLIMB, _STATES = P3.split("SELECT k AS chunk_id")
P3_PATHS = f"""{_CLIMB.rstrip()},
chain AS (SELECT k, CASE WHEN NOT ringed THEN seen WHEN first = 0 THEN [k] ELSE seen[1:first + 1] END AS c FROM judged),
below AS (SELECT x, count(*) AS n FROM (SELECT unnest(c[2:]) AS x FROM chain) GROUP BY x),
found AS (SELECT k AS chunk_id{_STATES}),
down AS (SELECT k, list_reverse(CASE WHEN node.k IS NULL THEN c[:len(c) - 1] ELSE c END) AS d FROM chain c0 LEFT JOIN (SELECT k AS top FROM node) t ON t.top = c0.c[len(c0.c)] LEFT JOIN node ON node.k = t.top),
placed AS (SELECT chunk_id, row_number() OVER (PARTITION BY CASE WHEN node_state = 'tree' THEN 'tree ' || d[1] ELSE 'ring ' || root_id END ORDER BY d) - 1 AS pre FROM found JOIN down ON down.k = chunk_id)
SELECT found.*, array_to_string(list_reverse(c), '/') AS path, coalesce(n, 0) AS n_descendants, pre, pre + coalesce(n, 0) AS last FROM found JOIN chain ON chain.k = chunk_id JOIN placed ON placed.chunk_id = found.chunk_id LEFT JOIN below ON below.x = found.chunk_id
""".replace("SELECT k, list_reverse(CASE", "SELECT c0.k, list_reverse(CASE")

P3_DESCENDANTS = f"""{_CLIMB.rstrip()},
chain AS (SELECT k, CASE WHEN NOT ringed THEN seen WHEN first = 0 THEN [k] ELSE seen[1:first + 1] END AS c FROM judged),
pairs AS (SELECT unnest(c[2:]) AS chunk_id, k AS descendant_id, unnest(range(1, len(c))) AS distance FROM chain)
SELECT chunk_id, descendant_id, distance::INTEGER AS distance FROM pairs WHERE chunk_id IN (SELECT k FROM node)
"""

P3_RINGS = f"""{_CLIMB.rstrip()},
rings AS (SELECT judged.k, list_min(seen) AS root_id, len(seen) - 1 AS n, node.p FROM judged JOIN node ON node.k = judged.k WHERE ringed AND first = 0)
SELECT k AS chunk_id, p AS parent_id, root_id, n AS ring_size, k = root_id AS back_edge FROM rings
"""

P6 = f"""
WITH c AS (SELECT {_id("chunk_id")} AS id, * FROM chunk),
cc AS (SELECT *, min(loaded_at) OVER (PARTITION BY id) AS first, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, amends DESC) AS rn FROM c WHERE id IS NOT NULL),
a AS (SELECT {_id("amend_key")} AS id, * FROM amendment),
aa AS (SELECT *, min(loaded_at) OVER (PARTITION BY id) AS first, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, is_deleted DESC) AS rn FROM a WHERE id IS NOT NULL),
live AS (SELECT * FROM aa WHERE rn = 1 AND NOT coalesce(is_deleted, false)),
el AS (SELECT DISTINCT chunk_id, doc_id, first, crawled_at, unnest(amends) AS v FROM cc WHERE rn = 1),
refs AS (
  SELECT 'amendment' AS rel, {_id("doc_id")} || chr(10) || {_id("v")} AS k, first, 'chunk.amends' AS ref_field, chunk_id AS row_key, v AS ref_value, crawled_at FROM el
  UNION ALL SELECT 'mark', {_id("doc_id")} || chr(10) || {_id("tip_id")}, first, 'amendment.tip_id', amend_key, tip_id, crawled_at FROM live
  UNION ALL SELECT 'page', {_link("amended_link")}, first, 'amendment.amended_link', amend_key, amended_link, crawled_at FROM live),
t0 AS (
  SELECT 'amendment' AS rel, {_id("doc_id")} || chr(10) || {_id("tip_id")} AS k, loaded_at, coalesce(is_deleted, false) AS d FROM amendment
  UNION ALL SELECT 'mark', {_id("doc_id")} || chr(10) || {_id("v")}, loaded_at, false FROM (SELECT doc_id, loaded_at, unnest(amends) AS v FROM chunk)
  UNION ALL SELECT 'page', {_link("source_url")}, loaded_at, coalesce(is_deleted, false) FROM law_document
  UNION ALL SELECT 'page', {_link("source_url")}, loaded_at, false FROM base_law),
t AS (SELECT rel, k, min(loaded_at) AS first, arg_max(d, (loaded_at, d)) AS deleted FROM t0 WHERE k IS NOT NULL GROUP BY rel, k)
SELECT ref_field, row_key, ref_value,
  CASE WHEN t.k IS NULL THEN 'missing' WHEN t.deleted THEN 'deleted' ELSE 'late' END AS ref_status,
  strftime(crawled_at, '%Y-%m') AS ref_month
FROM refs LEFT JOIN t ON t.rel = refs.rel AND t.k = refs.k
WHERE refs.k IS NOT NULL AND (t.k IS NULL OR t.deleted OR t.first > refs.first)
"""


# ---- problem 2: shapes told apart on JSON values ----------------------------------------------


def _open(x: str) -> str:
    """What a text of whole JSON holds."""
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' AND left(ltrim({x}->>'$'), 1) IN ('{{', '[') AND json_valid({x}->>'$') THEN ({x}->>'$')::JSON ELSE {x} END)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _name(x: str) -> str:
    return rf"regexp_replace({_strip(x)}, '\s*:$', '')"


def _blank(x: str) -> str:
    return f"(json_type({x}) = 'NULL' OR (json_type({x}) = 'VARCHAR' AND trim({x}->>'$', chr(32) || chr(9) || chr(10) || chr(13)) = '') OR (json_type({x}) IN ('OBJECT', 'ARRAY') AND {x}::VARCHAR IN ('{{}}', '[]')))"


P2 = f"""
WITH RECURSIVE
rec AS (SELECT record_id, body::JSON AS j FROM raw_record WHERE json_valid(body)),
meta0 AS (SELECT record_id, {_open("j->'metadata'")} AS j FROM rec WHERE json_type(j) = 'OBJECT'),
meta1 AS (
  SELECT record_id, e.key AS k, e.value AS v FROM (SELECT record_id, unnest(map_entries(j::MAP(VARCHAR, JSON))) AS e FROM meta0 WHERE json_type(j) = 'OBJECT')
  UNION ALL
  SELECT record_id, x->>0, x->1 FROM (SELECT record_id, unnest(j::JSON[]) AS x FROM meta0 WHERE json_type(j) = 'ARRAY') WHERE json_type(x) = 'ARRAY' AND json_array_length(x) = 2
  UNION ALL
  SELECT record_id, x->>'key', x->'value' FROM (SELECT record_id, unnest(j::JSON[]) AS x FROM meta0 WHERE json_type(j) = 'ARRAY') WHERE json_type(x) = 'OBJECT' AND list_sort(json_keys(x)) = ['key', 'value']
  UNION ALL
  SELECT record_id, e.key, e.value FROM (SELECT record_id, unnest(map_entries(x::MAP(VARCHAR, JSON))) AS e FROM (SELECT record_id, unnest(j::JSON[]) AS x FROM meta0 WHERE json_type(j) = 'ARRAY') WHERE json_type(x) = 'OBJECT' AND list_sort(json_keys(x)) <> ['key', 'value'])),
meta AS (SELECT record_id, {_name("k")} AS k, {_open("v")} AS v FROM meta1),
fields AS (SELECT record_id, k, {_name("e.key")} AS f FROM (SELECT record_id, k, unnest(map_entries(v::MAP(VARCHAR, JSON))) AS e FROM meta WHERE json_type(v) = 'OBJECT') WHERE NOT {_blank("e.value")}),
entries AS (
  SELECT record_id, k FROM meta WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY') AND NOT {_blank("v")}
  UNION SELECT record_id, k FROM fields
  UNION SELECT record_id, k FROM (SELECT record_id, k, unnest(v::JSON[]) AS x FROM meta WHERE json_type(v) = 'ARRAY') WHERE NOT {_blank("x")}),
walk(record_id, kind, j, name, tip, own, is_rec) AS (
  SELECT record_id, 'search', j, '', '', '', false FROM rec
  UNION ALL
  SELECT record_id, kind, j, name, tip, coalesce(nullif({_strip("j->>'tip_id'")}, ''), {_strip("name")}),
    kind = 'hold' AND json_type(j) = 'OBJECT' AND (name <> '' OR len(list_intersect(json_keys(j), ['tip_id', 'bm_title', 'amended_content', 'original_content', 'anchor_text', 'amended_link', 'links', 'phu_luc', 'amendments', 'children'])) > 0)
  FROM (
    SELECT record_id, CASE WHEN kind = 'hold' AND NOT is_rec THEN 'hold' WHEN c.key IN ('amendments', 'children') THEN 'hold' ELSE 'search' END AS kind, {_open("c.value")} AS j,
      CASE WHEN kind = 'hold' AND NOT is_rec THEN c.key ELSE '' END AS name, CASE WHEN is_rec THEN own ELSE tip END AS tip
    FROM (SELECT *, unnest(map_entries(j::MAP(VARCHAR, JSON))) AS c FROM walk WHERE json_type(j) = 'OBJECT') WHERE c.key <> 'metadata' AND NOT (is_rec AND c.key = 'bm_title')
    UNION ALL
    SELECT record_id, kind, {_open("x")}, name, tip FROM (SELECT *, unnest(j::JSON[]) AS x FROM walk WHERE json_type(j) = 'ARRAY'))
  WHERE json_type(j) IN ('OBJECT', 'ARRAY')),
titles AS (
  SELECT record_id, own, {_strip("t->>'$'")} AS title FROM (SELECT record_id, own, CASE WHEN json_type(b) = 'ARRAY' THEN unnest(b::JSON[]) END AS t FROM (SELECT record_id, own, {_open("j->'bm_title'")} AS b FROM walk WHERE is_rec) WHERE json_type(b) = 'ARRAY')
  UNION ALL
  SELECT record_id, own, {_strip("b->>'$'")} FROM (SELECT record_id, own, {_open("j->'bm_title'")} AS b FROM walk WHERE is_rec) WHERE json_type(b) NOT IN ('ARRAY', 'OBJECT', 'NULL'))
SELECT DISTINCT record_id, 'metadata' AS child, '' AS parent_key, k AS child_key FROM entries
UNION SELECT DISTINCT record_id, 'metadata', k, f FROM fields
UNION SELECT DISTINCT record_id, 'amendment', tip, own FROM walk WHERE is_rec AND own <> ''
UNION SELECT DISTINCT record_id, 'bm_title', own, title FROM titles WHERE title <> ''
"""

SQL = {
    "p2_found": P2,
    "p2_metadata": f"SELECT record_id, CASE WHEN parent_key = '' THEN child_key ELSE parent_key END AS entry, CASE WHEN parent_key <> '' THEN child_key END AS field FROM ({P2}) WHERE child = 'metadata'",
    "p2_amendments": f"SELECT record_id, child_key AS tip_id, nullif(parent_key, '') AS within_tip FROM ({P2}) WHERE child = 'amendment'",
    "p2_titles": f"SELECT record_id, nullif(parent_key, '') AS tip_id, child_key AS bm_title FROM ({P2}) WHERE child = 'bm_title'",
    "p3_found": P3,
    "p3_paths": P3_PATHS,
    "p3_descendants": P3_DESCENDANTS,
    "p3_rings": P3_RINGS,
    "p6_found": P6,
    "p6_by_month": f"SELECT ref_field, ref_status, ref_month, count(*) AS n_refs, count(DISTINCT row_key) AS n_rows FROM ({P6}) GROUP BY ALL",
}
