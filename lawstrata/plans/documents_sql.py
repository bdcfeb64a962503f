"""The document queries in SQL, for the side-by-side check; written from the definitions, not from the plans."""

DOCS = "docs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY loaded_at DESC) AS rn FROM law_document) WHERE rn = 1 AND NOT coalesce(is_deleted, false))"
CHUNKS = "cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) AS rn FROM chunk) WHERE rn = 1)"
_SP = r"[\s\x0b\x{85}\x{a0}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def drop(x: str, kind: str) -> str:
    return strip(rf"regexp_replace({x}, '\[\[{kind}:[^\]]+\]\]{_SP}*', '', 'g')")


def tidy(x: str) -> str:
    squeezed = strip(rf"regexp_replace({drop(x, 'ANCHOR')}, '[ \t\x{{a0}}]+', ' ', 'g')")
    return rf"regexp_replace({squeezed}, '\n{{2,}}', chr(10), 'g')"


def plain(x: str) -> str:
    return rf"regexp_replace({x}, '\*([^*]+)\*', '\1', 'g')"


def n_tokens(x: str) -> str:
    return rf"len(list_filter(string_split_regex({x}, '{_SP}+'), lambda w: w <> ''))::INT"


def ids(x: str, kind: str) -> str:
    return rf"regexp_extract_all({x}, '\[\[{kind}:([^\]]+)\]\]', 1)"


def bare(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\[\[.*?\]\]{_SP}*', '', 'g')")


def pieces(x: str, pattern: str) -> str:
    return rf"string_split(regexp_replace({x}, '\n({pattern})', chr(1) || '\1', 'g'), chr(1))"


def point_key(x: str) -> str:
    h = rf"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x}))"
    variant = f"printf('%02x', (('0x' || substr({h}, 17, 2))::INT & 63) | 128)"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '5' || substr({h}, 14, 3), {variant} || substr({h}, 19, 2), substr({h}, 21, 12))"


CLAUSE = r"Khoản\s+\d+|\d+\."
LEAD = r'(?i)^.*?(như sau:|như sau)\s*[“"”]?\s*'
SEGMENTS = rf"""
{DOCS},
s0 AS (SELECT doc_id, list_filter(string_split(regexp_replace(main_content, '(\[\[ANCHOR:[^\]]+\]\])', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS ss FROM docs WHERE main_content IS NOT NULL),
s1 AS (SELECT doc_id, i - 1 AS pos, {plain(strip("ss[i]"))} AS seg FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s0)),
s2 AS (SELECT doc_id, pos::INT AS pos, {tidy("seg")} AS clean, {ids("seg", "ANCHOR")} AS anchors, {ids("seg", "AMENDMENT")} AS amends FROM s1),
s3 AS (SELECT *, {n_tokens("clean")} AS n_tokens, {bare("clean")} AS b FROM s2),
s4 AS (SELECT doc_id, pos, doc_id || '_' || coalesce(anchors[1], 'seg_' || pos) AS seg_id, clean, n_tokens, anchors, amends,
  CASE WHEN regexp_matches(b, '^\*?Phần\s') THEN 'Phần' WHEN regexp_matches(b, '^\*?Chương\s') THEN 'Chương' WHEN regexp_matches(b, '^\*?Mục\s') THEN 'Mục' WHEN regexp_matches(b, '^\*?Điều\s+\d+\.') THEN 'Điều' ELSE 'other' END AS kind
  FROM s3 WHERE clean <> '' AND n_tokens >= 4)
"""
FILL = "last_value(CASE WHEN kind IN ({kinds}) THEN seg_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"


def fill(*kinds: str) -> str:
    return "coalesce(" + FILL.format(kinds=", ".join(f"'{k}'" for k in kinds)) + ", doc_id)"


def packed(items: str, limit: int) -> str:
    """Bin of each item: a fold over the ordered list of (pos, n) of a group."""
    fold = f"list_reduce({items}, lambda a, x: {{'bin': CASE WHEN a.used + x.n > {limit} AND a.used > 0 THEN a.bin + 1 ELSE a.bin END, 'used': CASE WHEN a.used + x.n > {limit} AND a.used > 0 THEN x.n ELSE a.used + x.n END, 'n': 0::BIGINT, 'bins': list_append(a.bins, CASE WHEN a.used + x.n > {limit} AND a.used > 0 THEN a.bin + 1 ELSE a.bin END)}}, {{'bin': 0::BIGINT, 'used': 0::BIGINT, 'n': 0::BIGINT, 'bins': []::BIGINT[]}})"
    return f"({fold}).bins"


def items(order: str) -> str:
    return f"list({{'bin': 0::BIGINT, 'used': 0::BIGINT, 'n': n::BIGINT, 'bins': []::BIGINT[]}} ORDER BY {order})"


PENALTY = r"((?:Phạt tiền|phạt tiền) từ [0-9.]+ đến [0-9.]+ đồng)"
SUBJECT = r"(?:đối với|do|cùng) ((?:người|chủ|cơ quan|cơ sở|đơn vị|tổ chức|trung tâm|đội|ban|bên|hợp tác xã|phòng|trạm|nhà thầu|cán bộ|trưởng ca)[\p{L} ]{0,24}?)(?: (?:xe|thực hiện|phải|không|của|tại)|[,.;]|\z)"
ACTION = r"(?:phải|được) ((?:[\p{Ll}]+ ){1,4}[\p{Ll}]+)(?:[ ,.;]|\z)"
AMENDED, NO_ENTITY = "('Amendment', 'Amendment_Split')", "('Document_Meta', 'Summary', 'Summary_Split', 'Phần', 'Chương', 'Mục', 'Preamble')"
TARGETS = f"""
{CHUNKS},
parents AS (SELECT DISTINCT parent_chunk_id AS p FROM cur WHERE parent_chunk_id IS NOT NULL AND parent_chunk_id <> ''),
targets AS (
  SELECT DISTINCT chunk_id, content AS text FROM cur WHERE chunk_type IN {AMENDED}
  UNION SELECT DISTINCT chunk_id, coalesce(content_embed, content) FROM cur WHERE chunk_type NOT IN {AMENDED} AND chunk_type NOT IN {NO_ENTITY} AND chunk_id NOT IN (SELECT p FROM parents))
"""
ENTITIES = TARGETS + "".join(f", e{k} AS (SELECT DISTINCT chunk_id, '{label}' AS label, {strip('name')} AS name FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '{pattern}', 1)) AS name FROM targets) WHERE {strip('name')} <> '')" for k, (label, pattern) in enumerate({"Subject": SUBJECT, "Action": ACTION, "Penalty": PENALTY}.items())) + ", e AS (SELECT * FROM e0 UNION SELECT * FROM e1 UNION SELECT * FROM e2)"
_CARD = " || chr(10) || ".join(["'Thông tin chung (Metadata) của văn bản pháp luật:'", f"'- Tên văn bản: ' || {plain('coalesce(title, chr(32)[:0])')}", *(f"'- {k}: ' || coalesce(metadata['{k}'], 'Không có thông tin')" for k in ("Loại văn bản", "Nơi ban hành", "Người ký", "Ngày ban hành", "Ngày hiệu lực", "Tình trạng", "Số công báo", "Ngày công báo"))])
KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT query_id, vec_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS cosine FROM q, embeddings)
SELECT query_id, vec_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS rank FROM c
QUALIFY rank <= 6
"""
_WORDS = r"list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"
RERANK = f"""
WITH {DOCS}, {CHUNKS},
h AS (SELECT d.doc_id AS question_id, c.chunk_id AS point_id, {_WORDS.format("d.title")} AS a, {_WORDS.format("c.content")} AS b FROM cur c JOIN docs d ON c.doc_id = d.doc_id WHERE c.content_embed IS NOT NULL),
s AS (SELECT question_id, point_id, CASE WHEN len(a) + len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) ELSE 0.0 END AS rerank_score FROM h)
SELECT question_id, point_id, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, point_id)::INT AS place, rerank_score FROM s
QUALIFY place <= 4
"""
QUESTIONS = "q AS (SELECT doc_id AS question_id, regexp_replace(string_split(text, chr(10))[1], '^Hỏi: ', '') AS question, text AS reply FROM documents WHERE text LIKE 'Hỏi: %')"
_ABS = "CASE WHEN {0} LIKE '/%' THEN 'https://vanban.example' || {0} ELSE {0} END"

SQL = {
    "doc_ids": "SELECT DISTINCT source_url, doc_id, md5(source_url) AS url_md5, substr(md5(source_url), 1, 16) AS computed_id FROM law_document",
    "point_ids": f"SELECT chunk_id, {point_key('chunk_id')} AS point_id FROM (SELECT DISTINCT chunk_id FROM chunk)",
    "token_counts": f"SELECT doc_id, {n_tokens('text')} AS n_tokens FROM documents",
    "text_clean_up": f"SELECT chunk_id, {plain('content')} AS plain, {tidy('content')} AS tidy, {drop('content', 'AMENDMENT')} AS embedded, array_to_string({ids('content', 'ANCHOR')}, ',') AS anchor_ids, array_to_string({ids('content', 'AMENDMENT')}, ',') AS amendment_ids, {bare('content')} AS bare FROM (SELECT DISTINCT chunk_id, content FROM chunk)",
    "text_splits": rf"SELECT doc_id, len({pieces('text', CLAUSE)})::INT AS n_clauses, len({pieces('text', r'[a-zđ][)]')})::INT AS n_points, len(string_split_regex(text, '\n\n+'))::INT AS n_paragraphs, len({pieces('text', r'(?:Chương|Điều|Mục|Khoản)\s')})::INT AS n_wordings FROM documents WHERE text IS NOT NULL",
    "clauses": f"SELECT doc_id, (i - 1)::INT AS pos, c[i] AS clause FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {pieces('text', CLAUSE)} AS c FROM documents WHERE text IS NOT NULL))",
    "new_wordings": rf"SELECT amend_key, {strip('amended_content')} AS wording, {strip(f"regexp_replace({strip(f"regexp_replace(amended_content, '{LEAD}', '')")}, '^[“\"”]', '')")} AS own_wording FROM (SELECT DISTINCT amend_key, amended_content FROM amendment WHERE amended_content IS NOT NULL)",
    "metadata_cards": f"WITH {DOCS} SELECT 'meta_' || doc_id AS chunk_id, {_CARD} || chr(10) AS content FROM docs",
    "toc_links": f"WITH {DOCS} SELECT doc_id, (i - 1)::INT AS pos, mucluc[i].title AS title, source_url || mucluc[i].href AS link FROM (SELECT doc_id, source_url, mucluc, unnest(range(1, len(mucluc) + 1)) AS i FROM docs)",
    "metadata_entries": f"WITH {DOCS}, e AS (SELECT doc_id, unnest(map_entries(metadata)) AS e FROM docs) SELECT doc_id, {strip("replace(e.key, ':', '')")} AS key, {strip('e.value')} AS value FROM e WHERE {strip("replace(e.key, ':', '')")} <> '' AND {strip('e.value')} <> ''",
    "related_documents": f"WITH {DOCS}, r AS (SELECT doc_id, (i - 1)::INT AS pos, lienquan_hieuluc_list[i] AS r FROM (SELECT doc_id, lienquan_hieuluc_list, unnest(range(1, len(lienquan_hieuluc_list) + 1)) AS i FROM docs)) SELECT doc_id, pos, r.number AS number, r.lawid AS lawid, r.title AS title, {_ABS.format('r.href')} AS link, coalesce(cardinality(r.attributes), 0)::INT AS n_attributes FROM r",
    "pending_pages": rf"WITH a AS (SELECT DISTINCT regexp_replace({_ABS.format(strip('amended_link'))}, '[?#](.|\n)*$', '') AS url FROM amendment) SELECT url, md5(url) AS url_md5 FROM a WHERE url LIKE 'http%' AND url NOT IN (SELECT source_url FROM law_document UNION SELECT source_url FROM base_law)",
    "listing_pages": "SELECT 'https://vanban.example/danh-sach?trang=' || i AS url FROM range(1, 41) t(i)",
    "all_sources": f"WITH {DOCS} SELECT source_url, doc_id, title, NULL::VARCHAR AS validity, 'law_document' AS origin FROM docs UNION ALL SELECT source_url, doc_id, title, validity, 'base_law' FROM base_law",
    "distinct_amendments": f"WITH {DOCS}, a AS (SELECT doc_id, (i - 1)::INT AS pos, amendments[i] AS a FROM (SELECT doc_id, amendments, unnest(range(1, len(amendments) + 1)) AS i FROM docs)) SELECT doc_id, min(pos) AS pos, a.tip_id AS tip_id, a.bm_title AS bm_title FROM a GROUP BY doc_id, a",
    "segments": f"WITH {SEGMENTS} SELECT doc_id, pos, seg_id, clean, n_tokens, kind, array_to_string(anchors, ',') AS anchors, array_to_string(amends, ',') AS amends FROM s4",
    "hierarchy_fill": f"WITH {SEGMENTS} SELECT doc_id, pos, seg_id, kind, {fill('Phần')} AS part, {fill('Phần', 'Chương')} AS chapter, {fill('Phần', 'Chương', 'Mục')} AS section FROM s4",
    "pack_articles": f"""WITH {SEGMENTS},
w AS (SELECT *, sum(CASE WHEN kind IN ('Phần', 'Chương', 'Mục') OR (kind = 'Điều' AND n_tokens > 96) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS barrier FROM s4),
small AS (SELECT *, n_tokens AS n FROM w WHERE kind = 'Điều' AND n_tokens <= 96),
g AS (SELECT doc_id, barrier, list({{'seg_id': seg_id, 'clean': clean, 'n': n, 'anchors': anchors}} ORDER BY pos) AS its, {packed(items("pos"), 96)} AS bins FROM small GROUP BY doc_id, barrier),
u AS (SELECT doc_id, barrier, i, its[i] AS it, bins[i] AS bin FROM (SELECT *, unnest(range(1, len(its) + 1)) AS i FROM g))
SELECT doc_id, arg_min(it.seg_id, i) || CASE WHEN count(*) > 1 THEN '_gop' ELSE '' END AS chunk_id, count(*) AS n_items, sum(it.n)::BIGINT AS n_tokens, string_agg(it.clean, chr(10) || chr(10) ORDER BY i) AS content,
  array_to_string(list_sort(list_distinct(flatten(list(it.anchors)))), ',') AS anchors FROM u GROUP BY doc_id, barrier, bin""",
    "pack_lines": f"""WITH l AS (SELECT doc_id, i, ls[i] AS line, {n_tokens("ls[i]")} AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
g AS (SELECT doc_id, list({{'line': line, 'n': n}} ORDER BY i) AS its, {packed(items("i"), 64)} AS bins FROM l GROUP BY doc_id),
u AS (SELECT doc_id, i, its[i] AS it, bins[i] AS bin FROM (SELECT *, unnest(range(1, len(its) + 1)) AS i FROM g))
SELECT doc_id, bin::INT AS bin, count(*) AS n_lines, sum(it.n)::BIGINT AS n_tokens, md5(string_agg(it.line, chr(10) ORDER BY i)) AS content_md5 FROM u GROUP BY doc_id, bin""",
    "json_round_trip": f"WITH {CHUNKS} SELECT chunk_type, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars, sum(cardinality(metadata))::BIGINT AS n_metadata, sum(len(amends))::BIGINT AS n_amends FROM cur GROUP BY chunk_type",
    "embed_filter": f"WITH {CHUNKS} SELECT chunk_id, chunk_type, {point_key('chunk_id')} AS point_id, md5(CASE WHEN chunk_type IN {AMENDED} THEN content ELSE content_embed END) AS text_md5 FROM cur WHERE chunk_type IN {AMENDED} OR length(content_embed) > 0",
    "knn_top6": KNN,
    "knn_dedup": f"SELECT (query_id // 80)::BIGINT AS question_id, (query_id % 80 // 20)::INT AS query_ord, vec_id AS point_id, rank FROM ({KNN}) QUALIFY row_number() OVER (PARTITION BY query_id // 80, vec_id ORDER BY query_id, rank) = 1",
    "upsert_latest": "SELECT point_id, arg_max(payload.chunk_id, loaded_at) AS chunk_id, arg_max(payload.chunk_type, loaded_at) AS chunk_type, max(loaded_at) AS loaded_at FROM vector_point GROUP BY point_id",
    "latest_events": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "streamed_upsert": "SELECT amend_key, doc_id, tip_id, is_deleted, loaded_at FROM amendment QUALIFY row_number() OVER (PARTITION BY amend_key ORDER BY loaded_at DESC) = 1",
    "document_nodes": f"""WITH {CHUNKS}, f AS (SELECT * FROM cur WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (chunk_type <> 'Document_Meta')::INT, coalesce(ord, 1 << 30), chunk_id) = 1)
SELECT doc_id, title, source_url, {", ".join(f"metadata['{k}'] AS {p}" for p, k in {"loai_van_ban": "Loại văn bản", "noi_ban_hanh": "Nơi ban hành", "nguoi_ky": "Người ký", "ngay_ban_hanh": "Ngày ban hành", "ngay_hieu_luc": "Ngày hiệu lực", "tinh_trang": "Tình trạng", "so_cong_bao": "Số công báo", "ngay_cong_bao": "Ngày công báo"}.items())} FROM f""",
    "chunk_nodes": f"WITH {CHUNKS} SELECT chunk_id, chunk_type, doc_id, {strip(f'string_split(CASE WHEN chunk_type IN {AMENDED} THEN content ELSE coalesce(content_embed, content) END, chr(10))[1]')} AS name, parent_chunk_id, bm_title, amended_link, md5(content) AS content FROM cur",
    "amendment_edges": f"WITH {CHUNKS}, m AS (SELECT DISTINCT doc_id, chunk_id, unnest(amends) AS tip FROM cur) SELECT DISTINCT 'Chunk' AS src_label, m.chunk_id AS src, 'HAS_AMENDMENT' AS rel, 'Chunk' AS dst_label, a.chunk_id AS dst FROM m JOIN cur a ON a.doc_id = m.doc_id AND a.tip_id = m.tip AND a.chunk_type IN {AMENDED} WHERE m.tip <> ''",
    "amended_documents": rf"WITH {DOCS}, {CHUNKS}, d AS (SELECT source_url, doc_id FROM docs UNION SELECT source_url, doc_id FROM base_law) SELECT DISTINCT 'Chunk' AS src_label, c.chunk_id AS src, 'AMENDS_DOCUMENT' AS rel, 'Document' AS dst_label, d.doc_id AS dst FROM cur c JOIN d ON d.source_url = regexp_replace(c.amended_link, '[?#](.|\n)*$', '') WHERE c.chunk_type IN {AMENDED}",
    "structure_edges": f"""WITH {CHUNKS}, c AS (SELECT * FROM cur WHERE chunk_type NOT IN {AMENDED})
SELECT 'Document' AS src_label, doc_id AS src, 'HAS_METADATA' AS rel, 'Chunk' AS dst_label, chunk_id AS dst FROM c WHERE chunk_type = 'Document_Meta'
UNION SELECT 'Document', doc_id, 'HAS_SUMMARY', 'Chunk', chunk_id FROM c WHERE chunk_type IN ('Summary', 'Summary_Split')
UNION SELECT 'Document', doc_id, 'CONTAINS', 'Chunk', chunk_id FROM c WHERE chunk_type NOT IN ('Document_Meta', 'Summary', 'Summary_Split') AND parent_chunk_id = doc_id
UNION SELECT 'Chunk', c.parent_chunk_id, 'CONTAINS', 'Chunk', c.chunk_id FROM c JOIN cur p ON p.chunk_id = c.parent_chunk_id AND p.doc_id = c.doc_id WHERE c.chunk_type NOT IN ('Document_Meta', 'Summary', 'Summary_Split') AND c.parent_chunk_id <> c.doc_id""",
    "entity_targets": f"WITH {TARGETS} SELECT chunk_id, md5(text) AS text_md5 FROM targets",
    "penalties": f"WITH {TARGETS}, e AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(text, '{PENALTY}', 1)) AS name FROM targets) SELECT 'Penalty' AS label, name, count(*) AS n_chunks FROM e GROUP BY name",
    "query_expansion": rf"WITH {QUESTIONS}, f AS (SELECT question_id, list_concat([question], list_transform(list_filter(string_split(reply, chr(10)), lambda x: {strip('x')} <> ''), lambda x: trim(x, '- •*')))[:4] AS l FROM q WHERE {strip('question')} <> '' AND lower({strip('question')}) NOT IN ('exit', 'quit', 'thoát')) SELECT question_id, (i - 1)::INT AS query_ord, l[i] AS query FROM (SELECT question_id, l, unnest(range(1, len(l) + 1)) AS i FROM f)",
    "rerank_top4": RERANK,
    "context_blocks": f"WITH r AS ({RERANK}), {CHUNKS} SELECT question_id, md5(string_agg(chr(10) || '--- TÀI LIỆU ' || place || ': ' || coalesce(title, 'Tài liệu không tên') || ' ---' || chr(10) || coalesce(content, '') || chr(10), '' ORDER BY place)) AS context_md5 FROM r JOIN cur ON cur.chunk_id = r.point_id GROUP BY question_id",
}
SQL["summary_parts"] = f"""WITH {DOCS},
s AS (SELECT doc_id, 'Tóm tắt nội dung văn bản: ' || {plain("coalesce(title, '')")} || chr(10) || chr(10) AS head, {strip("summary_content")} AS summary FROM docs),
z AS (SELECT *, {n_tokens("head")} AS h, {n_tokens("summary")} AS size FROM s WHERE summary <> ''),
l AS (SELECT doc_id, head, h, i, ps[i] AS part, {n_tokens("ps[i]")} AS n FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, string_split_regex(summary, '\n\n+') AS ps FROM z WHERE h + size > 60))),
g AS (SELECT doc_id, head, greatest(60 - h, 0) AS room, list({{'part': part, 'n': n}} ORDER BY i) AS its, {items("i")} AS ns FROM l GROUP BY doc_id, head, h),
b AS (SELECT doc_id, head, its, {packed("ns", "room")} AS bins FROM g),
u AS (SELECT doc_id, head, i, its[i] AS it, bins[i] AS bin FROM (SELECT *, unnest(range(1, len(its) + 1)) AS i FROM b)),
j AS (SELECT doc_id, head, bin, {strip("string_agg(it.part, chr(10) || chr(10) ORDER BY i)")} AS body FROM u GROUP BY doc_id, head, bin)
SELECT 'summary_' || doc_id AS chunk_id, 'Summary' AS chunk_type, summary AS content, head || summary AS content_embed FROM z WHERE h + size <= 60
UNION ALL SELECT 'summary_' || doc_id || '_part' || (bin + 1), 'Summary_Split', body, head || body FROM j"""
SQL["entity_mentions"] = f"WITH {ENTITIES} SELECT 'Chunk' AS src_label, chunk_id AS src, 'MENTIONS' AS rel, label AS dst_label, name AS dst FROM e"
SQL["mention_counts"] = f"WITH {ENTITIES} SELECT label, count(*) AS n_mentions, count(DISTINCT name) AS n_entities, count(DISTINCT chunk_id) AS n_chunks FROM e GROUP BY label"
SQL["hit_report"] = f"WITH r AS ({RERANK}), {CHUNKS} SELECT question_id, place, '[' || place || '] ' || printf('%.4f', rerank_score) || ' | ' || coalesce(title, 'Tài liệu không tên') || ' | ' || substr(replace(coalesce(content, ''), chr(10), ' '), 1, 120) || '...' AS line FROM r JOIN cur ON cur.chunk_id = r.point_id"
_TEXT = lambda x: strip(f"coalesce({x}, '')")
_LINK = "CASE WHEN a.amended_link LIKE '/%' THEN 'https://vanban.example' || a.amended_link ELSE coalesce(a.amended_link, '') END"
SQL["html_round_trip"] = f"""WITH {DOCS} SELECT doc_id, {_TEXT("title")} AS title,
  array_to_string(list_sort(list_transform(list_filter(map_entries(metadata), lambda e: replace({_TEXT("e.key")}, ':', '') <> '' AND {_TEXT("e.value")} <> ''), lambda e: replace({_TEXT("e.key")}, ':', '') || '=' || {_TEXT("e.value")})), '|') AS metadata,
  md5(coalesce(array_to_string(list_transform(mucluc, lambda e: coalesce(e.href, '') || '|' || {_TEXT("e.title")}), chr(10)), '')) AS toc_md5,
  md5(coalesce(array_to_string(list_transform(amendments, lambda a: a.tip_id || '|' || {_TEXT("a.bm_title")} || '|' || {_TEXT("a.original_content")} || '|' || {_TEXT("a.amended_content")} || '|' || {_LINK}), chr(10)), '')) AS amendments_md5,
  md5(coalesce(array_to_string(list_transform(lienquan_hieuluc_list, lambda r: {_TEXT("r.number")} || '|' || coalesce(r.lawid, '') || '|' || {_TEXT("r.title")} || '|' || coalesce(r.href, '')), chr(10)), '')) AS related_md5,
  coalesce(len(list_filter(mucluc, lambda e: e.href LIKE '#_%')), 0)::INT AS n_anchors, false AS has_head
FROM docs WHERE coalesce(metadata['Tình trạng'], '') <> 'Đã biết'"""

# ---- all chunks, cut at 96 tokens (amendments at 80) -------------------------------------------

_SEGMENTS_RAW = SEGMENTS.replace(f'{tidy("seg")} AS clean', f'{drop("seg", "ANCHOR")} AS raw, {tidy("seg")} AS clean').replace("AS seg_id, clean,", "AS seg_id, raw, clean,")
POINT = "[a-zđ][)]"
_NONE, _QUOTE = "[]::VARCHAR[]", '^[“"”]'
_HEAD = "'Văn bản: ' || title || chr(10) || chr(10) || 'Thuộc: '"


def _bins(name: str, source: str, keys: str, order: str, limit: str = "96") -> str:
    """``source`` with its bin among the rows of its keys; the rows need ``n``."""
    return f"""
{name}_g AS (SELECT {keys}, list(r ORDER BY {order}) AS rs, {items(order)} AS ns FROM {source} r GROUP BY {keys}),
{name}_b AS (SELECT rs, {packed("ns", limit)} AS bins FROM {name}_g),
{name} AS (SELECT unnest(rs) AS r, unnest(bins) AS bin FROM {name}_b)"""


def _merge(source: str, kind: str, keys: str, order: str, item: str, parent: str, text: str, sep: str, head: str) -> str:
    content = f"string_agg(r.{text}, {sep} ORDER BY r.{order})"
    return f"""SELECT arg_min(r.{item}, r.{order}) || CASE WHEN count(*) > 1 THEN '_gop' ELSE '' END AS chunk_id, '{kind}' AS chunk_type, r.doc_id AS doc_id, arg_min(r.{parent}, r.{order}) AS parent_chunk_id, {content} AS content,
  {drop(f"any_value(r.{head}) || {content}", "AMENDMENT")} AS content_embed, list_sort(list_distinct(flatten(list(r.anchors)))) AS anchors, list_sort(list_distinct(flatten(list(r.amends)))) AS amends FROM {source} GROUP BY r.doc_id, {keys}, bin"""


_CHUNKED = f"""WITH {_SEGMENTS_RAW},
h AS (SELECT s4.*, {plain("title")} AS title, {fill("Phần")} AS part, {fill("Phần", "Chương")} AS chapter, {fill("Phần", "Chương", "Mục")} AS section FROM (SELECT s4.*, docs.title FROM s4 JOIN docs ON docs.doc_id = s4.doc_id) s4),
w AS (SELECT *, n_tokens AS n, {_HEAD} AS head, sum(CASE WHEN kind IN ('Phần', 'Chương', 'Mục') OR (kind = 'Điều' AND n_tokens > 96) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS barrier FROM h),
small AS (SELECT * FROM w WHERE kind = 'Điều' AND n <= 96),{_bins("a", "small", "doc_id, barrier", "pos")},
large AS (SELECT *, {pieces("raw", CLAUSE)} AS ps FROM w WHERE kind = 'Điều' AND n > 96),
c0 AS (SELECT doc_id, seg_id, anchors, head || {tidy("ps[1]")} || chr(10) || chr(10) AS head, i - 1 AS j, ps[i] AS raw FROM (SELECT *, unnest(range(2, len(ps) + 1)) AS i FROM large WHERE len(ps) > 1)),
c1 AS (SELECT *, seg_id || '_k' || j AS item, {tidy("raw")} AS text, {ids("raw", "AMENDMENT")} AS amends FROM c0),
c2 AS (SELECT *, {n_tokens("text")} AS n FROM c1),
c3 AS (SELECT *, sum(CASE WHEN n > 96 THEN 1 ELSE 0 END) OVER (PARTITION BY seg_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS fence FROM c2),
clause AS (SELECT * FROM c3 WHERE n <= 96),{_bins("k", "clause", "doc_id, seg_id, fence", "j")},
big AS (SELECT *, {pieces("raw", POINT)} AS ps FROM c3 WHERE n > 96),
p0 AS (SELECT doc_id, seg_id, item AS own, anchors, head || CASE WHEN len(ps) > 1 THEN {tidy("ps[1]")} ELSE '' END || chr(10) || chr(10) AS head, i AS k, CASE WHEN len(ps) > 1 THEN ps[i + 2] ELSE ps[i + 1] END AS raw FROM (SELECT *, unnest(range(0, CASE WHEN len(ps) > 1 THEN len(ps) - 1 ELSE 1 END)) AS i FROM big)),
p1 AS (SELECT *, own || '_d' || k AS item, {tidy("raw")} AS text, {ids("raw", "AMENDMENT")} AS amends FROM p0),
p2 AS (SELECT *, {n_tokens("text")} AS n FROM p1),
p3 AS (SELECT *, 2 * sum(CASE WHEN n > 96 THEN 1 ELSE 0 END) OVER (PARTITION BY own ORDER BY k ROWS UNBOUNDED PRECEDING) + CASE WHEN n > 96 THEN 0 ELSE 1 END AS fence FROM p2),{_bins("d", "p3", "doc_id, own, fence", "k")},
q0 AS (SELECT doc_id, seg_id, section, anchors, 'Điều_Split' AS kind, '_part' AS suffix, raw FROM large WHERE len(ps) = 1 UNION ALL SELECT doc_id, seg_id, section, anchors, 'Preamble', '_p', raw FROM w WHERE kind = 'other'),
q1 AS (SELECT * EXCLUDE (raw, ps), ps[i] AS part FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, string_split_regex(raw, '\\n\\n+') AS ps FROM q0))),
q2 AS (SELECT *, {n_tokens(tidy("part"))} AS n FROM q1 WHERE {strip("part")} <> ''),{_bins("q", "q2", "doc_id, seg_id", "i")},
q3 AS (SELECT r.doc_id AS doc_id, r.seg_id AS seg_id, bin, any_value(r.section) AS section, any_value(r.anchors) AS anchors, any_value(r.kind) AS kind, any_value(r.suffix) AS suffix, string_agg(r.part, chr(10) || chr(10) ORDER BY r.i) AS body FROM q GROUP BY r.doc_id, r.seg_id, bin),
m0 AS (SELECT doc_id, i, a FROM (SELECT doc_id, amendments, unnest(range(1, len(amendments) + 1)) AS i, unnest(amendments) AS a FROM docs) WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, a ORDER BY i) = 1),
m1 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS nth, a.tip_id AS tip, {strip("coalesce(a.bm_title, '')")} AS bm_title, coalesce(a.amended_link, '') AS link,
  {strip(f"regexp_replace({strip(f"regexp_replace({strip("coalesce(a.amended_content, '')")}, '{LEAD}', '')")}, '{_QUOTE}', '')")} AS body FROM m0),
m2 AS (SELECT *, coalesce(tip, 'unknown_' || nth) AS tip_id, '**SỬA ĐỔI, BỔ SUNG**' || chr(10) || bm_title || chr(10) || chr(10) || '**Nội dung mới:**' || chr(10) AS first, '**SỬA ĐỔI, BỔ SUNG**' || chr(10) || bm_title || chr(10) || chr(10) || '**Nội dung mới (tiếp theo):**' || chr(10) AS later FROM m1),
m3 AS (SELECT *, {n_tokens("first || body")} AS size, {n_tokens("first")} AS h1, {n_tokens("later")} AS h2 FROM m2),
n0 AS (SELECT * EXCLUDE (ps), {strip("ps[i]")} AS part FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, {pieces("body", "(?:Chương|Điều|Mục|Khoản)" + chr(92) + "s")} AS ps FROM m3 WHERE size > 80)) ),
n1 AS (SELECT *, {n_tokens("part")} AS n FROM n0 WHERE part <> ''),
n_g AS (SELECT doc_id, nth, greatest(80 - h1, 0) AS r1, greatest(80 - h2, 0) AS r2, list(r ORDER BY i) AS rs, {items("i")} AS ns FROM n1 r GROUP BY doc_id, nth, h1, h2),
n_b AS (SELECT rs, {packed("ns", "(CASE WHEN a.bin = 0 THEN r1 ELSE r2 END)")} AS bins FROM n_g),
nn AS (SELECT unnest(rs) AS r, unnest(bins) AS bin FROM n_b),
n2 AS (SELECT r.doc_id AS doc_id, r.nth AS nth, bin, any_value(r.tip_id) AS tip_id, any_value(r.bm_title) AS bm_title, any_value(r.link) AS link, any_value(CASE WHEN bin = 0 THEN r.first ELSE r.later END) || string_agg(r.part, chr(10) ORDER BY r.i) AS content FROM nn GROUP BY r.doc_id, r.nth, bin),
sm AS ({SQL["summary_parts"].replace(f"WITH {DOCS},", "WITH").replace("> 60", "> 96").replace("<= 60", "<= 96").replace("60 - h", "96 - h").replace("'summary_' || doc_id AS chunk_id", "doc_id, 'summary_' || doc_id AS chunk_id").replace("SELECT 'summary_' || doc_id || '_part'", "SELECT doc_id, 'summary_' || doc_id || '_part'")}),
body AS (
SELECT seg_id AS chunk_id, kind AS chunk_type, doc_id, CASE kind WHEN 'Phần' THEN doc_id WHEN 'Chương' THEN part ELSE chapter END AS parent_chunk_id, clean AS content, NULL::VARCHAR AS content_embed, anchors, amends FROM w WHERE kind IN ('Phần', 'Chương', 'Mục')
UNION ALL {_merge("a", "Điều", "r.barrier", "pos", "seg_id", "section", "clean", "chr(10) || chr(10)", "head")}
UNION ALL SELECT seg_id, 'Điều', doc_id, section, {tidy("ps[1]")}, NULL, anchors, {ids("ps[1]", "AMENDMENT")} FROM large WHERE len(ps) > 1
UNION ALL {_merge("k", "Khoản", "r.seg_id, r.fence", "j", "item", "seg_id", "text", "chr(10) || chr(10)", "head")}
UNION ALL SELECT item, 'Khoản', doc_id, seg_id, CASE WHEN len(ps) > 1 THEN {tidy("ps[1]")} ELSE '' END, NULL, anchors, CASE WHEN len(ps) > 1 THEN {ids("ps[1]", "AMENDMENT")} ELSE {_NONE} END FROM big
UNION ALL {_merge("d", "Điểm", "r.own, r.fence", "k", "item", "own", "text", "chr(10)", "head")}
UNION ALL SELECT seg_id || suffix || (bin + 1), kind, doc_id, section, {tidy("body")}, NULL, anchors, {ids("body", "AMENDMENT")} FROM q3),
amend AS (
SELECT 'amend_' || doc_id || '_' || tip_id AS chunk_id, 'Amendment' AS chunk_type, doc_id, {strip("first || body")} AS content, tip_id, bm_title, link AS amended_link FROM m3 WHERE size <= 80
UNION ALL SELECT 'amend_' || doc_id || '_' || tip_id || '_part_' || (bin + 1), 'Amendment_Split', doc_id, {strip("content")}, tip_id, bm_title, link FROM n2),
chunked AS (
SELECT 'meta_' || doc_id AS chunk_id, 'Document_Meta' AS chunk_type, doc_id, doc_id AS parent_chunk_id, {_CARD} || chr(10) AS content, {_CARD} || chr(10) AS content_embed, NULL::VARCHAR AS anchors, NULL::VARCHAR AS amends, NULL::VARCHAR AS tip_id, NULL::VARCHAR AS bm_title, NULL::VARCHAR AS amended_link FROM docs
UNION ALL SELECT chunk_id, chunk_type, doc_id, doc_id, content, content_embed, NULL, NULL, NULL, NULL, NULL FROM sm
UNION ALL SELECT chunk_id, chunk_type, doc_id, parent_chunk_id, content, content_embed, array_to_string(anchors, ','), array_to_string(amends, ','), NULL, NULL, NULL FROM body
UNION ALL SELECT chunk_id, chunk_type, doc_id, NULL, content, NULL, NULL, NULL, tip_id, bm_title, amended_link FROM amend)
"""
SQL["chunks"] = f"{_CHUNKED} SELECT chunked.*, docs.source_url, {plain('docs.title')} AS title, cardinality(docs.metadata)::INT AS metadata FROM chunked JOIN docs ON docs.doc_id = chunked.doc_id"
SQL["chunk_types"] = f"{_CHUNKED} SELECT chunk_type, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM chunked GROUP BY chunk_type"
_BUILT = f"{_CHUNKED}, cur AS (SELECT * REPLACE (string_split(amends, ',') AS amends) FROM chunked)"
_OF = lambda query: query.split(f"WITH {CHUNKS}", 1)[1].lstrip(", ")
_LINKED = r"SELECT DISTINCT c.chunk_id, d.doc_id FROM cur c JOIN docs d ON d.source_url = regexp_replace(c.amended_link, '[?#](.|\n)*$', '') WHERE c.chunk_type IN ('Amendment', 'Amendment_Split')"
SQL["pipeline"] = f"""{_BUILT}, parents AS (SELECT DISTINCT parent_chunk_id AS p FROM cur WHERE parent_chunk_id IS NOT NULL AND parent_chunk_id <> ''),
parts AS (
SELECT 'Document' AS kind FROM docs WHERE title IS NOT NULL AND source_url IS NOT NULL
UNION ALL SELECT 'Chunk ' || chunk_type FROM cur
UNION ALL SELECT rel FROM (WITH {_OF(SQL["structure_edges"])})
UNION ALL SELECT rel FROM (WITH {_OF(SQL["amendment_edges"])})
UNION ALL SELECT 'AMENDS_DOCUMENT' FROM ({_LINKED})
UNION ALL SELECT 'point' FROM cur WHERE chunk_type IN {AMENDED} OR length(content_embed) > 0
UNION ALL SELECT 'entity target' FROM (SELECT DISTINCT chunk_id, content FROM cur WHERE chunk_type IN {AMENDED} UNION ALL SELECT DISTINCT chunk_id, coalesce(content_embed, content) FROM cur WHERE chunk_type NOT IN {AMENDED} AND chunk_type NOT IN {NO_ENTITY} AND chunk_id NOT IN (SELECT p FROM parents)))
SELECT kind, count(*) AS n FROM parts GROUP BY kind"""
SQL["dispatched"] = f"WITH {TARGETS} SELECT (('0x' || substr(md5(chunk_id), 1, 8))::BIGINT % 2)::INT AS endpoint, count(*) AS n_targets FROM targets GROUP BY ALL"
SQL["embedded_points"] = f"WITH {CHUNKS}, t AS (SELECT chunk_id, chunk_type, CASE WHEN chunk_type IN {AMENDED} THEN content ELSE content_embed END AS x FROM cur WHERE chunk_type IN {AMENDED} OR length(content_embed) > 0) SELECT {point_key('chunk_id')} AS point_id, chunk_type, 64 AS dim, CASE WHEN {n_tokens('x')} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM t"
