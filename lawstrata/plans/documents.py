"""Queries of the document pipeline: text functions, chunking, vectors, graph, retrieval, incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawstrata.functions import text as t
from lawstrata.functions.links import absolute, drop_query_and_fragment
from lawstrata.operators import chunker, graph, pages, retrieval, vectors
from lawstrata.operators.hierarchy import current_rows
from lawstrata.operators.pack import greedy_bins, ordered, union_of
from lawstrata.session import Scratch
from lawstrata.sources import sinks
from lawstrata.sources.tables import CHUNK, json_records, pages_to_visit, table
from lawstrata.streaming.incremental import read_upserted, stream_table, upsert_stream

SITE = "https://vanban.example"
#: Limits at which articles, clauses and points of these tables are packed and cut.
LIMIT, LEAST, EMBED_DIM = 96, 4, 64


def current_documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The current version of each page that is not deleted; only the columns named, if any are, travel."""
    laws = table(spark, folder, "law_document")
    if columns:
        laws = laws.select(*dict.fromkeys(("source_url", "is_deleted", "loaded_at", *columns)))
    return vectors.latest(laws, "source_url", F.col("loaded_at")).where(~F.coalesce("is_deleted", F.lit(False)))


def current_chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The current row of each chunk; only the columns named, if any are, travel."""
    chunks = table(spark, folder, "chunk")
    if columns:
        chunks = chunks.select(*dict.fromkeys(("chunk_id", "loaded_at", *columns)))
    return vectors.latest(chunks, "chunk_id", F.col("loaded_at"))


# ---- keys and text functions ------------------------------------------------------------------


def doc_ids(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "law_document").select("source_url", "doc_id").distinct()
    return urls.select("source_url", "doc_id", t.url_hash(F.col("source_url")).alias("url_md5"), t.doc_key(F.col("source_url")).alias("computed_id"))


def point_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunk").select("chunk_id").distinct().select("chunk_id", t.point_key(F.col("chunk_id")).alias("point_id"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", t.tokens(F.col("text")).alias("n_tokens"))


def text_clean_up(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunk").select("chunk_id", "content").distinct()
    x = F.col("content")
    return c.select("chunk_id", t.strip_emphasis(x).alias("plain"), t.tidy(x).alias("tidy"), t.embed_text(x).alias("embedded"), F.array_join(t.marker_ids(x, "ANCHOR"), ",").alias("anchor_ids"), F.array_join(t.marker_ids(x, "AMENDMENT"), ",").alias("amendment_ids"), t.bare(x).alias("bare"))


def text_splits(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null")
    x = F.col("text")
    return d.select("doc_id", F.size(t.split_clauses(x)).alias("n_clauses"), F.size(t.split_points(x)).alias("n_points"), F.size(t.split_paragraphs(x)).alias("n_paragraphs"), F.size(t.split_new_wording(x)).alias("n_wordings"))


def clauses(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(t.split_clauses(F.col("text"))).alias("pos", "clause"))


def new_wordings(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "amendment").where("amended_content is not null").select("amend_key", "amended_content").distinct()
    return a.select("amend_key", t.strip_lead_in(F.concat(F.lit("Khoản 1 được sửa NHƯ SAU: “"), "amended_content")).alias("wording"), t.strip_lead_in(F.col("amended_content")).alias("own_wording"))


def metadata_cards(spark: SparkSession, folder: str) -> DataFrame:
    return chunker.meta_chunks(current_documents(spark, folder, "doc_id", "title", "metadata")).select("chunk_id", "content")


# ---- documents --------------------------------------------------------------------------------


def toc_links(spark: SparkSession, folder: str) -> DataFrame:
    d = current_documents(spark, folder, "doc_id", "mucluc")
    rows = d.select("doc_id", "source_url", F.posexplode("mucluc").alias("pos", "e"))
    return rows.select("doc_id", "pos", "e.title", F.concat("source_url", "e.href").alias("link"))


def metadata_entries(spark: SparkSession, folder: str) -> DataFrame:
    d = current_documents(spark, folder, "doc_id", "metadata").select("doc_id", F.explode("metadata").alias("key", "value"))
    return d.select("doc_id", t.strip(F.regexp_replace("key", ":", "")).alias("key"), t.strip(F.col("value")).alias("value")).where("key <> '' and value <> ''")


def related_documents(spark: SparkSession, folder: str) -> DataFrame:
    d = current_documents(spark, folder, "doc_id", "lienquan_hieuluc_list").select("doc_id", F.posexplode("lienquan_hieuluc_list").alias("pos", "r"))
    return d.select("doc_id", "pos", "r.number", "r.lawid", "r.title", absolute(F.col("r.href"), SITE).alias("link"), F.coalesce(F.size("r.attributes"), F.lit(0)).alias("n_attributes"))


def html_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written from the documents' fields in the form of the site, parsed again: what the parser reads back."""
    d = current_documents(spark, folder, "title", "metadata", "mucluc", "amendments", "lienquan_hieuluc_list")
    lit = F.lit
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, lit("")), lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit(">"), lit("&gt;"))
    each = lambda c, f, sep="": F.coalesce(F.array_join(F.transform(c, f), sep), lit(""))
    meta = each(F.map_entries("metadata"), lambda e: F.concat(lit("<tr><td><b>"), esc(e["key"]), lit(":</b></td><td> "), esc(e["value"]), lit("</td></tr>")))
    toc = each("mucluc", lambda e: F.concat(lit('<li><a class="amuclucvb" href="'), esc(e["href"]), lit('">'), esc(e["title"]), lit("</a></li>")))
    heads = each("mucluc", lambda e: F.concat(lit('<p><a name="'), F.replace(esc(e["href"]), lit("#"), lit("")), lit('"></a><b>'), esc(e["title"]), lit("</b></p>")))
    links = each("amendments", lambda a: F.concat(lit('<a atmm=".lqhlTootip-'), esc(a["tip_id"]), lit('">'), esc(a["anchor_text"]), lit("</a>")), " ")
    tips = each("amendments", lambda a: F.concat(
        lit('<div class="lqhlTip-'), esc(a["tip_id"]), lit(' hidden"><div id="bmTitle">'), esc(a["bm_title"]), lit('</div><div id="bmContentOld"> '), esc(a["original_content"]),
        lit('</div><div id="bmContent"><a href="'), esc(a["amended_link"]), lit('">xem</a>'), esc(a["amended_content"]), lit("</div></div>")))
    page = F.concat(
        lit('<html><table><tr><td><b>Ngoài:</b></td><td>x</td></tr></table><div id="tab-1" class="contentDoc x"><h1> '), esc(F.col("title")), lit("</h1><table>"), meta,
        lit('</table><table><tr><td><b>Sau:</b></td><td>x</td></tr></table></div><ul class="muclucVB">'), toc, lit('</ul><div class="content1"><!-- x --><table><tr><td>CỘNG<br>HÒA</td><td>Độc lập</td></tr></table>'), heads,
        lit("<p>"), links, lit('</p></div><div id="divltrLienQuanHieuLucTungPhan">'), tips, lit("</div></html>"),
    )
    near = each("lienquan_hieuluc_list", lambda r: F.concat(
        lit('<div class="content-1"><div class="number">'), esc(r["number"]), lit('</div><p class="nqTitle" lawid="'), esc(r["lawid"]), lit('"><a href="'), esc(r["href"]), lit('">'), esc(r["title"]), lit('</a></p><div class="right-col">'),
        F.coalesce(F.array_join(F.transform(F.map_entries(r["attributes"]), lambda e: F.concat(lit("<p><span>"), esc(e["key"]), lit(":</span> "), esc(e["value"]), lit("</p>"))), ""), lit("")), lit("</div></div>")))
    tab = F.concat(lit('<div id="tab5" class="contentDoc">'), near, lit("</div><!-- Không có văn bản -->"))
    good, _ = pages.split_ended(pages.parse_pages(d.select("source_url", page.alias("main_html"), tab.alias("hl_html")), SITE))
    md5 = lambda c: F.md5(F.coalesce(F.array_join(c, "\n"), lit("")).cast("binary"))
    return good.select(
        "doc_id", "title", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], lit("="), e["value"]))), "|").alias("metadata"),
        md5(F.transform("mucluc", lambda e: F.concat_ws("|", e["href"], e["title"]))).alias("toc_md5"),
        md5(F.transform("amendments", lambda a: F.concat_ws("|", a["tip_id"], a["bm_title"], a["original_content"], a["amended_content"], a["amended_link"]))).alias("amendments_md5"),
        md5(F.transform("lienquan_hieuluc_list", lambda r: F.concat_ws("|", r["number"], r["lawid"], r["title"], r["href"]))).alias("related_md5"),
        F.size(F.filter("mucluc", lambda e: F.contains("main_content", F.concat(lit("[[ANCHOR:"), F.replace(e["href"], lit("#"), lit("")), lit("]]"))))).alias("n_anchors"), F.contains("main_content", lit("Độc lập")).alias("has_head"),
    )


def pending_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that amendments name and that are not there yet."""
    a = table(spark, folder, "amendment").select(drop_query_and_fragment(absolute(t.strip(F.col("amended_link")), SITE)).alias("url")).where("url like 'http%'")
    done = table(spark, folder, "law_document").select("source_url").union(table(spark, folder, "base_law").select("source_url"))
    return sinks.pending(a, done, "url", "source_url").select("url", "url_md5")


def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages_to_visit(spark, 1, 40, SITE + "/danh-sach?trang={}")


def all_sources(spark: SparkSession, folder: str) -> DataFrame:
    a = current_documents(spark, folder, "doc_id", "title").select("source_url", "doc_id", "title", F.lit("law_document").alias("origin"))
    return a.unionByName(table(spark, folder, "base_law").withColumn("origin", F.lit("base_law")), allowMissingColumns=True).select("source_url", "doc_id", "title", "validity", "origin")


def distinct_amendments(spark: SparkSession, folder: str) -> DataFrame:
    """Amendments of the documents, structurally equal ones once."""
    d = current_documents(spark, folder, "doc_id", "amendments").select("doc_id", F.posexplode("amendments").alias("pos", "a"))
    first = F.row_number().over(Window.partitionBy("doc_id", F.to_json("a")).orderBy("pos"))
    return d.withColumn("r", first).where("r = 1").select("doc_id", "pos", "a.tip_id", "a.bm_title")


# ---- chunking ---------------------------------------------------------------------------------


def segments(spark: SparkSession, folder: str) -> DataFrame:
    s = chunker.segments(current_documents(spark, folder, "doc_id", "title", "main_content"), LEAST, starred=False)
    return s.select("doc_id", "pos", "seg_id", "clean", "n_tokens", "kind", F.array_join("anchors", ",").alias("anchors"), F.array_join("amends", ",").alias("amends"))


def hierarchy_fill(spark: SparkSession, folder: str) -> DataFrame:
    s = chunker.with_hierarchy(chunker.segments(current_documents(spark, folder, "doc_id", "title", "main_content"), LEAST, starred=False))
    return s.select("doc_id", "pos", "seg_id", "kind", "part", "chapter", "section")


def pack_articles(spark: SparkSession, folder: str) -> DataFrame:
    s = chunker.with_hierarchy(chunker.segments(current_documents(spark, folder, "doc_id", "title", "main_content"), LEAST, starred=False))
    b = chunker.article_bins(s, LIMIT)
    g = b.groupBy("doc_id", "barrier", "bin").agg(F.min_by("seg_id", "pos").alias("first"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), ordered("clean", "pos", "\n\n").alias("content"), union_of("anchors").alias("anchors"))
    return g.select("doc_id", F.concat("first", F.when(F.col("n_items") > 1, "_gop").otherwise("")).alias("chunk_id"), "n_items", "n_tokens", "content", F.array_join("anchors", ",").alias("anchors"))


def pack_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document packed to 64 words."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    b = greedy_bins(d.withColumn("n", t.tokens(F.col("line"))), ["doc_id"], "pos", F.col("n"), 64)
    return b.groupBy("doc_id", "bin").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_tokens"), F.md5(ordered("line", "pos", "\n").cast("binary")).alias("content_md5"))


def summary_parts(spark: SparkSession, folder: str) -> DataFrame:
    return chunker.summary_chunks(current_documents(spark, folder, "doc_id", "title", "summary_content"), 60).select("chunk_id", "chunk_type", "content", "content_embed")


def _chunked(spark: SparkSession, folder: str) -> DataFrame:
    docs = current_documents(spark, folder, "doc_id", "title", "metadata", "summary_content", "main_content", "amendments")
    return chunker.chunk_documents(docs, LIMIT, 80, LEAST, starred=False)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of the documents, cut at small limits so that every path is taken."""
    c = _chunked(spark, folder)
    return c.withColumns({"anchors": F.array_join("anchors", ","), "amends": F.array_join("amends", ","), "metadata": F.size("metadata")}).drop("ord")


def chunk_types(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).groupBy("chunk_type").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks written as JSON by bucket of their document, and scanned back with a fixed schema."""
    scratch = Scratch(spark, "json")
    c = current_chunks(spark, folder).select(*(f.split(" ")[0] for f in CHUNK.split(", ")))
    sinks.write_bucketed(c, f"{scratch.path}/chunks", F.col("doc_id"), "json")
    back = json_records(spark, [f"{scratch.path}/chunks"], CHUNK)
    return back.groupBy("chunk_type").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"), F.sum(F.size("metadata")).alias("n_metadata"), F.sum(F.when(F.col("amends").isNotNull(), F.size("amends"))).alias("n_amends"))


# ---- vectors ----------------------------------------------------------------------------------


def embed_filter(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.embeddable(current_chunks(spark, folder, "chunk_type", "content", "content_embed")).select("chunk_id", "chunk_type", t.point_key(F.col("chunk_id")).alias("point_id"), F.md5(F.col("embed_text").cast("binary")).alias("text_md5"))


def embedded_points(spark: SparkSession, folder: str) -> DataFrame:
    p = vectors.points(current_chunks(spark, folder, "chunk_type", "content", "content_embed"), EMBED_DIM)
    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 4)
    return p.select("point_id", "payload.chunk_type", F.size("vector").alias("dim"), norm.alias("norm"))


def knn_top6(spark: SparkSession, folder: str) -> DataFrame:
    """Six nearest embeddings of each whose id is divisible by 20, among all."""
    e = table(spark, folder, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.nearest(e, q, "vec_id", "embedding", "query_id", "query_vector", 6).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


def knn_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of four queries by id: each point once, at its first query and rank."""
    hits = knn_top6(spark, folder).select(F.floor(F.col("query_id") / 80).cast("bigint").alias("question_id"), F.floor(F.col("query_id") % 80 / 20).cast("int").alias("query_ord"), F.col("vec_id").alias("point_id"), "rank")
    return retrieval.first_hits(hits)


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "vector_point").select("point_id", "payload.chunk_id", "payload.chunk_type", "loaded_at")
    return vectors.latest(v, "point_id", F.col("loaded_at"))


def latest_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return current_rows(e, ["user_id"], "ts", {c: F.col(c) for c in ("event_id", "event_type", "value")})


def streamed_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The latest amendment of each key, kept by a stream of upserts."""
    scratch = Scratch(spark, "stream")
    a = table(spark, folder, "amendment").select("amend_key", "doc_id", "tip_id", "is_deleted", "loaded_at")
    a.repartition(4, "amend_key").write.parquet(f"{scratch.path}/arriving")
    query = upsert_stream(stream_table(spark, f"{scratch.path}/arriving", a, 2), f"{scratch.path}/table", "amend_key", F.col("loaded_at"), f"{scratch.path}/checkpoint")
    query.awaitTermination()
    return read_upserted(spark, f"{scratch.path}/table")


# ---- graph ------------------------------------------------------------------------------------


def document_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.document_nodes(current_chunks(spark, folder, "chunk_type", "doc_id", "title", "source_url", "metadata", "ord"))


def chunk_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.chunk_nodes(current_chunks(spark, folder, "chunk_type", "doc_id", "content", "content_embed", "parent_chunk_id", "bm_title", "amended_link")).withColumn("content", F.md5(F.col("content").cast("binary")))


def amendment_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.amendment_edges(current_chunks(spark, folder, "chunk_type", "doc_id", "tip_id", "amends"))


def amended_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = current_documents(spark, folder, "doc_id").select("source_url", "doc_id").union(table(spark, folder, "base_law").select("source_url", "doc_id"))
    return graph.amended_documents(current_chunks(spark, folder, "chunk_type", "amended_link"), docs)


def structure_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.structure_edges(current_chunks(spark, folder, "chunk_type", "doc_id", "parent_chunk_id"))


def entity_targets(spark: SparkSession, folder: str) -> DataFrame:
    return graph.entity_targets(current_chunks(spark, folder, "chunk_type", "content", "content_embed", "parent_chunk_id")).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return graph.unpivot_entities(graph.extract_entities(graph.entity_targets(current_chunks(spark, folder, "chunk_type", "content", "content_embed", "parent_chunk_id"))))


def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return graph.mention_edges(_entities(spark, folder))


def penalties(spark: SparkSession, folder: str) -> DataFrame:
    """Penalty entities, and by how many chunks each is mentioned."""
    e = _entities(spark, folder).where("label = 'Penalty'")
    return e.groupBy("label", "name").agg(F.count("*").alias("n_chunks"))


def mention_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = _entities(spark, folder)
    return e.groupBy("label").agg(F.count("*").alias("n_mentions"), F.countDistinct("name").alias("n_entities"), F.countDistinct("chunk_id").alias("n_chunks"))


def dispatched(spark: SparkSession, folder: str) -> DataFrame:
    d = graph.dispatch(graph.entity_targets(current_chunks(spark, folder, "chunk_type", "content", "content_embed", "parent_chunk_id")), 2)
    return d.groupBy("endpoint").agg(F.count("*").alias("n_targets"))


# ---- retrieval --------------------------------------------------------------------------------


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of the documents: the first line of those that ask."""
    d = table(spark, folder, "documents").where("text like 'Hỏi: %'")
    return d.select(F.col("doc_id").alias("question_id"), F.regexp_replace(F.split("text", "\n")[0], "^Hỏi: ", "").alias("question"), F.col("text").alias("reply"))


def query_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Up to four queries for each question; the lines of its answer stand in for a model's reply."""
    q = retrieval.asked(_questions(spark, folder), "question")
    return q.select("question_id", F.posexplode(retrieval.expanded(F.col("question"), F.col("reply"))).alias("query_ord", "query"))


def rerank_top4(spark: SparkSession, folder: str) -> DataFrame:
    """For each law, its chunks' summary and points reranked against its title by shared words."""
    c = current_chunks(spark, folder, "doc_id", "content", "content_embed").where("content_embed is not null")
    d = current_documents(spark, folder, "doc_id", "title").select(F.col("doc_id").alias("question_id"), F.col("title").alias("question"))
    hits = c.join(d, c.doc_id == d.question_id).select("question_id", "question", F.col("chunk_id").alias("point_id"), "content", F.lit(0).alias("query_ord"), F.lit(0).alias("rank"))
    top = retrieval.reranked(hits, F.round(retrieval.overlap(F.col("question"), F.col("content")), 6))
    return top.select("question_id", "point_id", "place", "rerank_score")


def context_blocks(spark: SparkSession, folder: str) -> DataFrame:
    top = rerank_top4(spark, folder).join(current_chunks(spark, folder, "title", "content").select(F.col("chunk_id").alias("point_id"), "title", "content"), "point_id")
    return retrieval.contexts(top).select("question_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def hit_report(spark: SparkSession, folder: str) -> DataFrame:
    """The reranked hits of each law, one line each."""
    top = rerank_top4(spark, folder).join(current_chunks(spark, folder, "title", "content").select(F.col("chunk_id").alias("point_id"), "title", "content"), "point_id")
    return retrieval.report(top)


def question_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to the questions whose id is divisible by 20, from the whole index of embeddable chunks.

    Each question is expanded to four queries; the lines of its document stand in for a model's reply.
    """
    p = vectors.points(current_chunks(spark, folder, "chunk_type", "content", "content_embed", "title"), EMBED_DIM).select("point_id", "vector", "payload.content", "payload.title")
    p = Scratch(spark, "points").cut(p, "points")
    q = _questions(spark, folder).where("question_id % 20 = 0")
    return retrieval.answer_questions(q, p, F.col("reply"), EMBED_DIM)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to chunks to graph and index in one go: how many nodes, edges and points of each kind come of them."""
    c = Scratch(spark, "pipeline").cut(_chunked(spark, folder), "chunks")
    docs = graph.document_nodes(c)
    edges = graph.structure_edges(c).union(graph.amendment_edges(c)).union(graph.amended_documents(c, docs))
    counted = lambda df, kind: df.select(kind.alias("kind"))
    parts = [
        counted(docs.where("title is not null and source_url is not null"), F.lit("Document")), counted(graph.chunk_nodes(c), F.concat(F.lit("Chunk "), F.col("chunk_type"))),
        counted(edges, F.col("rel")), counted(vectors.embeddable(c), F.lit("point")), counted(graph.entity_targets(c), F.lit("entity target")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_ids, point_ids, token_counts, text_clean_up, text_splits, clauses, new_wordings, metadata_cards, toc_links, metadata_entries, related_documents, html_round_trip,
        pending_pages, listing_pages, all_sources, distinct_amendments, segments, hierarchy_fill, pack_articles, pack_lines, summary_parts, chunks, chunk_types, json_round_trip,
        embed_filter, embedded_points, knn_top6, knn_dedup, upsert_latest, latest_events, streamed_upsert, document_nodes, chunk_nodes, amendment_edges, amended_documents,
        structure_edges, entity_targets, entity_mentions, penalties, mention_counts, dispatched, query_expansion, rerank_top4, context_blocks, hit_report, question_answers, pipeline,
    )
}
