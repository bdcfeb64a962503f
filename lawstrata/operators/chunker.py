"""Documents to hierarchical, token-bounded chunks with stable ids and parent links.

Segments are cut at anchors, classified, and given their place by forward-filling windows; articles,
clauses and points are packed by ``greedy_bins``. Documents are independent but for their size: what
belongs together in a document is a run between two barriers, and runs are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawstrata.functions import text as t
from lawstrata.functions.plugins import tokenizer
from lawstrata.operators.pack import greedy_bins, measured_bins, ordered, union_of
from lawstrata.session import Scratch

LIMIT, LIMIT_AMENDMENT, LEAST = 768, 1024, 10
COLUMNS = ("chunk_id", "chunk_type", "doc_id", "source_url", "title", "metadata", "parent_chunk_id", "content", "content_embed", "anchors", "amends", "tip_id", "bm_title", "amended_link", "ord")
#: Where a chunk stands in its document: part of the document, segment, clause, point.
PLACE = ("at0", "at1", "at2", "at3")
Size = Callable[[Column], Column]
Count = Callable[[str], int]


def _at(*places: Column | int) -> list[Column]:
    """The PLACE columns."""
    full = [*places, *[0] * (len(PLACE) - len(places))]
    return [(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(n) for n, x in zip(PLACE, full, strict=True)]


def _packed(parts: DataFrame, keys: list[str], limit: int, size: Size, count: Count | None, sep: str, first: str | None = None, later: str | None = None, tidied: bool = False) -> DataFrame:
    """Parts (``pos2``, ``part``) packed with their headers; by sums of sizes, or with ``count`` by measuring the joined text."""
    if count is not None:
        return measured_bins(parts, keys, "pos2", "part", limit, sep, count, first, later, t.tidy_text if tidied else str)
    room = lambda c: F.greatest(F.lit(limit) - (size(F.col(c)) if c else F.lit(0)), F.lit(0))
    parts = parts.withColumns({"room": room(first), "room2": room(later or first)})
    own = t.tidy(F.col("part")) if tidied else F.col("part")
    return greedy_bins(parts, keys, "pos2", size(own), limit, room="room", later="room2")


def segments(docs: DataFrame, least: int = LEAST, starred: bool = True, size: Size = t.tokens) -> DataFrame:
    """One row for each segment of ``main_content`` with at least ``least`` tokens.

    doc_id, title, pos, seg_id, raw (without anchors), clean, anchors, amends, n_tokens, kind. ``pos``
    counts dropped segments too. A document without text has no segments.
    """
    s = docs.select("doc_id", t.strip_emphasis(F.coalesce("title", F.lit(""))).alias("title"), F.posexplode(F.filter(F.split("main_content", r"(?=\[\[ANCHOR:[^\]]+\]\])"), lambda x: x != "")).alias("pos", "seg"))
    s = s.withColumn("seg", t.strip_emphasis(t.strip(F.col("seg"))))
    s = s.select("doc_id", "title", "pos", t.drop_markers(F.col("seg"), "ANCHOR").alias("raw"), t.tidy(F.col("seg")).alias("clean"), t.marker_ids(F.col("seg"), "ANCHOR").alias("anchors"), t.marker_ids(F.col("seg"), "AMENDMENT").alias("amends"))
    s = s.withColumn("n_tokens", size(F.col("clean"))).where((F.col("clean") != "") & (F.col("n_tokens") >= least))
    name = F.coalesce(F.try_element_at("anchors", F.lit(1)), F.concat(F.lit("seg_"), F.col("pos").cast("string")))
    return s.withColumn("seg_id", F.concat("doc_id", F.lit("_"), name)).withColumn("kind", t.heading_kind(t.bare(F.col("clean")), starred))


def with_hierarchy(s: DataFrame) -> DataFrame:
    """Adds part, chapter and section in force at each segment (the document's id before any)."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda *kinds: F.coalesce(F.last(F.when(F.col("kind").isin(*kinds), F.col("seg_id")), ignorenulls=True).over(w), F.col("doc_id"))
    return s.select("*", last("Phần").alias("part"), last("Phần", "Chương").alias("chapter"), last("Phần", "Chương", "Mục").alias("section"))


def _merged(df: DataFrame, keys: list[str], order: str, chunk_type: str, sep: str, head: Column) -> DataFrame:
    """Bins of items (item_id, parent, text, anchors, amends) to chunks."""
    out = df.groupBy(*keys, "bin").agg(
        F.min(order).alias("o"), F.count("*").alias("n"), F.min_by("item_id", order).alias("first"), F.min_by("parent", order).alias("parent_chunk_id"),
        ordered("text", order, sep).alias("content"), union_of("anchors").alias("anchors"), union_of("amends").alias("amends"), F.first("head").alias("head"),
        *(F.min_by(c, order).alias(c) for c in PLACE),
    )
    return out.select(
        F.concat("first", F.when(F.col("n") > 1, "_gop").otherwise("")).alias("chunk_id"), F.lit(chunk_type).alias("chunk_type"), "doc_id", "parent_chunk_id", "content",
        t.embed_text(F.concat(head, "content")).alias("content_embed"), "anchors", "amends", *PLACE,
    )


def article_bins(s: DataFrame, limit: int) -> DataFrame:
    """Small articles with the bin they are packed in; headings and oversized articles are barriers."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    barrier = F.sum(F.when(F.col("kind").isin(*t.HEADINGS) | ((F.col("kind") == t.ARTICLE) & (F.col("n_tokens") > limit)), 1).otherwise(0)).over(w)
    small = s.withColumn("barrier", barrier).where((F.col("kind") == t.ARTICLE) & (F.col("n_tokens") <= limit))
    return greedy_bins(small, ["doc_id", "barrier"], "pos", F.col("n_tokens"), limit)


def body_chunks(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, starred: bool = True, size: Size = t.tokens, scratch: Scratch | None = None, count: Count | None = None) -> DataFrame:
    """Chunks of ``main_content``: headings, packed articles, and what oversized articles fall into."""
    # every branch below reads the segments: they are computed once
    scratch = scratch or Scratch(docs.sparkSession, "chunks")
    s = scratch.cut(with_hierarchy(segments(docs, least, starred, size)), "segments")
    none = F.lit(None).cast("string")
    head = F.concat(F.lit(t.DOCUMENT_HEAD), "title", F.lit("\n\n" + t.WITHIN_HEAD))
    above = F.when(F.col("kind") == "Phần", F.col("doc_id")).otherwise(F.col("up"))
    # a heading's parent is what was in force one level up
    up = F.when(F.col("kind") == "Chương", F.col("part")).when(F.col("kind") == "Mục", F.col("chapter"))
    headings = s.where(F.col("kind").isin(*t.HEADINGS)).withColumn("up", up)
    out = [headings.select(F.col("seg_id").alias("chunk_id"), F.col("kind").alias("chunk_type"), "doc_id", above.alias("parent_chunk_id"), F.col("clean").alias("content"), none.alias("content_embed"), "anchors", "amends", *_at(2, F.col("pos")))]
    bins = article_bins(s, limit).withColumns({"item_id": F.col("seg_id"), "parent": F.col("section"), "text": F.col("clean"), "head": head}).select("*", *_at(2, F.col("pos")))
    out.append(_merged(bins, ["doc_id", "barrier"], "pos", "Điều", "\n\n", F.col("head")))
    large = s.where((F.col("kind") == t.ARTICLE) & (F.col("n_tokens") > limit)).withColumn("parts", t.split_clauses(F.col("raw")))
    by_clause = large.where(F.size("parts") > 1).withColumn("lead", t.tidy(F.col("parts")[0]))
    out.append(by_clause.select(F.col("seg_id").alias("chunk_id"), F.lit("Điều").alias("chunk_type"), "doc_id", F.col("section").alias("parent_chunk_id"), F.col("lead").alias("content"), none.alias("content_embed"), "anchors", t.marker_ids(F.col("parts")[0], "AMENDMENT").alias("amends"), *_at(2, F.col("pos"))))
    c = by_clause.select("doc_id", "pos", "seg_id", "anchors", F.concat(head, "lead", F.lit("\n\n")).alias("head"), F.posexplode("parts").alias("j", "raw")).where("j > 0")
    c = c.select("doc_id", "pos", "seg_id", "anchors", "head", "j", "raw", t.tidy(F.col("raw")).alias("text"), t.marker_ids(F.col("raw"), "AMENDMENT").alias("amends"))
    c = c.withColumn("n", size(F.col("text"))).withColumn("item_id", F.concat("seg_id", F.lit("_k"), F.col("j").cast("string")))
    fence = F.sum(F.when(F.col("n") > limit, 1).otherwise(0)).over(Window.partitionBy("doc_id", "seg_id").orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("barrier", fence).withColumn("parent", F.col("seg_id")).select("*", *_at(2, F.col("pos"), F.col("j")))
    small = greedy_bins(c.where(F.col("n") <= limit), ["doc_id", "seg_id", "barrier"], "j", F.col("n"), limit)
    out.append(_merged(small, ["doc_id", "seg_id", "barrier"], "j", "Khoản", "\n\n", F.col("head")))
    big = c.where(F.col("n") > limit).withColumn("points", t.split_points(F.col("raw")))
    many = F.size("points") > 1
    big = big.withColumn("lead2", F.when(many, t.tidy(F.col("points")[0])).otherwise("")).withColumn("amends2", F.when(many, t.marker_ids(F.col("points")[0], "AMENDMENT")).otherwise(F.array().cast("array<string>")))
    out.append(big.select(F.col("item_id").alias("chunk_id"), F.lit("Khoản").alias("chunk_type"), "doc_id", F.col("seg_id").alias("parent_chunk_id"), F.col("lead2").alias("content"), none.alias("content_embed"), "anchors", F.col("amends2").alias("amends"), *PLACE))
    p = big.select("doc_id", "pos", "j", F.col("item_id").alias("parent"), "anchors", F.concat("head", "lead2", F.lit("\n\n")).alias("head"), F.posexplode(F.when(many, F.slice("points", F.lit(2), F.size("points") - 1)).otherwise(F.col("points"))).alias("k", "raw"))
    p = p.select("doc_id", "parent", "anchors", "head", "k", *_at(2, F.col("pos"), F.col("j"), F.col("k") + 1), t.tidy(F.col("raw")).alias("text"), t.marker_ids(F.col("raw"), "AMENDMENT").alias("amends"))
    p = p.withColumn("n", size(F.col("text"))).withColumn("item_id", F.concat("parent", F.lit("_d"), F.col("k").cast("string")))
    fence = F.sum(F.when(F.col("n") > limit, 1).otherwise(0)).over(Window.partitionBy("doc_id", "parent").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    # an oversized point closes the bin before it and stands alone
    p = p.withColumn("barrier", 2 * fence + F.when(F.col("n") > limit, 0).otherwise(1))
    packed = greedy_bins(p, ["doc_id", "parent", "barrier"], "k", F.col("n"), limit).withColumn("own", F.col("parent"))
    out.append(_merged(packed, ["doc_id", "own", "barrier"], "k", "Điểm", "\n", F.col("head")))
    for kind, df, suffix in (("Điều_Split", large.where(F.size("parts") <= 1), "_part"), ("Preamble", s.where(F.col("kind") == "other"), "_p")):
        parts = df.select("doc_id", "pos", "seg_id", "section", "anchors", F.posexplode(t.split_paragraphs(F.col("raw"))).alias("pos2", "part"))
        parts = parts.where(t.strip(F.col("part")) != "")
        g = _packed(parts, ["doc_id", "seg_id"], limit, size, count, "\n\n", tidied=True)
        g = g.groupBy("doc_id", "pos", "seg_id", "bin").agg(F.first("section").alias("section"), F.first("anchors").alias("anchors"), ordered("part", "pos2", "\n\n").alias("joined"))
        out.append(g.select(F.concat("seg_id", F.lit(suffix), (F.col("bin") + 1).cast("string")).alias("chunk_id"), F.lit(kind).alias("chunk_type"), "doc_id", F.col("section").alias("parent_chunk_id"), t.tidy(F.col("joined")).alias("content"), none.alias("content_embed"), "anchors", t.marker_ids(F.col("joined"), "AMENDMENT").alias("amends"), *_at(2, F.col("pos"), F.col("bin") + 1)))
    return reduce(lambda a, b: a.unionByName(b), out)


def meta_chunks(docs: DataFrame) -> DataFrame:
    """The metadata card of each document."""
    card = t.metadata_card(t.strip_emphasis(F.coalesce("title", F.lit(""))), F.col("metadata"))
    return docs.select(F.concat(F.lit("meta_"), "doc_id").alias("chunk_id"), F.lit("Document_Meta").alias("chunk_type"), "doc_id", F.col("doc_id").alias("parent_chunk_id"), card.alias("content"), card.alias("content_embed"), *_at(0))


def summary_chunks(docs: DataFrame, limit: int = LIMIT, size: Size = t.tokens, count: Count | None = None) -> DataFrame:
    """The summary, whole or in parts whose text with the header keeps the limit."""
    head = F.concat(F.lit(t.SUMMARY_HEAD), t.strip_emphasis(F.coalesce("title", F.lit(""))), F.lit("\n\n"))
    s = docs.select("doc_id", head.alias("head"), t.blank_to_null(F.col("summary_content")).alias("summary")).where("summary is not null")
    s = s.withColumn("n", size(F.concat("head", "summary")))
    make = lambda df, i, kind, body, k: df.select(i.alias("chunk_id"), F.lit(kind).alias("chunk_type"), "doc_id", F.col("doc_id").alias("parent_chunk_id"), body.alias("content"), F.concat("head", body).alias("content_embed"), *_at(1, k))
    whole = make(s.where(F.col("n") <= limit), F.concat(F.lit("summary_"), "doc_id"), "Summary", F.col("summary"), 0)
    parts = s.where(F.col("n") > limit).select("doc_id", "head", F.posexplode(t.split_paragraphs(F.col("summary"))).alias("pos2", "part"))
    g = _packed(parts, ["doc_id"], limit, size, count, "\n\n", "head", "head").groupBy("doc_id", "head", "bin").agg(t.strip(ordered("part", "pos2", "\n\n")).alias("body"))
    return whole.unionByName(make(g, F.concat(F.lit("summary_"), "doc_id", F.lit("_part"), (F.col("bin") + 1).cast("string")), "Summary_Split", F.col("body"), F.col("bin")))


def amendment_chunks(docs: DataFrame, limit: int = LIMIT_AMENDMENT, size: Size = t.tokens, count: Count | None = None) -> DataFrame:
    """Chunks of the amendments; equal amendments of a document once, the first of them. Those without a tip are numbered among the rest."""
    a = docs.select("doc_id", F.posexplode("amendments").alias("pos", "a")).where("a is not null")
    first = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("a"), F.to_json("a")).orderBy("pos"))
    a = a.withColumn("r", first).where("r = 1").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    a = a.select(
        "doc_id", "nth", F.coalesce("a.tip_id", F.concat(F.lit("unknown_"), F.col("nth").cast("string"))).alias("tip_id"), t.strip(F.coalesce("a.bm_title", F.lit(""))).alias("bm_title"),
        t.strip_lead_in(t.strip(F.coalesce("a.amended_content", F.lit("")))).alias("body"), F.coalesce("a.amended_link", F.lit("")).alias("amended_link"),
    )
    head = F.concat(F.lit(t.AMENDMENT_HEAD + "\n"), "bm_title")
    a = a.withColumns({"first": F.concat(head, F.lit(f"\n\n{t.NEW_WORDING}:**\n")), "later": F.concat(head, F.lit(f"\n\n{t.NEW_WORDING}{t.CONTINUED}:**\n"))})
    a = a.withColumn("n", size(F.concat("first", "body")))
    name = F.concat(F.lit("amend_"), "doc_id", F.lit("_"), "tip_id")
    whole = a.where(F.col("n") <= limit).select(name.alias("chunk_id"), F.lit("Amendment").alias("chunk_type"), "doc_id", t.strip(F.concat("first", "body")).alias("content"), "tip_id", "bm_title", "amended_link", *_at(3, F.col("nth")))
    keys = ["doc_id", "nth"]
    kept = ["tip_id", "bm_title", "amended_link", "first", "later"]
    parts = a.where(F.col("n") > limit).select(*keys, *kept, F.posexplode(t.split_new_wording(F.col("body"))).alias("pos2", "part"))
    parts = parts.withColumn("part", t.strip(F.col("part"))).where("part <> ''")
    g = _packed(parts, keys, limit, size, count, "\n", "first", "later").groupBy(*keys, *kept, "bin").agg(ordered("part", "pos2", "\n").alias("body"))
    head = F.when(F.col("bin") > 0, F.col("later")).otherwise(F.col("first"))
    split = g.select(F.concat(name, F.lit("_part_"), (F.col("bin") + 1).cast("string")).alias("chunk_id"), F.lit("Amendment_Split").alias("chunk_type"), "doc_id", t.strip(F.concat(head, "body")).alias("content"), "tip_id", "bm_title", "amended_link", *_at(3, F.col("nth"), F.col("bin")))
    return whole.unionByName(split)


def chunk_documents(docs: DataFrame, limit: int = LIMIT, limit_amendment: int = LIMIT_AMENDMENT, least: int = LEAST, starred: bool = True, size: Size = t.tokens, count: Count | None = None) -> DataFrame:
    """COLUMNS: metadata card, summary, body and amendment chunks of every document.

    ``docs``: doc_id, title, metadata, summary_content, main_content, amendments, and source_url where
    known. Null or empty fields give no chunks of their kind, but the card. Every chunk has its document's
    source_url, title (without emphasis) and metadata; ``ord`` numbers a document's chunks from 0 in the
    order of the document. ``size`` is the tokenizer as a column expression by which sizes of joined texts
    are the sum of their parts'; ``count`` one of strings by which they need not be: paragraphs, parts of
    summaries and of amendments are then packed by measuring the joined text.
    """
    if count is not None:
        size = tokenizer(count)
    scratch = Scratch(docs.sparkSession, "chunks")
    url = F.col("source_url") if "source_url" in docs.columns else F.lit(None).cast("string").alias("source_url")
    docs = scratch.cut(docs.select("doc_id", "title", "metadata", "summary_content", "main_content", "amendments", url), "docs")
    out = meta_chunks(docs).unionByName(summary_chunks(docs, limit, size, count), allowMissingColumns=True)
    out = out.unionByName(body_chunks(docs, limit, least, starred, size, scratch, count), allowMissingColumns=True)
    out = out.unionByName(amendment_chunks(docs, limit_amendment, size, count), allowMissingColumns=True)
    out = out.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*PLACE, "chunk_id")) - 1).cast("int"))
    base = docs.select("doc_id", "source_url", t.strip_emphasis(F.col("title")).alias("title"), "metadata")
    return out.join(base, "doc_id").select(*COLUMNS)
