"""Chunks to a property graph: node and edge tables with set semantics.

Null keys join nothing; a chunk without a type has a node and no edges. Empty tables give empty tables,
repeated rows change no edge or entity. Columns that are not named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawstrata.functions.links import drop_query_and_fragment
from lawstrata.functions.text import CARD_KEYS, blank_to_null, strip

AMENDMENTS, SUMMARIES = ("Amendment", "Amendment_Split"), ("Summary", "Summary_Split")
#: Chunk types from which no entities are taken.
NO_ENTITIES = ("Document_Meta", "Summary", "Summary_Split", "Phần", "Chương", "Mục", "Preamble")
#: The kinds of entities and their labels.
LABELS = {"subjects": "Subject", "actions": "Action", "penalties": "Penalty"}
PROPERTIES = dict(zip(("loai_van_ban", "noi_ban_hanh", "nguoi_ky", "ngay_ban_hanh", "ngay_hieu_luc", "tinh_trang", "so_cong_bao", "ngay_cong_bao"), CARD_KEYS, strict=True))


def document_nodes(chunks: DataFrame) -> DataFrame:
    """doc_id, title, source_url and the metadata properties, from the first metadata card, else the first chunk."""
    first = F.struct((F.col("chunk_type") != "Document_Meta").cast("int").alias("a"), F.coalesce("ord", F.lit(1 << 30)).alias("b"), "chunk_id")
    props = ["title", "source_url", *(F.element_at("metadata", k).alias(p) for p, k in PROPERTIES.items())]
    rows = chunks.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("title", "source_url", "metadata"), first).alias("r"))
    return rows.select("doc_id", "r.*").select("doc_id", *props)


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """chunk_id, chunk_type, doc_id, name (the first line), parent_chunk_id, bm_title, amended_link, content."""
    text = F.when(F.col("chunk_type").isin(*AMENDMENTS), F.col("content")).otherwise(F.coalesce("content_embed", "content"))
    return chunks.select("chunk_id", "chunk_type", "doc_id", strip(F.split(text, "\n")[0]).alias("name"), "parent_chunk_id", "bm_title", "amended_link", "content")


def _edges(df: DataFrame, src_label: str, src: Column, rel: str, dst_label: str, dst: Column) -> DataFrame:
    return df.select(F.lit(src_label).alias("src_label"), src.alias("src"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), dst.alias("dst"))


def amendment_edges(chunks: DataFrame) -> DataFrame:
    """Chunk HAS_AMENDMENT chunk: same document, the amendment's tip among the chunk's marks; an equi-join."""
    marks = chunks.select("doc_id", F.col("chunk_id").alias("src"), F.explode(F.array_distinct("amends")).alias("tip_id")).where("tip_id is not null and tip_id <> ''")
    tips = chunks.where(F.col("chunk_type").isin(*AMENDMENTS)).select("doc_id", "tip_id", F.col("chunk_id").alias("dst"))
    return _edges(marks.join(tips, ["doc_id", "tip_id"]), "Chunk", F.col("src"), "HAS_AMENDMENT", "Chunk", F.col("dst")).distinct()


def amended_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk AMENDS_DOCUMENT document: by link without query and fragment, whatever was loaded first."""
    links = chunks.where(F.col("chunk_type").isin(*AMENDMENTS)).select("chunk_id", drop_query_and_fragment(F.col("amended_link")).alias("source_url")).where("source_url <> ''")
    targets = documents.select("source_url", "doc_id").distinct()
    return _edges(links.join(targets, "source_url"), "Chunk", F.col("chunk_id"), "AMENDS_DOCUMENT", "Document", F.col("doc_id")).distinct()


def structure_edges(chunks: DataFrame) -> DataFrame:
    """HAS_METADATA, HAS_SUMMARY and CONTAINS; a parent that is no chunk of the document gives no edge."""
    c = chunks.where(~F.col("chunk_type").isin(*AMENDMENTS) & F.col("chunk_id").isNotNull()).select("chunk_type", "doc_id", "parent_chunk_id", "chunk_id")
    rel = F.when(F.col("chunk_type") == "Document_Meta", "HAS_METADATA").when(F.col("chunk_type").isin(*SUMMARIES), "HAS_SUMMARY").otherwise("CONTAINS")
    c = c.withColumn("rel", rel)
    own = c.where((F.col("rel") != "CONTAINS") | (F.col("parent_chunk_id") == F.col("doc_id")))
    own = own.select(F.lit("Document").alias("src_label"), F.col("doc_id").alias("src"), "rel", F.lit("Chunk").alias("dst_label"), F.col("chunk_id").alias("dst"))
    inner = c.where((F.col("rel") == "CONTAINS") & (F.col("parent_chunk_id") != F.col("doc_id"))).select("doc_id", "parent_chunk_id", "chunk_id")
    parents = chunks.select("doc_id", F.col("chunk_id").alias("parent_chunk_id")).distinct()
    inner = _edges(inner.join(parents, ["doc_id", "parent_chunk_id"]), "Chunk", F.col("parent_chunk_id"), "CONTAINS", "Chunk", F.col("chunk_id"))
    return own.union(inner).distinct()


def entity_targets(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): amendments, and leaves of the types that entities are taken from."""
    parents = chunks.where("parent_chunk_id is not null and parent_chunk_id <> ''").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()
    amended = F.col("chunk_type").isin(*AMENDMENTS)
    leaves = chunks.where(~amended & ~F.col("chunk_type").isin(*NO_ENTITIES)).join(parents, "chunk_id", "left_anti")
    return chunks.where(amended).select("chunk_id", F.col("content").alias("text")).union(leaves.select("chunk_id", F.coalesce("content_embed", "content").alias("text"))).distinct()


#: The phrases by which the built-in matcher tells entities in the law texts.
PENALTY = r"((?:Phạt tiền|phạt tiền) từ [0-9.]+ đến [0-9.]+ đồng)"
SUBJECT = r"(?:đối với|do|cùng) ((?:người|chủ|cơ quan|cơ sở|đơn vị|tổ chức|trung tâm|đội|ban|bên|hợp tác xã|phòng|trạm|nhà thầu|cán bộ|trưởng ca)[\p{L} ]{0,24}?)(?: (?:xe|thực hiện|phải|không|của|tại)|[,.;]|\z)"
ACTION = r"(?:phải|được) ((?:[\p{Ll}]+ ){1,4}[\p{Ll}]+)(?:[ ,.;]|\z)"


def extract_entities(targets: DataFrame) -> DataFrame:
    """(chunk_id, entities json, error): the default extractor, by phrases; a model may stand in for it."""
    found = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), 1))
    body = F.struct(found(SUBJECT).alias("subjects"), found(ACTION).alias("actions"), found(PENALTY).alias("penalties"))
    return targets.select("chunk_id", F.to_json(body).alias("entities"), F.lit(None).cast("string").alias("error"))


def clean_reply(reply: Column) -> Column:
    """A model's reply as JSON: thoughts and code fences dropped."""
    x = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(x, r"```(?:json)?", ""))


def unpivot_entities(replies: DataFrame, labels: dict[str, str] | None = LABELS) -> DataFrame:
    """(chunk_id, label, name), distinct: items of the reply's arrays; values that are no arrays, blank items and
    replies that are no object give no rows. ``labels`` maps the allowed kinds; None derives a label from any
    kind by the literal rule (capitalised, without its last letter)."""
    parsed = F.from_json(clean_reply(F.col("entities")), "map<string,string>")
    rows = replies.select("chunk_id", F.explode(parsed).alias("kind", "items"))
    rows = rows.select("chunk_id", "kind", F.explode(F.from_json("items", "array<string>")).alias("name"))
    rows = rows.select("chunk_id", "kind", blank_to_null(F.col("name")).alias("name")).where("name is not null")
    if labels is None:
        label = F.concat(F.upper(F.substring("kind", 1, 1)), F.lower(F.expr("substring(kind, 2, length(kind) - 2)")))
    else:
        label = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col("kind")]
    return rows.withColumn("label", label).where("label is not null").select("chunk_id", "label", "name").distinct()


def mention_edges(entities: DataFrame) -> DataFrame:
    return entities.select(F.lit("Chunk").alias("src_label"), F.col("chunk_id").alias("src"), F.lit("MENTIONS").alias("rel"), F.col("label").alias("dst_label"), F.col("name").alias("dst")).distinct()


def entity_nodes(entities: DataFrame) -> DataFrame:
    return entities.select("label", "name").distinct()


def dispatch(targets: DataFrame, endpoints: int) -> DataFrame:
    """Each target's endpoint, spread evenly and the same on every run."""
    number = F.conv(F.substring(F.md5("chunk_id"), 1, 8), 16, 10).cast("bigint")
    return targets.withColumn("endpoint", F.pmod(number, F.lit(endpoints)).cast("int")).repartition(endpoints, "endpoint")
