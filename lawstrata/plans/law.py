"""Queries over the law tables: hierarchies, orphan references, nested records (problems 2, 3 and 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawstrata.functions.links import compared_link
from lawstrata.functions.text import norm_id, strip
from lawstrata.operators.hierarchy import current_rows, descendants, resolve_hierarchy
from lawstrata.operators.nested import flatten_records, routed_tables
from lawstrata.operators.orphans import count_orphans, find_orphans
from lawstrata.session import Scratch
from lawstrata.sources.tables import table

SITE = "https://vanban.example"


def _us(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def _pair(doc: Column, tip: Column) -> Column:
    """The compared form of (document, tip); null if one of them is."""
    return F.concat(norm_id(doc), F.lit("\n"), norm_id(tip))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth and state of every chunk."""
    found = resolve_hierarchy(table(spark, folder, "chunk"), "chunk_id", "parent_chunk_id", "loaded_at", "doc_id", with_intervals=False)
    return found.select(F.col("id").alias("chunk_id"), "root_id", "node_depth", "node_state")


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path, depth, root, number of descendants and the interval that holds them, of every chunk."""
    found = resolve_hierarchy(table(spark, folder, "chunk"), "chunk_id", "parent_chunk_id", "loaded_at", "doc_id", with_paths=True)
    return found.select(F.col("id").alias("chunk_id"), "root_id", "node_depth", "node_state", "path", "n_descendants", "pre", "last")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with each of its descendants."""
    return descendants(table(spark, folder, "chunk"), "chunk_id", "parent_chunk_id", "loaded_at", "doc_id").select(F.col("ancestor").alias("chunk_id"), F.col("id").alias("descendant_id"), "distance")


def p3_rings(spark: SparkSession, folder: str) -> DataFrame:
    """The links of every ring; the back edge is the one that leads from the ring's last chunk to its root again."""
    chunk = table(spark, folder, "chunk")
    found = resolve_hierarchy(chunk, "chunk_id", "parent_chunk_id", "loaded_at", "doc_id", with_intervals=False)
    on = Scratch(spark, "rings").cut(found.where("node_state = 'cycle'").select("id", "root_id"), "on")
    parents = chunk.select(norm_id(F.col("chunk_id")).alias("id"), norm_id(F.col("parent_chunk_id")).alias("parent"), "loaded_at").join(on, "id")
    parents = current_rows(parents, ["id", "root_id"], "loaded_at", {"parent": F.col("parent")})
    size = on.groupBy("root_id").agg(F.count("*").alias("ring_size"))
    return parents.join(size, "root_id").select(F.col("id").alias("chunk_id"), F.col("parent").alias("parent_id"), "root_id", "ring_size", (F.col("id") == F.col("root_id")).alias("back_edge"))


def law_references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The references of problem 6 and their targets, in the form of ``find_orphans``."""
    chunk, amendment = table(spark, folder, "chunk"), table(spark, folder, "amendment")
    month = F.date_format("crawled_at", "yyyy-MM")
    rows = chunk.select(norm_id(F.col("chunk_id")).alias("id"), "chunk_id", "doc_id", "amends", "crawled_at", "loaded_at").where("id is not null")
    scratch = Scratch(spark, "references")
    marks = rows.where(F.size("amends") > 0)
    cur = marks.groupBy("id").agg(F.max(F.struct("loaded_at", "amends", "chunk_id", "doc_id", "crawled_at")).alias("r"))
    # a row without amends may be the current or the first one of its key
    times = rows.groupBy("id").agg(F.min("loaded_at").alias("first"), F.max("loaded_at").alias("newest"))
    cur = cur.join(times, "id").where(F.col("r.loaded_at") == F.col("newest"))
    amends = cur.select(
        F.lit("chunk.amends").alias("ref_field"), F.col("r.chunk_id").alias("row_key"), F.explode(F.array_distinct("r.amends")).alias("ref_value"),
        F.col("r.doc_id").alias("doc"), _us("first").alias("first_us"), F.date_format("r.crawled_at", "yyyy-MM").alias("ref_month"),
    ).select(F.lit("amendment").alias("relation"), _pair(F.col("doc"), F.col("ref_value")).alias("k"), "first_us", "ref_field", "row_key", "ref_value", "ref_month")
    a = amendment.withColumn("id", norm_id(F.col("amend_key"))).where("id is not null")
    fields = {c: F.col(c) for c in ("is_deleted", "amend_key", "doc_id", "tip_id", "amended_link", "crawled_at")}
    now = current_rows(a, ["id"], "loaded_at", fields).join(a.groupBy("id").agg(F.min("loaded_at").alias("first")), "id")
    now = scratch.cut(now.where(~F.coalesce("is_deleted", F.lit(False))), "now")
    own = {"first_us": _us("first"), "ref_month": month, "row_key": F.col("amend_key")}

    def refs(relation: str, field: str, value: Column, k: Column) -> DataFrame:
        return now.select(F.lit(relation).alias("relation"), k.alias("k"), own["first_us"].alias("first_us"), F.lit(field).alias("ref_field"), own["row_key"].alias("row_key"), value.alias("ref_value"), own["ref_month"].alias("ref_month"))

    tips = refs("mark", "amendment.tip_id", F.col("tip_id"), _pair(F.col("doc_id"), F.col("tip_id")))
    links = refs("page", "amendment.amended_link", F.col("amended_link"), compared_link(F.col("amended_link"), SITE))

    def keys(df: DataFrame, relation: str, k: Column, deleted: Column) -> DataFrame:
        t = df.select(k.alias("k"), F.col("loaded_at"), F.coalesce(deleted, F.lit(False)).alias("d")).where("k is not null")
        t = t.groupBy("k").agg(F.max(F.struct("loaded_at", "d")).alias("r"), F.min("loaded_at").alias("first"))
        return t.select(F.lit(relation).alias("relation"), "k", F.col("r.d").alias("deleted"), _us("first").alias("first_us"))

    held = marks.select("doc_id", "loaded_at", F.explode(F.array_distinct("amends")).alias("tip"))
    laws = table(spark, folder, "law_document").select("source_url", "loaded_at", "is_deleted")
    laws = laws.union(table(spark, folder, "base_law").select("source_url", "loaded_at", F.lit(False)))
    targets = keys(a, "amendment", _pair(F.col("doc_id"), F.col("tip_id")), F.col("is_deleted"))
    targets = targets.union(keys(held, "mark", _pair(F.col("doc_id"), F.col("tip")), F.lit(False)))
    targets = targets.union(keys(laws, "page", compared_link(F.col("source_url"), SITE), F.col("is_deleted")))
    return amends.union(tips).union(links), targets


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """References without a usable target."""
    return find_orphans(*law_references(spark, folder))


def p6_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per field, status and month."""
    return count_orphans(p6_found(spark, folder))


def p2_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All flat rows of the nested records with supertype keys, parent links and subtype; bodies that cannot be read too."""
    return flatten_records(table(spark, folder, "raw_record"), "record_id", "body")


def _subtypes(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return routed_tables(table(spark, folder, "raw_record"), "record_id", "body")


def p2_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata entries, and fields of entries that are objects."""
    t = _subtypes(spark, folder)
    none = F.lit(None).cast("string")
    return t["metadata_entry"].select("record_id", F.col("name").alias("entry"), none.alias("field")).union(t["metadata_field"].select("record_id", "entry", "name")).distinct()


def p2_amendments(spark: SparkSession, folder: str) -> DataFrame:
    """Amendments with a tip, and the tip they lie within."""
    return _subtypes(spark, folder)["amendment"].where("tip_id is not null").select("record_id", "tip_id", "within_tip").distinct()


def p2_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of amendments."""
    return _subtypes(spark, folder)["title"].select("record_id", "tip_id", "bm_title").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata entries, amendments and titles, each tied to its parent, from the subtype tables."""
    t = _subtypes(spark, folder)
    rows = lambda name, child, parent, key: t[name].select("record_id", F.lit(child).alias("child"), F.coalesce(parent, F.lit("")).alias("parent_key"), F.col(key).alias("child_key"))
    out = rows("metadata_entry", "metadata", F.lit(""), "name").union(rows("metadata_field", "metadata", F.col("entry"), "name"))
    return out.union(rows("amendment", "amendment", F.col("within_tip"), "tip_id").where("child_key is not null")).union(rows("title", "bm_title", F.col("tip_id"), "bm_title")).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_rows, p2_metadata, p2_amendments, p2_titles, p3_found, p3_paths, p3_descendants, p3_rings, p6_found, p6_by_month)}
__all__ = ["QUERIES", "law_references", "strip"]
