"""Queries of the operators for training data, and their SQL where SQL can say them on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawstrata.llm import sql
from lawstrata.llm.knn import most_similar
from lawstrata.llm.markup import clean_texts, find_notations
from lawstrata.llm.mixing import BLOCK, mix_sources
from lawstrata.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from lawstrata.llm.packing import fill_report, pack_texts, validity_report
from lawstrata.llm.spam import judged_pages, page_curves, spam_pages
from lawstrata.session import Scratch
from lawstrata.sources.tables import table


#: Share of the true neighbours that p5_found asks for.
RECALL = 0.985


def _provisions(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of problem 1: chunks but for metadata cards, and amendments with new wording."""
    chunk = table(spark, folder, "chunk").where("chunk_type is null or chunk_type <> 'Document_Meta'").select(F.lit("chunk").alias("table_name"), F.trim("chunk_id").alias("key"), F.col("content").alias("text"), "loaded_at")
    amendment = table(spark, folder, "amendment").where("amended_content is not null").select(F.lit("amendment").alias("table_name"), F.trim("amend_key").alias("key"), F.col("amended_content").alias("text"), "loaded_at")
    return chunk.union(amendment)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of keys whose texts carry one provision: three-word shingles, similarity 0.6, 60 words or more."""
    c = F.col
    pairs = near_duplicate_pairs(_provisions(spark, folder), c("key"), c("text"), c("loaded_at"), c("table_name"), spell_out=None, threshold=0.6, shingle=3, least_words=60)
    return pairs.withColumnRenamed("grp", "table_name")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """For each text of problem 1 the group that carries its provision."""
    c = F.col
    groups = near_duplicate_groups(_provisions(spark, folder), c("key"), c("text"), c("loaded_at"), c("table_name"), threshold=0.6, shingle=3, least_words=60)
    return groups.withColumnRenamed("grp", "table_name")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Which chunk holds which notation in which field; amendment markers belong in content."""
    c = F.col
    found = find_notations(table(spark, folder, "chunk"), c("chunk_id"), {"content": c("content"), "content_embed": c("content_embed")}, c("loaded_at"), allowed={"content": ("amendment",)})
    return found.withColumnRenamed("id", "chunk_id")


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Clean text of both fields of every row of chunk."""
    c = F.col
    return clean_texts(table(spark, folder, "chunk"), c("chunk_id"), {"content": c("content"), "content_embed": c("content_embed")}).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of points with cosine 0.80 or more, one among the other's five most similar."""
    near = most_similar(table(spark, folder, "vector_point"), "point_id", "vector", 5, "loaded_at", 96, min_cosine=0.80, recall=RECALL)
    return near.select(F.least("id", "neighbour").alias("point_a"), F.greatest("id", "neighbour").alias("point_b")).distinct()


def _neighbours(spark: SparkSession, folder: str, asks: Column | None) -> DataFrame:
    near = most_similar(table(spark, folder, "vector_point"), "point_id", "vector", 5, "loaded_at", 96, queries=asks)
    return near.select(F.col("id").alias("point_id"), "neighbour", F.col("rank").alias("neighbour_rank"), F.round("cosine", 3).alias("cosine"))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar points of every point, whatever their cosine."""
    return _neighbours(spark, folder, None)


def p5_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar among all points, whatever their cosine, of the points whose id is divisible by 20.

    An id counts by its first eight hexadecimal digits.
    """
    return _neighbours(spark, folder, F.conv(F.substring("point_id", 1, 8), 16, 10).cast("bigint") % 20 == 0)


def p7_bins(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, for each capacity."""
    packed = pack_texts(table(spark, folder, "documents"), "doc_id", F.col("text"), table(spark, folder, "pack_capacity"))
    return packed.withColumnRenamed("id", "doc_id")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return Scratch(spark, "packed").cut(p7_bins(spark, folder).withColumnRenamed("doc_id", "id"), "bins")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, and how alike the texts in them."""
    return fill_report(_packed(spark, folder), table(spark, folder, "pack_capacity"))


def p7_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every text is packed whole, once, and no container is overfull."""
    return validity_report(_packed(spark, folder), table(spark, folder, "pack_capacity"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return mix_sources(table(spark, folder, "documents"), "doc_id", F.col("text"), F.col("source"), table(spark, folder, "mix_target"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix, their repeats, and their source's actual share."""
    chosen, shares, _ = _mixed(spark, folder)
    return chosen.withColumnRenamed("id", "doc_id").join(shares.select("mix_name", "source", "target_share", "actual_share"), ["mix_name", "source"])


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return _mixed(spark, folder)[1]


def p8_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each mix as a sequence of blocks."""
    return _mixed(spark, folder)[2]


def p8_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source of a mix that has tokens takes its share and no document is repeated beyond the cap.

    A share may be off by two blocks and, as a source's last block may be short, by one for each pass through the source.
    """
    chosen, shares, _ = _mixed(spark, folder)
    most = chosen.groupBy("mix_name", "source").agg(F.max("repeats").alias("most"))
    usable = (F.col("tokens_available") > 0) & (F.col("target_share") > 0) & (F.coalesce("max_repeats", F.lit(1)) >= 1)
    of = lambda c: F.sum(F.when(F.col("usable"), F.col(c))).over(Window.partitionBy("mix_name"))
    s = shares.withColumn("usable", usable).withColumn("goal", F.col("target_share") / of("target_share")).withColumn("total", of("tokens_used")).join(most, ["mix_name", "source"], "left")
    near = F.abs(F.col("tokens_used") - F.col("goal") * F.col("total")) <= (2 + F.ceil(F.col("tokens_used") / F.col("tokens_available"))) * BLOCK + 2e-6 * F.col("total")
    right = F.when(F.col("usable"), near).otherwise(F.col("tokens_used") == 0)
    return s.select("mix_name", "source", "usable", right.alias("share_right"), (F.coalesce("most", F.lit(0)) <= F.coalesce("max_repeats", F.lit(2**31 - 1))).alias("cap_kept"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are mostly stuffed keywords, link lists, or product and tag lists."""
    return spam_pages(table(spark, folder, "documents"), "doc_id", F.col("text"), F.col("lang")).withColumnRenamed("id", "doc_id")


def p9_curves(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each page lies in passages with an extreme rank-frequency curve."""
    pages = judged_pages(table(spark, folder, "documents"), "doc_id", F.col("text"), F.col("lang"))
    return pages.select(F.col("id").alias("doc_id"), "n_words", "n_passages", "n_extreme", F.round("share", 4).alias("share"), "found")


def p9_fits(spark: SparkSession, folder: str) -> DataFrame:
    """Slope, residual and divergence of each passage's rank-frequency curve."""
    fits = page_curves(table(spark, folder, "documents"), "doc_id", F.col("text"), F.col("lang"))
    values = (F.round(c, 4).alias(c) for c in ("slope", "residual", "divergence"))
    return fits.select(F.col("id").alias("doc_id"), "part", "n_words", "prose", *values)


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p4_found, p4_clean, p5_found, p5_neighbours, p5_search, p7_bins, p7_fill, p7_valid, p8_mix, p8_shares, p8_blocks, p8_valid, p9_found, p9_curves, p9_fits)}
SQL = sql.SQL
