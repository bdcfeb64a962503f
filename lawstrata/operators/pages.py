"""HTML pages to document records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawstrata.functions.html import page_fields
from lawstrata.functions.text import doc_key

PAIRS = "array<struct<key string, value string>>"
RELATED = f"array<struct<number string, lawid string, title string, href string, attributes {PAIRS}>>"
FIELDS = (
    f"title string, metadata {PAIRS}, summary_content string, mucluc array<struct<title string, href string>>, main_content string, "
    "amendments array<struct<tip_id string, anchor_text string, bm_title string, original_content string, amended_content string, amended_link string>>, "
    f"lienquan_hieuluc_list {RELATED}, related_noidung_list {RELATED}, luoc_do_list array<struct<category string, documents array<struct<title string, href string, metadata {PAIRS}>>>>"
)
#: A page of an ended session, and what an acceptable tab without documents says.
ENDED_KEY, ENDED_VALUE, NO_DOCUMENTS, LEAST_LENGTH = "Tình trạng", "Đã biết", "Không có văn bản", 500


def accepted_page(html: Column) -> Column:
    """A tab's page counts if it is long enough or says that it has no documents."""
    return (F.length(html) > LEAST_LENGTH) | F.contains(html, F.lit(NO_DOCUMENTS))


def _parse(base: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [page_fields(*(None if pd.isna(x) else x for x in r), base) for r in pdf[["main_html", "luocdo_html", "hl_html", "nd_html"]].itertuples(index=False)]
            out = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in ("title", "metadata", "summary_content", "mucluc", "main_content", "amendments", "lienquan_hieuluc_list", "related_noidung_list", "luoc_do_list")])
            out.insert(0, "source_url", pdf["source_url"].to_numpy())
            yield out

    return run


def to_map(pairs: Column) -> Column:
    """Pairs to a map; of repeated keys the later wins."""
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def parse_pages(pages: DataFrame, base: str) -> DataFrame:
    """One document record for each page: source_url, doc_id and FIELDS, metadata as a map.

    ``pages``: source_url, main_html, and luocdo_html, hl_html, nd_html where known. Null or empty pages,
    and tabs that ``accepted_page`` rejects, give empty fields. Broken markup is read as far as it goes.
    """
    none = F.lit(None).cast("string")
    tab = lambda c: (F.when(accepted_page(F.col(c)), F.col(c)) if c in pages.columns else none).alias(c)
    src = pages.select("source_url", "main_html", tab("luocdo_html"), tab("hl_html"), tab("nd_html"))
    out = src.mapInPandas(_parse(base), f"source_url string, {FIELDS}")
    return out.withColumn("metadata", to_map(F.col("metadata"))).withColumn("doc_id", doc_key(F.col("source_url")))


def split_ended(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of pages of an ended session, which are rejected, apart from the others."""
    ended = F.coalesce(F.col("metadata")[ENDED_KEY] == ENDED_VALUE, F.lit(False))
    return docs.where(~ended), docs.where(ended)
