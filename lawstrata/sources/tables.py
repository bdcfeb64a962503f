"""Table readers: Parquet, JSON with a fixed schema, CSV of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lawstrata.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder; a file or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


DOCUMENT = (
    "source_url string, title string, metadata map<string,string>, summary_content string, mucluc array<struct<title:string,href:string>>, main_content string, "
    "amendments array<struct<tip_id:string,anchor_text:string,bm_title:string,original_content:string,amended_content:string,amended_link:string>>, "
    "lienquan_hieuluc_list array<struct<number:string,lawid:string,title:string,href:string,attributes:map<string,string>>>, "
    "related_noidung_list array<struct<number:string,lawid:string,title:string,href:string,attributes:map<string,string>>>, "
    "luoc_do_list map<string,array<struct<title:string,href:string,metadata:map<string,string>>>>"
)
CHUNK = (
    "chunk_id string, chunk_type string, doc_id string, source_url string, title string, metadata map<string,string>, parent_chunk_id string, content string, "
    "content_embed string, anchors array<string>, amends array<string>, tip_id string, bm_title string, amended_link string, ord int"
)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """The column ``url`` of a CSV with a header, blank ones left out."""
    ship(spark)
    return spark.read.csv(path, header=True, schema=None, multiLine=False).select("url").where("trim(url) <> ''")


def json_records(spark: SparkSession, paths: list[str], schema: str, arrays: bool = False) -> DataFrame:
    """JSON files below several folders, at any depth, read with a fixed schema.

    ``arrays``: each file is one JSON array (or object) over many lines; else one object to a line.
    Broken records are left out; empty arrays give no rows.
    """
    ship(spark)
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "DROPMALFORMED")
    return reader.option("multiLine", arrays).json(paths)


def pages_to_visit(spark: SparkSession, first: int, last: int, pattern: str) -> DataFrame:
    """Listing pages by number; ``pattern`` holds ``{}``."""
    from pyspark.sql import functions as F

    before, _, after = pattern.partition("{}")
    return spark.range(first, last + 1).select(F.concat(F.lit(before), F.col("id").cast("string"), F.lit(after)).alias("url"))
