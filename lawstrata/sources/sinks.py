"""Sinks: bucketed JSON and Parquet, create-if-absent tables, upserts, skip-if-exists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawstrata.functions.text import url_hash
from lawstrata.operators.vectors import latest

BUCKET = "doc_bucket"


def pending(urls: DataFrame, done: DataFrame, url_col: str = "url", done_col: str = "url") -> DataFrame:
    """URLs whose hash is not among those done; each once."""
    u = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().withColumn("url_md5", url_hash(F.col("url")))
    d = done.select(url_hash(F.col(done_col)).alias("url_md5"))
    return u.join(d, "url_md5", "left_anti")


def write_bucketed(df: DataFrame, path: str, key: Column, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder for each first byte of the key's hash: many documents to a file, pruned by bucket when read."""
    df.withColumn(BUCKET, F.substring(F.md5(key), 1, 2)).repartition(BUCKET).write.mode(mode).partitionBy(BUCKET).format(fmt).save(path)


def create_if_absent(spark: SparkSession, name: str, like: DataFrame, dim: int | None = None, vector: str = "vector") -> None:
    """An empty table of the schema of ``like``, unless it exists; ``dim`` must be that of any vectors there."""
    if not spark.catalog.tableExists(name):
        like.limit(0).write.saveAsTable(name)
    elif dim is not None and spark.table(name).where(F.size(vector) != dim).limit(1).count():
        raise ValueError(f"{name} holds vectors of another dimension than {dim}")


def upserted(current: DataFrame, arriving: DataFrame, key: str, order: Column) -> DataFrame:
    """``current`` with the arriving rows: the last write of each key wins, and arriving ones over those there."""
    new = latest(arriving, key, order)
    return current.join(new.select(key), key, "left_anti").unionByName(new)


#: Buckets of a table that is kept by upserts, and versions of a bucket that stay.
BUCKETS, KEPT = 32, 2


def _versions(spark: SparkSession, target: str, below: int | None = None) -> dict[int, list[int]]:
    """By bucket, the numbers of its whole versions, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for version in fs.listStatus(root) if fs.exists(root) else ():
        m = re.fullmatch(r"v=(\d+)", version.getPath().getName())
        if m and (below is None or int(m[1]) < below) and fs.exists(hadoop.Path(version.getPath(), "_SUCCESS")):
            for bucket in fs.listStatus(version.getPath()):
                if b := re.fullmatch(r"bucket=(\d+)", bucket.getPath().getName()):
                    found.setdefault(int(b[1]), []).append(int(m[1]))
    return {b: sorted(v) for b, v in found.items()}


def _folder(target: str, version: int, bucket: int) -> str:
    return f"{target}/v={version:09d}/bucket={bucket}"


def next_version(spark: SparkSession, target: str) -> int:
    return 1 + max((v[-1] for v in _versions(spark, target).values()), default=-1)


def merge_buckets(arriving: DataFrame, target: str, keys: list[str], order: Column, version: int, buckets: int = BUCKETS) -> None:
    """Merges rows into a table of buckets below ``target``: of each key the arriving row with the greatest ``order`` replaces the one there.

    Only buckets that an arriving key falls into are read and written, as ``version``; of each bucket the
    two newest versions stay. Written again after a failure, a version is the same. A table keeps its
    number of buckets. Rows with a null in a key are kept like others.
    """
    spark = arriving.sparkSession
    names = [c for c in arriving.columns if c not in keys]
    hashed = [c for c in names if "map<" not in arriving.schema[c].dataType.simpleString()]
    if names:
        best = arriving.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(order, F.xxhash64(F.lit(0), *hashed))).alias("r"))
        new = best.select(*keys, *(F.col(f"r.`{n}`").alias(n) for n in names))
    else:
        new = arriving.distinct()
    new = new.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
        have = _versions(spark, target, version)
        paths = [_folder(target, have[b][-1], b) for b in touched if b in have]
        out = new
        if paths:
            same = None
            old = spark.read.schema(new.drop("bucket").schema).parquet(*paths)
            taken = new.select(*(F.col(k).alias(f"__{k}") for k in keys))
            for k in keys:
                c = F.col(k).eqNullSafe(F.col(f"__{k}"))
                same = c if same is None else same & c
            kept = old.join(taken, same, "left_anti").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            out = kept.unionByName(new)
        out.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={version:09d}")
    finally:
        new.unpersist()
    hadoop = spark._jvm.org.apache.hadoop.fs
    for b in touched:
        for v in have.get(b, [])[: 1 - KEPT]:
            path = hadoop.Path(_folder(target, v, b))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_buckets(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest version of every bucket; None where there is no table."""
    have = _versions(spark, target)
    return spark.read.parquet(*(_folder(target, v[-1], b) for b, v in sorted(have.items()))) if have else None


def merge_graph(nodes: DataFrame, edges: DataFrame, path: str, key: list[str], order: Column) -> None:
    """Merges nodes and edges into the graph below ``path``: nodes by key, a later write replaces the properties of
    one that is there; edges as a set. Merging the same rows again changes nothing. ``read_buckets`` reads both
    tables, ``path``/nodes and ``path``/edges."""
    spark = nodes.sparkSession
    merge_buckets(nodes, f"{path}/nodes", key, order, next_version(spark, f"{path}/nodes"))
    merge_buckets(edges, f"{path}/edges", edges.columns, F.lit(0), next_version(spark, f"{path}/edges"))
