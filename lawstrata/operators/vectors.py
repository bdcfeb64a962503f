"""Vector points: what is embedded, how, under which id, and exact search for given queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawstrata.functions.text import point_key

AMENDMENTS = ("Amendment", "Amendment_Split")
BATCH, DIM = 16, 1024


def embeddable(chunks: DataFrame) -> DataFrame:
    """Chunks that are embedded, with the text that is: amendments by content, others by content_embed."""
    amended = F.col("chunk_type").isin(*AMENDMENTS)
    return chunks.where(amended | (F.length("content_embed") > 0)).withColumn("embed_text", F.when(amended, F.col("content")).otherwise(F.col("content_embed")))


def hashed_words(texts: list[str | None], dim: int) -> np.ndarray:
    """The default embedder: hashed bags of words, of unit length; zeros for a text without words."""
    import zlib

    out = np.zeros((len(texts), dim), np.float32)
    for k, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            out[k, (h >> 1) % dim] += 1.0 if h & 1 else -1.0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def embed(df: DataFrame, text_col: str, dim: int = DIM, embedder=hashed_words) -> DataFrame:
    """``df`` with a ``vector`` column; ``embedder(texts, dim)`` sees whole Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = embedder(b.column(text_col).to_pylist(), dim)
            yield b.append_column("vector", pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel(), pa.float32())))

    from pyspark.sql import types as T

    schema = T.StructType(list(df.schema.fields)).add("vector", T.ArrayType(T.FloatType()))
    return df.mapInArrow(run, schema)


def points(chunks: DataFrame, dim: int = DIM, embedder=hashed_words) -> DataFrame:
    """(point_id, vector, payload): one point for each embeddable chunk; payload is the row without content_embed."""
    src = embeddable(chunks)
    payload = [c for c in src.columns if c not in ("content_embed", "embed_text")]
    with_id = src.select(point_key(F.col("chunk_id")).alias("point_id"), F.struct(*payload).alias("payload"), "embed_text")
    return embed(with_id, "embed_text", dim, embedder).select("point_id", "vector", "payload")


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last write of each key wins; ties go to the greatest row by hash (maps, which have none, left out).

    The aggregate combines before the shuffle, so that a key with a third of the rows is no hot spot.
    """
    names = [c for c in df.columns if c != key]
    hashed = [c for c in names if "map<" not in df.schema[c].dataType.simpleString()]
    rows = df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(order, F.xxhash64(F.lit(0), *hashed))).alias("r"))
    return rows.select(key, *(F.col(f"r.`{n}`").alias(n) for n in names))


def nearest(base: DataFrame, queries: DataFrame, id_col: str, vector_col: str, query_id: str, query_vector: str, k: int, block_mb: int = 64) -> DataFrame:
    """(query id, id, cosine, rank): the k nearest of ``base`` for every query, exact.

    Queries go in blocks against all rows, block by block in a matrix product; each task keeps k per
    query, so that only those are shuffled. Null, empty and zero vectors, and vectors of another length
    than the queries', match nothing. Ties go to the lesser id.
    """
    spark = base.sparkSession
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("q is not null and size(v) > 0")
    # a block of queries is as large as a task may hold, so that the base travels as seldom as can be
    size = q.agg(F.sum(F.size("v") * 8).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // (block_mb << 20)))
    src = base.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("x")).where("i is not null and size(x) > 0")
    q = q.withColumn("blk", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))
    # a block of queries meets each slice of the base in one task
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    qs = q.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("blk", "s", F.lit(0).alias("side"), F.col("q").cast("string").alias("key"), F.col("v").alias("vec"))
    xs = src.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("blk", F.pmod(F.xxhash64("i"), F.lit(slices)).cast("int").alias("s"), F.lit(1).alias("side"), F.col("i").cast("string").alias("key"), F.col("x").alias("vec"))
    both = qs.union(xs).withColumn("cell", F.col("blk") * slices + F.col("s"))
    found = both.repartition(parts * slices, "cell").sortWithinPartitions("cell", "side").select("cell", "side", "key", "vec").mapInArrow(_nearest(k), "q string, i string, cosine double")
    q_type, i_type = queries.schema[query_id].dataType, base.schema[id_col].dataType
    found = found.select(F.col("q").cast(q_type).alias(query_id), F.col("i").cast(i_type).alias("__i"), "cosine")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("cosine"), "__i"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("__i", id_col)


def _rows_of(column: pa.Array, dim: int, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the rows s to e with ``dim`` numbers; a vector that is all zero or holds a null becomes NaN."""
    part = column.slice(s, e - s)
    lens = np.asarray(pc.fill_null(pc.list_value_length(part), -1))
    at = np.flatnonzero(lens == dim)
    own = part if len(at) == len(part) else part.take(pa.array(at))
    x = own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return at + s, np.divide(x, norm, out=np.full_like(x, np.nan, dtype=np.float64), where=norm > 0)


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, keys, unit = None, [], None, None
        for b in batches:
            cells, sides, names, vecs = np.asarray(b.column("cell")), np.asarray(b.column("side")), b.column("key"), b.column("vec")
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), len(cells)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if cells[s] != cell:
                    cell, held, keys, unit = cells[s], [], None, None
                if sides[s] == 0:
                    held.append((names.slice(s, e - s), vecs.slice(s, e - s)))
                    continue
                if unit is None and held:
                    queries, own = (pa.chunked_array([h[n] for h in held]).combine_chunks() for n in (0, 1))
                    lens, times = np.unique(np.asarray(pc.fill_null(pc.list_value_length(own), -1)), return_counts=True)
                    at, unit = _rows_of(own, int(lens[times.argmax()]), 0, len(own))
                    keys, held = queries.take(pa.array(at)), []
                if unit is None or not len(unit):
                    continue
                at, x = _rows_of(vecs, unit.shape[1], s, e)
                for q in range(0, len(unit) if len(at) else 0, 1024):
                    c = unit[q : q + 1024] @ x.T
                    c[np.isnan(c)] = -np.inf
                    m = min(k, c.shape[1])
                    kth = -np.partition(-c, m - 1, axis=1)[:, m - 1 : m]
                    r, j = np.nonzero((c >= kth) & np.isfinite(c))  # ties at the k-th place are kept
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(q + r)), names.take(pa.array(at[j])), pa.array(c[r, j])], names=["q", "i", "cosine"])

    return run
