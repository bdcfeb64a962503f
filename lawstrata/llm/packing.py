"""Filling containers of fixed capacity along a space-filling curve.

Texts are measured in tokens and placed in three dimensions by a random projection of their hashed
token vectors. A Hilbert curve through that space gives each text a key; texts are range-sorted by
key, and every range is packed in windows of neighbours along the curve, small ones, so that a container
holds texts that are alike. In a window, the largest item goes first, each into the container with the
least space that still holds it; containers with much space left pass their items on to the next window.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lawstrata.llm.tokens import DIMS, VOCABULARY, measured
from lawstrata.session import Scratch

BITS = 10
#: Items that are packed together, and items that wait for the next window, at most.
WINDOW, CARRY = 512, 256
PER_RANGE = 16_000
FULL = 0.97


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of points with coordinates in [0, 2^bits)."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess work of the inverse, from the highest bit down
        p = q - 1
        for d in range(dims):
            on = (x[:, d] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    t = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def _keyed(mean: list[float], spread: list[float]):
    low, step = np.array(mean, np.float64) - 3 * np.array(spread), 6 * np.maximum(np.array(spread, np.float64), 1e-9) / (1 << BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([np.asarray(batch.column(f"c{d}"), np.float64) for d in range(DIMS)], 1)
            cells = np.clip((at - low) / step, 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tokens"), pa.array(hilbert_key(cells), pa.int64())], names=["id", "tokens", "curve"])

    return run


class Packer:
    """Packs a stream of items for one capacity; ``put`` and ``end`` give (item, piece, pieces, size, container)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.pool: list[tuple[int, int, tuple]] = []  # (size, order, item)
        self.count = 0

    def put(self, item: object, size: int) -> Iterator[tuple]:
        whole, rest = divmod(size, self.capacity) if size > self.capacity else (0, size)
        pieces = whole + (rest > 0 or whole == 0)
        for p in range(whole):
            yield item, p, pieces, self.capacity, self._new()
        if rest or not whole:
            self.count += 1
            self.pool.append((rest, self.count, (item, whole, pieces)))
            if len(self.pool) >= WINDOW + CARRY:
                yield from self._pack(CARRY)

    def end(self) -> Iterator[tuple]:
        if self.pool:
            yield from self._pack(0)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _pack(self, carry: int) -> Iterator[tuple]:
        room: list[tuple[int, int]] = []  # (free space, box), ascending
        boxes: list[list[tuple[int, int, tuple]]] = []
        for one in sorted(self.pool, key=lambda t: (-t[0], t[1])):
            k = bisect_left(room, (one[0], -1))
            free, box = room.pop(k) if k < len(room) else (self.capacity, len(boxes))
            if box == len(boxes):
                boxes.append([])
            boxes[box].append(one)
            insort(room, (free - one[0], box))
        self.pool = []
        for free, box in reversed(room):
            if free > (1 - FULL) * self.capacity and len(self.pool) + len(boxes[box]) <= carry:
                self.pool += boxes[box]
                continue
            at = self._new()
            for size, _, (item, piece, pieces) in boxes[box]:
                yield item, piece, pieces, size, at


def _packed(capacities: list[tuple[str, int]], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        packers = [(kind, Packer(capacity, first)) for kind, capacity in capacities]

        def batch_of(kind: str, rows: list[tuple]) -> pa.RecordBatch:
            item, piece, pieces, size, at = zip(*rows, strict=True)
            ids, curve = zip(*item, strict=True)
            cols = [pa.array(c, t) for c, t in ((ids, id_type), (piece, pa.int32()), (pieces, pa.int32()), (size, pa.int64()), (at, pa.int64()), (curve, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), *cols], names=["bin_kind", "id", "piece", "n_pieces", "tokens", "bin_id", "curve"])

        for batch in batches:
            ids, sizes, curve = (batch.column(c).to_pylist() for c in ("id", "tokens", "curve"))
            for kind, packer in packers:
                rows = [r for i, n, c in zip(ids, sizes, curve, strict=True) for r in packer.put((i, c), n)]
                if rows:
                    yield batch_of(kind, rows)
        for kind, packer in packers:
            rows = list(packer.end())
            if rows:
                yield batch_of(kind, rows)

    return run


def pack_texts(df: DataFrame, id_col: str, text: Column, capacities: DataFrame, path: str = VOCABULARY, per_range: int = PER_RANGE) -> DataFrame:
    """(bin_kind, id, piece, n_pieces, tokens, bin_id, curve): the container of every text, for each capacity.

    * Sizes are tokens of the whole text. A text larger than the capacity is cut into pieces: all but
      the last fill a container each, the last is an item like any other; no other text is cut.
    * Null and empty texts have size 0 and share a container with others. Repeated rows are items of
      their own. Null ids are kept.
    * ``capacities``: bin_kind, capacity_tokens, at most 1,000 rows; null ones and those below 1 are left out.
    * Containers are numbered within a kind; ``curve`` is a text's place along the curve. An empty table gives no rows.
    """
    spark = df.sparkSession
    kinds = [(r[0], r[1]) for r in capacities.select("bin_kind", "capacity_tokens").where("capacity_tokens >= 1").distinct().orderBy("bin_kind", "capacity_tokens").limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 capacities")
    scratch = Scratch(spark, "packing")
    sized = scratch.cut(measured(df, {"id": F.col(id_col)}, text, path), "sized")
    stats = sized.agg(F.count("*").alias("n"), *(f(f"c{d}").alias(f"{f.__name__}{d}") for d in range(DIMS) for f in (F.avg, F.stddev_pop))).first()
    kind = sized.schema["id"].dataType.simpleString()
    mean, spread = ([stats[f"{f}{d}"] or 0.0 for d in range(DIMS)] for f in ("avg", "stddev_pop"))
    keyed = scratch.cut(sized.mapInArrow(_keyed(mean, spread), f"id {kind}, tokens bigint, curve bigint"), "keyed")
    ranges = max(1, -(-stats["n"] // per_range))
    line = keyed.repartitionByRange(ranges, "curve", "id").sortWithinPartitions("curve", "id")
    from pyspark.sql.pandas.types import to_arrow_type

    return line.mapInArrow(_packed(kinds, to_arrow_type(sized.schema["id"].dataType)), f"bin_kind string, id {kind}, piece int, n_pieces int, tokens bigint, bin_id bigint, curve bigint")


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, pieces, share of the containers' space that is filled, and how far apart the texts
    of a container lie: the mean stretch of the curve, of all of it, that a container of several texts spans."""
    bins = packed.groupBy("bin_kind", "bin_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"), (F.max("curve") - F.min("curve")).alias("span"))
    span = F.avg(F.when(F.col("k") > 1, F.col("span"))) / F.lit(float(1 << (BITS * DIMS)))
    per = bins.groupBy("bin_kind").agg(F.count("*").alias("n_bins"), F.sum("t").alias("n_tokens"), F.sum("k").alias("n_pieces"), F.max("t").alias("fullest"), F.round(span, 6).alias("span"))
    caps = capacities.groupBy("bin_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return per.join(caps, "bin_kind").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6))


def validity_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per kind: texts, containers beyond the capacity, texts that were cut though they fit, texts whose pieces are not all there, once each."""
    caps = capacities.groupBy("bin_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    over = packed.groupBy("bin_kind", "bin_id").agg(F.sum("tokens").alias("t")).join(F.broadcast(caps), "bin_kind")
    over = over.groupBy("bin_kind").agg(F.sum((F.col("t") > F.col("capacity_tokens")).cast("int")).alias("n_overfull"))
    texts = packed.groupBy("bin_kind", "id").agg(F.sum("tokens").alias("t"), F.max("n_pieces").alias("n"), F.count("*").alias("k"), F.countDistinct("piece").alias("d")).join(F.broadcast(caps), "bin_kind")
    cut, gap = (F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens")), (F.col("k") != F.col("n")) | (F.col("d") != F.col("n"))
    texts = texts.groupBy("bin_kind", "capacity_tokens").agg(F.count("*").alias("n_texts"), F.sum(cut.cast("int")).alias("n_cut"), F.sum(gap.cast("int")).alias("n_gaps"))
    return texts.join(over, "bin_kind").select("bin_kind", "capacity_tokens", "n_texts", "n_overfull", "n_cut", "n_gaps")
