"""Greedy packing of ordered items into bins of a token limit.

A bin is closed when the next item would exceed the limit. The rule is sequential within a group
and free between groups, so groups are spread over partitions, sorted, and streamed: no group is
held in memory, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bins(n_keys: int, limit: int, offset: int, room: str | None, later: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, used = object(), 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True))
            most = batch.column(room).to_pylist() if room else [limit - offset] * len(keys)
            then = batch.column(later).to_pylist() if later else most
            out = []
            for key, size, first, next_ in zip(keys, batch.column("__size").to_pylist(), most, then, strict=True):
                size = size or 0
                if key != group:
                    group, number, used = key, 0, 0
                if used + size > (next_ if number else first) and used > 0:
                    number, used = number + 1, 0
                used += size
                out.append(number)
            yield batch.append_column("bin", pa.array(out, pa.int32()))

    return run


def greedy_bins(df: DataFrame, keys: list[str], order: str, size: Column, limit: int, offset: int = 0, room: str | None = None, later: str | None = None) -> DataFrame:
    """``df`` with its bin number within the group of ``keys``, from 0.

    An item larger than the limit has a bin of its own, but for items of size 0 before it. ``offset``
    counts once for each bin; ``room`` names a column that holds the limit of each group instead,
    ``later`` one with the limit of its bins after the first. Null sizes are 0; ties of ``order`` are broken by the other columns' hash.
    """
    if "bin" in df.columns:
        df = df.drop("bin")
    rest = [c for c in df.columns if c not in keys]
    src = df.select(*keys, *rest, size.cast("bigint").alias("__size"))
    tie = F.xxhash64(*[c for c in rest if not isinstance(src.schema[c].dataType, T.MapType)] or [F.lit(0)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema]).add("bin", "integer")
    line = src.repartition(*keys).sortWithinPartitions(*keys, order, tie)
    return line.mapInArrow(_bins(len(keys), limit, offset, room, later), schema).drop("__size")


def _measured(n_keys: int, limit: int, part: str, sep: str, first: str | None, later: str | None, count: Callable[[str], int], shown: Callable[[str], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, held = object(), 0, ""
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True))
            none = [""] * len(keys)
            heads, others = (batch.column(c).to_pylist() if c else none for c in (first, later))
            out = []
            for key, text, head, other in zip(keys, batch.column(part).to_pylist(), heads, others, strict=True):
                text = text or ""
                if key != group:
                    group, number, held = key, 0, ""
                joined = f"{held}{sep}{text}".strip() if held else text
                if held and count(shown(((other if number else head) or "") + joined)) > limit:
                    number, joined = number + 1, text
                held = joined
                out.append(number)
            yield batch.append_column("bin", pa.array(out, pa.int32()))

    return run


def measured_bins(df: DataFrame, keys: list[str], order: str, part: str, limit: int, sep: str, count: Callable[[str], int], first: str | None = None, later: str | None = None, shown: Callable[[str], str] = str) -> DataFrame:
    """Like ``greedy_bins``, but a bin's size is that of its joined text, measured anew with every part.

    For tokenizers by which a joined text is not the sum of its parts. ``first`` and ``later`` name columns
    of headers that count with the first bin of a group and with the others; ``shown`` is what becomes of
    a text before it is measured. A part alone is never cut.
    """
    if "bin" in df.columns:
        df = df.drop("bin")
    src = df.select(*keys, *(c for c in df.columns if c not in keys))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema]).add("bin", "integer")
    line = src.repartition(*keys).sortWithinPartitions(*keys, order)
    return line.mapInArrow(_measured(len(keys), limit, part, sep, first, later, count, shown), schema)


def ordered(what: str, order: str, sep: str) -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, what))), lambda x: x[what]), sep)


def union_of(what: str) -> Column:
    """Distinct elements of a group's arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(what))))
