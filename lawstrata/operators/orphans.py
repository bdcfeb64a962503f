"""References to records that do not exist, are deleted, or arrive late.

The key space is cut into ranges of the keys' 64-bit hashes, so that ranges are even whatever the
keys look like. In each range the target keys become sorted arrays, one for each column that the
verdict needs, and batches of references are probed with one vectorised binary search per batch.
References and targets of a range meet in one partition, targets first; a range whose references
exceed a task's share is split over salts, each with its own copy of the range's (bounded) targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawstrata.session import Scratch, enough_partitions

OUT = "ref_field string, row_key string, ref_value string, ref_status string, ref_month string"


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by (pid, side, h): a range's targets (side 0), then its references (side 1)."""
    pid, held, arrays = None, [], None

    def build() -> tuple[np.ndarray, ...]:
        t = pd.concat(held) if held else None
        if t is None:
            return np.empty(0, np.int64), np.empty(0, object), np.empty(0, bool), np.empty(0, np.int64)
        t = t.sort_values(["h", "k"], kind="stable")
        return t["h"].to_numpy(np.int64), t["k"].to_numpy(object), t["deleted"].to_numpy(bool), t["first_us"].to_numpy(np.int64)

    for batch in batches:
        for p, part in batch.groupby("pid", sort=True):
            if p != pid:
                pid, held, arrays = p, [], None
            targets = part[part["side"] == 0]
            if len(targets):
                held.append(targets[["h", "k", "deleted", "first_us"]])
            refs = part[part["side"] == 1]
            if not len(refs):
                continue
            if arrays is None:
                arrays, held = build(), []
            hs, ks, deleted, first = arrays
            h, k = refs["h"].to_numpy(np.int64), refs["k"].to_numpy(object)
            at = np.searchsorted(hs, h)
            found = np.zeros(len(h), bool)
            inside = at < len(hs)
            found[inside] = (hs[at[inside]] == h[inside]) & (ks[at[inside]] == k[inside])
            for i in np.flatnonzero(~found & inside):  # equal hashes of unequal keys lie side by side
                j = at[i] + 1
                while j < len(hs) and hs[j] == h[i]:
                    if ks[j] == k[i]:
                        at[i], found[i] = j, True
                        break
                    j += 1
            status = np.full(len(h), "missing", dtype=object)
            if len(hs):
                safe = np.where(found, at, 0)
                late = first[safe] > refs["first_us"].to_numpy(np.int64)
                status[found] = np.where(deleted[safe], "deleted", np.where(late, "late", "ok"))[found]
            hit = status != "ok"
            if hit.any():
                out = refs.loc[hit, ["ref_field", "row_key", "ref_value", "ref_month"]]
                yield pd.DataFrame({"ref_field": out["ref_field"], "row_key": out["row_key"], "ref_value": out["ref_value"], "ref_status": status[hit], "ref_month": out["ref_month"]})


def find_orphans(references: DataFrame, targets: DataFrame, per_range: int = 100_000) -> DataFrame:
    """OUT, one row for each reference whose target is ``missing``, ``deleted`` or ``late``.

    ``references``: relation, k (the key in its compared form), first_us (when the referring key first
    came, microseconds), ref_field, row_key, ref_value, ref_month. ``targets``: relation, k, deleted,
    first_us, one row for each relation and key. A reference with a null ``k`` refers to nothing. A
    null ``first_us`` of a target counts as always there, that of a reference as never. ``late`` means
    strictly after. Repeated references are reported as often as given. Empty inputs are fine: without
    targets, every reference is missing.
    """
    spark = references.sparkSession
    scratch = Scratch(spark, "orphans")
    h = F.xxhash64("relation", "k")
    refs = scratch.cut(references.where("k is not null").withColumn("h", h), "refs")
    keys = scratch.cut(targets.where("k is not null").withColumn("h", h), "keys")
    n_refs, n_keys = refs.count(), keys.count()
    ranges = enough_partitions(spark, max(n_refs, n_keys), per_range)
    # hashes lie evenly in [-2^63, 2^63); their upper 32 bits say the range
    rng = F.shiftrightunsigned("h", 32) * F.lit(ranges)
    rng = F.shiftrightunsigned(rng, 32).cast("int")
    refs, keys = refs.withColumn("r", rng), keys.withColumn("r", rng)
    share = refs.groupBy("r").agg(F.ceil(F.count("*") / F.lit(2 * per_range)).cast("int").alias("salts"))
    share = scratch.cut(share.where("salts > 1"), "share")  # only ranges that are hot; the planner sees its size
    salted = share.limit(1).count() > 0
    if salted:
        refs = refs.join(share, "r", "left").withColumn("s", F.pmod(F.xxhash64("row_key", "ref_value"), F.coalesce("salts", F.lit(1))).cast("int"))
        keys = keys.join(share, "r", "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    else:
        refs, keys = refs.withColumn("s", F.lit(0)), keys.withColumn("s", F.lit(0))
    text = F.lit(None).cast("string")
    both = refs.select("r", "s", F.lit(1).alias("side"), "h", "k", F.lit(False).alias("deleted"), F.coalesce("first_us", F.lit(2**62)).alias("first_us"), "ref_field", "row_key", "ref_value", "ref_month").union(
        keys.select("r", "s", F.lit(0), "h", "k", F.coalesce("deleted", F.lit(False)), F.coalesce("first_us", F.lit(-(2**62))), text, text, text, text)
    )
    both = both.withColumn("pid", F.col("r").cast("bigint") * 65536 + F.col("s")).drop("r", "s")
    return both.repartition(ranges, "pid").sortWithinPartitions("pid", "side").mapInPandas(_probe, OUT)


def count_orphans(found: DataFrame) -> DataFrame:
    """Misses per field, status and month."""
    return found.groupBy("ref_field", "ref_status", "ref_month").agg(F.count("*").alias("n_refs"), F.countDistinct("row_key").alias("n_rows"))
