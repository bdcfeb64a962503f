"""Connected components of an edge list.

First every fragment of the edges is contracted where it lies: a union-find over one partition
turns its edges into stars. Only vertices that lie in several fragments leave edges between stars;
usually there are few, and one bounded task joins them. Where more than ``bound`` such edges are
left, alternating large-star and small-star rounds finish the work without any large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawstrata.session import Scratch, enough_partitions

#: Edges that one task may join.
BOUND = 1_000_000


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for start in range(0, len(nodes), 50_000):
        part = nodes[start : start + 50_000]
        yield pd.DataFrame({"node": part, "comp": [find(x) for x in part]})


def _star_rounds(edges: DataFrame, scratch: Scratch, rounds: int) -> DataFrame:
    """Large-star and small-star by turns until every vertex points at the least of its component."""
    e = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars0")
    for k in range(1, rounds + 1):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        e2 = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        e2 = scratch.cut(e2, f"stars{k}")
        settled = e2.join(e.select("a", "b"), ["a", "b"], "left_anti").limit(1).count() == 0 and e2.join(e2.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0
        scratch.drop(f"stars{k - 1}")
        e = e2
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def connected_components(edges: DataFrame, src: str, dst: str, scratch: Scratch, fragment: Column | None = None, bound: int = BOUND, per_task: int = 200_000, rounds: int = 60) -> DataFrame:
    """(node bigint, comp bigint): each vertex of the edges with the least vertex of its component.

    ``src`` and ``dst`` are bigint ids; null ends are left out, an edge to itself gives a component
    of one, repeated edges change nothing, no edges give no rows. ``fragment`` says which edges to
    contract together (a bigint expression; by default a hash of ``src``): it changes the work, not the
    result.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).cast("bigint").alias("a"), F.col(dst).cast("bigint").alias("b"), F.coalesce((F.xxhash64(F.col(src)) if fragment is None else fragment).cast("bigint"), F.lit(0)).alias("f"))
    e = scratch.cut(e.where("a is not null and b is not null").distinct(), "edges")
    n = enough_partitions(spark, e.count(), per_task)
    # rows of one fragment beyond per_task are spread over salts; that costs contraction, not truth
    hot = e.groupBy("f").count().where(F.col("count") > per_task)
    e = e.join(hot, "f", "left").select("a", "b", "f", F.when(F.col("count").isNotNull(), F.pmod(F.xxhash64("a"), F.ceil(F.col("count") / per_task))).otherwise(F.lit(0)).alias("s"))
    stars = scratch.cut(e.repartition(n, "f", "s").select("a", "b").mapInPandas(_union, "node bigint, comp bigint"), "local")
    label = stars.groupBy("node").agg(F.min("comp").alias("m"), F.max("comp").alias("x"))
    between = stars.join(label.where("m <> x").select("node", "m"), "node").where("comp <> m").select(F.col("comp").alias("a"), F.col("m").alias("b")).distinct()
    between = scratch.cut(between, "between")
    left = between.count()
    base = label.select("node", F.col("m").alias("comp"))
    if not left:
        return base
    if left <= bound:
        top = between.coalesce(1).mapInPandas(_union, "node bigint, comp bigint")
    else:
        top = _star_rounds(between, scratch, rounds)
    top = scratch.cut(top, "top").select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    return base.join(top, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
