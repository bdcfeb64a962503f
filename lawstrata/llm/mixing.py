"""Mixing sources to target weights.

The tokens of each source form one line, cut into blocks of fixed length. A mix is a row of slots,
each to be filled by one block; slots are dealt to output shards, and every shard draws from a
multinomial law how many of its slots each source gets. What the draws leave short of a source's
number, a last shard makes up; what they exceed it by is left out, so that shares come out right to a
block. The slots of a source are numbered through all shards, and a slot's number is mapped to a block
by a pseudorandom permutation of the source's blocks: after each pass through all of them, the next
pass takes another permutation. Blocks are then joined to documents by their index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawstrata.functions.text import norm_id
from lawstrata.llm.tokens import VOCABULARY, measured
from lawstrata.llm.words import mix as scramble
from lawstrata.session import Scratch

BLOCK = 256
SLOTS = 4096
PER_BUCKET = 4096
SEED = 1234


def permuted(position: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 takes each position; a Feistel network with cycle walking."""
    x = position.astype(np.uint64)
    n = n.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        y, h, m, s = x[todo], half[todo], mask[todo], seed[todo].astype(np.uint64)
        left, right = y >> h, y & m
        for r in range(4):
            left, right = right, left ^ (scramble(right + s * np.uint64(4) + np.uint64(r)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def slots_for(weights: np.ndarray, caps: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """How many slots each source of a mix gets: in all, as many as no capped source runs out of."""
    capped = np.isfinite(caps)
    n = int((caps[capped] / weights[capped]).min()) if capped.any() else int(blocks.sum())
    exact = n * weights
    out = np.floor(exact + 1e-9).astype(np.int64)
    for k in np.argsort(out - exact, kind="stable")[: n - int(out.sum())]:
        out[k] += out[k] + 1 <= caps[k]
    return out


def _draw(mixes: dict[str, tuple[list[str], list[float]]], seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, k, shard, slots in pdf[["mix_name", "k", "shard", "slots"]].itertuples(index=False):
                sources, weights = mixes[name]
                counts = np.random.default_rng([seed, int(k), int(shard)]).multinomial(int(slots), weights)
                rows += [(name, s, shard, int(c)) for s, c in zip(sources, counts, strict=True) if c]
            yield pd.DataFrame(rows, columns=["mix_name", "source", "shard", "cnt"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        j, n, seed = (np.asarray(batch.column(c), np.int64) for c in ("slot", "n_blocks", "seed"))
        lap, pos = j // n, j % n
        block = permuted(pos, n, scramble(seed.view(np.uint64) + lap.astype(np.uint64)) >> np.uint64(8)) if len(j) else j
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("mix_name", "source", "shard", "slot")), pa.array(block, pa.int64())], names=["mix_name", "source", "shard", "slot", "block"])


def mix_sources(df: DataFrame, id_col: str, text: Column, source: Column, targets: DataFrame, path: str = VOCABULARY, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, shares, blocks).

    chosen: mix_name, source, id, tokens, repeats, tokens_used - each document that some block of the
    mix takes tokens from; ``repeats`` is how often the most used of its tokens is taken, never more
    than the source's cap. shares: mix_name, source, target_share, actual_share, tokens_used,
    tokens_available, max_repeats - one row for each source that a mix names. blocks: mix_name, shard,
    place, source, block - the blocks in the order of the output, shard by shard, sources mixed within it.

    * A mix is as large as its capped sources allow; if none is capped, as large as its sources together.
      Weights are taken relative to the sources that have tokens, a positive weight and a cap of at
      least 1; ``target_share`` is relative to all sources of the mix.
    * Sources are compared trimmed and in lower case; documents without one, and texts without a token,
      are in no mix. Of repeated target rows the weights add up and the lowest cap counts. Null weights
      are 0, a null cap is none. Repeated document rows are documents of their own.
    * ``targets`` (mix_name, source, weight, max_repeats) may have at most 10,000 rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mixing")
    goal = targets.select("mix_name", norm_id(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"), "max_repeats").where("mix_name is not null and source is not null")
    goal = goal.groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    rows = goal.orderBy("mix_name", "source").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 rows of targets")
    named = spark.createDataFrame([(s,) for s in sorted({r["source"] for r in rows})], "source string")
    docs = measured(df, {"id": F.col(id_col), "source": norm_id(source)}, text, path).select("id", "source", "tokens")
    docs = scratch.cut(docs.where("tokens > 0").join(F.broadcast(named), "source", "left_semi"), "docs")
    # the sources' lines: buckets by hash, whose sums are few enough to be numbered one after the other
    size = docs.groupBy("source").agg(F.ceil(F.count("*") / PER_BUCKET).alias("nb"), F.sum("tokens").alias("total"))
    size = scratch.cut(size, "size")  # no more rows than sources are named
    total = {r["source"]: r["total"] for r in size.collect()}
    d = docs.join(F.broadcast(size.select("source", "nb")), "source").withColumn("h", F.xxhash64("id"))
    d = d.withColumn("bucket", F.pmod("h", "nb").cast("int")).drop("nb")
    sums = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("start", F.coalesce(inside, F.lit(0))).join(sums, ["source", "bucket"]).withColumn("start", F.col("start") + F.col("base"))
    spans = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("tokens") - 1) / block))))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("tokens"), (F.col("block") + 1) * block)
    spans = spans.select("source", "block", "id", "start", "tokens", (high - low).alias("part"))
    # the mixes: sizes and laws, from the few rows of the targets
    mixes: dict[str, tuple[list[str], list[float]]] = {}
    plan, laid = [], []
    for k, name in enumerate(sorted({r["mix_name"] for r in rows})):
        own = [r for r in rows if r["mix_name"] == name and r["weight"] > 0 and total.get(r["source"]) and (r["max_repeats"] is None or r["max_repeats"] >= 1)]
        if not own:
            continue
        w = np.array([r["weight"] for r in own])
        w = w / w.sum()
        n = np.array([-(-total[r["source"]] // block) for r in own])
        caps = np.array([np.inf if r["max_repeats"] is None else r["max_repeats"] * b for r, b in zip(own, n, strict=True)])
        mixes[name] = [r["source"] for r in own], w.tolist()
        goals = slots_for(w, caps, n)
        plan.append((name, k, int(goals.sum())))
        laid += [(name, r["source"], int(b), int(g), k * 1_000_003 + i) for i, (r, b, g) in enumerate(zip(own, n, goals, strict=True))]
    shards = spark.createDataFrame(plan, "mix_name string, k int, n bigint")
    shards = shards.where("n > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / SLOTS))))
    shards = shards.withColumn("slots", F.least(F.lit(SLOTS), F.col("n") - F.col("shard") * SLOTS)).select("mix_name", "k", "shard", "slots")
    drawn = shards.repartition("mix_name", "shard").mapInPandas(_draw(mixes, seed), "mix_name string, source string, shard bigint, cnt bigint")
    # numbers of a source's slots: the draws, one row for each shard and source, are laid end to end
    drawn = scratch.cut(drawn, "drawn")
    laws = spark.createDataFrame(laid, "mix_name string, source string, n_blocks bigint, goal bigint, seed bigint")
    got = drawn.groupBy("mix_name", "source").agg(F.sum("cnt").alias("got"), F.max("shard").alias("top"))
    short = laws.join(got, ["mix_name", "source"], "left").select("mix_name", "source", (F.coalesce("top", F.lit(0)) + 1).alias("shard"), (F.col("goal") - F.coalesce("got", F.lit(0))).alias("cnt"))
    ends = F.sum("cnt").over(Window.partitionBy("mix_name", "source").orderBy("shard"))
    slots = drawn.union(short.where("cnt > 0")).withColumn("end", ends).join(F.broadcast(laws), ["mix_name", "source"])
    slots = slots.select("mix_name", "source", "shard", "n_blocks", "seed", "goal", F.explode(F.sequence(F.col("end") - F.col("cnt"), F.col("end") - 1)).alias("slot"))
    slots = slots.where("slot < goal").drop("goal").select("mix_name", "source", "shard", "slot", "n_blocks", "seed")
    slots = slots.mapInArrow(_blocks, "mix_name string, source string, shard bigint, slot bigint, block bigint")
    used = slots.groupBy("mix_name", "source", "block").agg(F.count("*").alias("uses"))
    mixed = F.row_number().over(Window.partitionBy("mix_name", "shard").orderBy(F.xxhash64("source", "slot", F.lit(seed)), "source", "slot"))  # a shard has no more than SLOTS, the last one what settles the shares
    blocks = slots.select("mix_name", "shard", (mixed - 1).alias("place"), "source", "block")
    hits = used.join(spans, ["source", "block"])
    chosen = hits.groupBy("mix_name", "source", "id", "start").agg(F.max("tokens").alias("tokens"), F.max("uses").alias("repeats"), F.sum(F.col("uses") * F.col("part")).alias("tokens_used")).drop("start")
    chosen = scratch.cut(chosen, "chosen")
    got = chosen.groupBy("mix_name", "source").agg(F.sum("tokens_used").alias("tokens_used"))
    by = Window.partitionBy("mix_name")
    shares = goal.join(got, ["mix_name", "source"], "left").join(size.select("source", F.col("total").alias("tokens_available")), "source", "left")
    shares = shares.select(
        "mix_name", "source", F.round(F.try_divide("weight", F.sum("weight").over(by)), 6).alias("target_share"),
        F.round(F.coalesce(F.try_divide(F.coalesce("tokens_used", F.lit(0)), F.sum("tokens_used").over(by)), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("tokens_used", F.lit(0)).cast("bigint").alias("tokens_used"), F.coalesce("tokens_available", F.lit(0)).cast("bigint").alias("tokens_available"), "max_repeats",
    )
    return chosen, shares, blocks
