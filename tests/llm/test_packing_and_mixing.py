import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawstrata.llm import mixing, packing
from lawstrata.llm.tokens import encoder

CAPS = "bin_kind string, capacity_tokens int"


def texts(n, seed=1):
    rng = random.Random(seed)
    words = "điều khoản luật giao thông đường bộ phạt tiền xe máy the law of road".split()
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 20, 60, 200])))) for i in range(n)]


def test_hilbert_key_is_a_curve():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_every_text_has_its_bin(spark):
    rows = texts(700) + [(900, None), (901, ""), (902, "từ " * 30_000), (None, "x y"), (5, "xe")]
    df = spark.createDataFrame(rows, "i bigint, text string").withColumn("tokens", F.lit("clash")).withColumn("curve", F.lit(1))
    caps = spark.createDataFrame([("a", 64), ("b", 1024), (None, 32), ("bad", 0), ("none", None)], CAPS)
    got = packing.pack_texts(df, "i", F.col("text"), caps, per_range=200).collect()
    size = defaultdict(list)
    for i, t in rows:
        size[i].append(len(encoder().encode_ordinary(t)) if t else 0)
    for kind, cap in (("a", 64), ("b", 1024), (None, 32)):
        own = [r for r in got if r.bin_kind == kind]
        bins, parts = defaultdict(int), defaultdict(list)
        for r in own:
            bins[r.bin_id] += r.tokens
            parts[r.id].append(r)
        assert max(bins.values()) <= cap and set(parts) == set(size)
        for i, sizes in size.items():
            assert sum(r.tokens for r in parts[i]) == sum(sizes)
            whole = [n for n in sizes if n <= cap]
            assert sum(r.n_pieces == 1 for r in parts[i]) == len(whole)
            for r in parts[i]:
                assert r.n_pieces == 1 or r.tokens == cap or r.piece == r.n_pieces - 1
    assert packing.pack_texts(df.limit(0), "i", F.col("text"), caps).count() == 0


def test_little_space_is_left(spark):
    df = spark.createDataFrame(texts(4000, 2), "i bigint, text string")
    caps = spark.createDataFrame([("a", 256), ("b", 512)], CAPS)
    packed = packing.pack_texts(df, "i", F.col("text"), caps)
    sizes = {(r.bin_kind, r.id, r.piece): r.tokens for r in packed.collect()}
    for r in packing.fill_report(packed, caps).collect():
        own = [n for (kind, *_), n in sizes.items() if kind == r.bin_kind]
        # no packing has fewer bins than the space asks for, or than items of more than half a bin
        assert r.n_bins <= 1.02 * max(sum(own) / r.capacity_tokens, sum(n > r.capacity_tokens / 2 for n in own))


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        for seed in (1, 2):
            p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, seed))
            assert sorted(p) == list(range(n))
    assert list(mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 1))) != list(mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 2)))


def test_slots_for():
    assert list(mixing.slots_for(np.array([0.5, 0.5]), np.array([10, np.inf]), np.array([10, 3]))) == [10, 10]
    assert list(mixing.slots_for(np.array([0.25, 0.75]), np.array([np.inf, np.inf]), np.array([6, 6]))) == [3, 9]


@pytest.mark.parametrize("hot", [0, 3000])
def test_mixes(spark, hot):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["A", " a", "b", "B ", "c", None, ""])) for i, t in texts(1500 + hot, 3)]
    rows = [(i, t, "b" if hot and i >= 1500 else s) for i, t, s in rows] + [(9000, None, "a"), (9001, "", "b"), (9002, "điều " * 20_000, "b")]
    goal = [("m", "a", 3.0, 1), ("m", "b", 1.0, 2), ("m", "gone", 1.0, 1), ("m", "c", 0.0, 1), ("n", "c", 1.0, 4), ("n", "a", 2.0, 2), ("free", "a", 1.0, None), ("free", "b", 1.0, None), ("nothing", "gone", 1.0, 1), (None, "a", 1.0, 1)]
    df = spark.createDataFrame(rows, "i bigint, text string, src string").withColumn("block", F.lit(1)).withColumn("start", F.lit("x"))
    targets = spark.createDataFrame(goal, "mix_name string, source string, weight double, max_repeats int")
    chosen, shares, blocks = mixing.mix_sources(df, "i", F.col("text"), F.col("src"), targets, block=64)
    laid = {}
    for r in blocks.collect():
        laid.setdefault((r.mix_name, r.shard), []).append(r.place)
    assert all(sorted(v) == list(range(len(v))) for v in laid.values()) and {m for m, _ in laid} == {r.mix_name for r in chosen.collect()}
    s = {(r.mix_name, r.source): r for r in shares.collect()}
    assert abs(s["m", "a"].actual_share - 0.75) < 0.02 and abs(s["m", "b"].actual_share - 0.25) < 0.02 and s["m", "gone"].tokens_used == s["m", "c"].tokens_used == 0
    assert abs(s["n", "a"].actual_share - 2 / 3) < 0.02 and abs(s["free", "a"].actual_share - 0.5) < 0.02
    caps = {(m, src): c for m, src, _, c in goal}
    size = {i: len(encoder().encode_ordinary(t)) if t else 0 for i, t, _ in rows}
    rows_out = chosen.collect()
    assert rows_out and all(caps[r.mix_name, r.source] is None or r.repeats <= caps[r.mix_name, r.source] for r in rows_out)
    assert all(r.tokens == size[r.id] and 0 < r.tokens_used <= r.repeats * r.tokens for r in rows_out)
    assert len({(r.mix_name, r.id) for r in rows_out}) == len(rows_out)
    total = defaultdict(int)
    for r in rows_out:
        total[r.mix_name, r.source] += r.tokens_used
    assert all(total.get(k, 0) == r.tokens_used for k, r in s.items())
    again = mixing.mix_sources(df, "i", F.col("text"), F.col("src"), targets, block=64)[0].collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows_out), key=repr)


def test_empty_mixes(spark):
    df = spark.createDataFrame([], "i bigint, text string, src string")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, weight double, max_repeats int")
    chosen, shares, _ = mixing.mix_sources(df, "i", F.col("text"), F.col("src"), targets)
    assert chosen.count() == 0 and [r.tokens_used for r in shares.collect()] == [0]
    chosen, shares, _ = mixing.mix_sources(df, "i", F.col("text"), F.col("src"), targets.limit(0))
    assert chosen.count() == 0 == shares.count()


def test_containers_hold_neighbours_of_the_curve(spark):
    df = spark.createDataFrame(texts(3000, 4), "i bigint, text string")
    caps = spark.createDataFrame([("a", 512)], CAPS)
    packed = packing.pack_texts(df, "i", F.col("text"), caps)
    place = {i: k for k, i in enumerate(r.id for r in packed.select("id", "curve").distinct().orderBy("curve", "id").collect())}
    bins = defaultdict(list)
    for r in packed.collect():
        bins[r.bin_id].append(place[r.id])
    spans = [max(v) - min(v) for v in bins.values() if len(v) > 1]
    assert max(spans) <= 20 * packing.WINDOW and np.median(spans) <= 2 * packing.WINDOW
    assert {tuple(r)[2:] for r in packing.validity_report(packed, caps).collect()} == {(3000, 0, 0, 0)}
    one = packed.where("bin_id = 0").limit(1)
    broken = packed.union(one.withColumn("tokens", F.lit(600).cast("bigint")).withColumn("piece", F.lit(0)))
    (r,) = packing.validity_report(broken, caps).collect()
    assert r.n_overfull == 1 and r.n_gaps == 1
