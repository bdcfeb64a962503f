import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawstrata.llm import neardup
from lawstrata.llm.words import jaccard, shingles, words

K, T, G = "k", "t", "g"


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        r, i = rng.random(), rng.randrange(len(w))
        if r < 0.4:
            w[i] = f"m{rng.randint(0, 999)}"
        elif r < 0.7:
            w.insert(i, f"i{rng.randint(0, 999)}")
        elif len(w) > 20:
            j = rng.randrange(len(w) - 8)
            w = w[:j] + w[j + 4 : j + 8] + w[j : j + 4] + w[j + 8 :]
    return " ".join(w)


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(70, 140)))
        out.append((f"k{i}", base, "x"))
        for j in range(rng.choice([0, 0, 1, 3])):
            out.append((f"k{i}e{j}", edited(rng, base, rng.randint(0, 6)), rng.choice("xxxy")))
    return out


def brute(rows, size, threshold, least):
    s = {k: (g, shingles(words(t), size)) for k, t, g in rows if k is not None and t and len(words(t)) >= max(least, size)}
    return {(s[a][0], *sorted((a, b))) for a, b in combinations(s, 2) if s[a][0] == s[b][0] and jaccard(s[a][1], s[b][1]) >= threshold}


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "k string, t string, g string").withColumn("cid", F.lit("clash")).withColumn("sig", F.lit(1))
    return {tuple(r) for r in neardup.near_duplicate_pairs(df, K, T, group=G, **options).collect()}


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.6), (5, 0.8)])
def test_recall_and_precision(spark, size, threshold):
    rows = corpus(250)
    want = brute(rows, size, threshold, 60)
    got = found(spark, rows, threshold=threshold, shingle=size, least_words=60)
    assert got <= want and len(want) > 60
    assert len(got) >= 0.97 * len(want)


def test_dirty_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [("a", "x y z", "g"), ("b", "x y z", "g"), ("c", "X, y [[ANCHOR:q]] z!", "g"), ("d", "x y z", "h"), ("e", None, "g"), ("f", "", "g"), (None, "x y z", "g"), ("l1", long, "g"), ("l2", long + " end", "g"), ("n", "x y z", None), ("m", "x y z", None)]
    got = found(spark, rows, threshold=0.8, shingle=3)
    assert {p for p in got if p[0] is not None} == {("g", "a", "b"), ("g", "a", "c"), ("g", "b", "c"), ("g", "l1", "l2")}
    df = spark.createDataFrame(rows, "k string, t string, g string").limit(0)
    assert neardup.near_duplicate_pairs(df, K, T).count() == 0


def test_repeated_keys(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([("a", "other words here", 1), ("a", text, 2), ("b", text, 1), ("b", text, 1)], "k string, t string, o int")
    assert [tuple(r)[1:] for r in neardup.near_duplicate_pairs(df, K, T, order="o").collect()] == [("a", "b")]


def test_hot_class_and_hot_pattern(spark):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randint(0, 300)}" for _ in range(120))
    copies = [(f"c{i:03}", text, "g") for i in range(90)]
    near = [(f"n{i:03}", edited(random.Random(i), text, 1), "g") for i in range(150)]
    got = found(spark, copies + near, threshold=0.8, shingle=3)
    star = {("g", "c000", f"c{i:03}") for i in range(1, 90)}
    assert star <= got and not any(a.startswith("c") and b.startswith("c") and a != "c000" for _, a, b in got)
    want = {p for p in brute(copies[:1] + near, 3, 0.8, 1)}
    assert len(want & got) >= 0.999 * len(want)


def test_hot_patterns_lose_nothing(spark, monkeypatch):
    """A family that shares its patterns, cut into blocks, gives the pairs that lists of whole patterns give."""
    rng = random.Random(11)
    text = " ".join(f"w{rng.randint(0, 300)}" for _ in range(120))
    rows = [(f"n{i:03}", edited(random.Random(i), text, 1 + i % 7), "gh"[i % 5 == 0]) for i in range(160)] + corpus(40)
    whole = found(spark, rows, threshold=0.6, shingle=3)
    monkeypatch.setattr(neardup, "COMMON", 4)
    monkeypatch.setattr(neardup, "BLOCK", 24)
    assert found(spark, rows, threshold=0.6, shingle=3) == whole and len(whole) > 5_000


def test_pairs_are_given_out_at_their_first_pattern():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 3, (40, neardup.SYMBOLS)).astype(np.uint16)
    seen = {}
    for p in range(neardup.SYMBOLS):
        s, m = divmod(p, neardup.WIDTH)
        own = [k for k in range(s * neardup.WIDTH, (s + 1) * neardup.WIDTH) if k != s * neardup.WIDTH + m]
        for i, j in combinations(range(40), 2):
            if (sig[i, own] == sig[j, own]).all():
                seen.setdefault((i, j), p)
    for p in range(neardup.SYMBOLS):
        s, m = divmod(p, neardup.WIDTH)
        own = [k for k in range(s * neardup.WIDTH, (s + 1) * neardup.WIDTH) if k != s * neardup.WIDTH + m]
        members = {}
        for i in range(40):
            members.setdefault(tuple(sig[i, own]), []).append(i)
        for at in members.values():
            r, c = neardup._first_shared(sig[at], sig[at], 10, p, True)
            got = {(at[a], at[b]) for a, b in zip(r, c)}
            assert got == {(i, j) for i, j in combinations(at, 2) if seen[i, j] == p and (sig[i] == sig[j]).sum() >= 10}


def test_groups(spark):
    rows = corpus(60, 3) + [("z1", "a b c d e f", "x"), ("z2", "a b c d e f", "x")]
    df = spark.createDataFrame(rows, "k string, t string, g string")
    got = {r.key: r for r in neardup.near_duplicate_groups(df, K, T, group=G, threshold=0.6, shingle=3).collect()}
    assert len(got) == len(rows) and (got["z2"].group_id, got["z2"].n_copies, got["z2"].n_links) == ("z1", 2, 0)
    for _, a, b in brute(rows, 3, 0.6, 1):
        assert got[a].group_id == got[b].group_id


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        found(spark, [("a", "b", "c")], threshold=0.3)


def test_large_class_is_written_out(spark, monkeypatch, tmp_path):
    from lawstrata.llm.queries import QUERIES

    if hasattr(neardup, "KEYS"):
        monkeypatch.setattr(neardup, "KEYS", 16)
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(f"c{i:03}", text if i % 3 else text.upper() + ".", "chunk") for i in range(80)]
    rows += [("d0", text + " thêm một", "chunk"), ("d1", "đầu " + text, "chunk"), ("e", " ".join(f"v{i}" for i in range(90)), "chunk")]
    spark.createDataFrame([("Khoan", k, t, 1) for k, t, _ in rows], "chunk_type string, chunk_id string, content string, loaded_at int").write.parquet(str(tmp_path / "chunk.parquet"))
    spark.createDataFrame([], "amend_key string, amended_content string, loaded_at int").write.parquet(str(tmp_path / "amendment.parquet"))
    got = [tuple(r) for r in QUERIES["p1_found"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) == 82 * 81 // 2 and set(got) == brute(rows, 3, 0.6, 60)
