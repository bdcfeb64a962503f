import random

import pytest
from pyspark.sql import functions as F

from lawstrata.operators.components import connected_components
from lawstrata.operators.hierarchy import _walk, descendants, resolve_hierarchy
from lawstrata.session import Scratch


def climb(parent):
    """Brute force: (root, depth, state) of every node."""
    out = {}
    for start in parent:
        seen, x = {}, start
        while True:
            if x in seen:
                ring = [y for y, k in seen.items() if k >= seen[x]]
                out[start] = (min(ring), seen[x], "cycle" if seen[x] == 0 else "below_cycle")
                break
            seen[x] = len(seen)
            p = parent[x]
            if p is None or p not in parent:
                out[start] = (x, len(seen) - 1, "tree") if p is None else (p, len(seen), "tree")
                break
            x = p
    return out


def forest(n, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    parent = {}
    for i, x in enumerate(names):
        r = rng.random()
        parent[x] = None if r < 0.05 else f"gone{rng.randint(0, 3)}" if r < 0.1 else rng.choice(names) if r < 0.2 else names[max(0, i - rng.randint(1, 4))] if i else None
    return parent


def solve(spark, parent, **options):
    df = spark.createDataFrame([(k, v, 1) for k, v in parent.items()], "k string, p string, o int")
    return {r.id: r for r in resolve_hierarchy(df, "k", "p", "o", **options).collect()}


@pytest.mark.parametrize("bound", [250_000, 3])
def test_random_forests(spark, bound):
    for seed in range(2):
        parent = forest(250, seed)
        got = solve(spark, parent, bound=bound, with_paths=True)
        assert {k: (r.root_id, r.node_depth, r.node_state) for k, r in got.items()} == climb(parent)
        for k, r in got.items():
            steps = r.path.split("/")
            assert steps[-1] == k and steps[0] == (r.root_id if r.node_state == "tree" else steps[0])
            assert all(parent[b] == a for a, b in zip(steps, steps[1:]))
            assert r.n_descendants == sum(k in other.path.split("/")[:-1] for other in got.values()) == r.last - r.pre
        if seed == 0:
            numbers = {k: (r.n_descendants, r.pre, r.last, r.path) for k, r in got.items()}
            assert numbers == {k: (r.n_descendants, r.pre, r.last, r.path) for k, r in solve(spark, parent, with_paths=True).items()}
        df = spark.createDataFrame([(k, v) for k, v in parent.items()], "k string, p string")
        pairs = {(r.ancestor, r.id): r.distance for r in descendants(df, "k", "p", bound=bound).collect()}
        assert pairs == {(x, k): len(steps) - 1 - i for k, r in got.items() for steps in [r.path.split("/")] for i, x in enumerate(steps[:-1]) if x in parent}


def test_long_chain_and_descendants(spark):
    parent = {f"c{i}": f"c{i - 1}" if i else None for i in range(3000)}
    got = solve(spark, parent)
    assert got["c2999"].node_depth == 2999 and got["c0"].n_descendants == 2999 and got["c2999"].n_descendants == 0
    star = {"r": None} | {f"s{i}": "r" for i in range(500)} | {"t": "s7"}
    got = solve(spark, star)
    below = {k for k, r in got.items() if got["s7"].pre < r.pre <= got["s7"].last}
    assert below == {"t"} and got["r"].n_descendants == 501


def test_giant_star_and_ring(spark):
    """Intervals of components that no task may hold are those of a walk."""
    rng = random.Random(8)
    star = {"r": None} | {f"s{i}": "r" for i in range(300)} | {f"t{i}": f"s{rng.randint(0, 299)}" for i in range(200)}
    ring = {f"q{i}": f"q{(i + 1) % 90}" for i in range(90)} | {f"u{i}": f"q{rng.randint(0, 89)}" for i in range(60)} | {f"v{i}": f"u{rng.randint(0, 59)}" for i in range(60)}
    parent = star | ring
    a, b = solve(spark, parent), solve(spark, parent, bound=10)
    assert {k: tuple(r) for k, r in a.items()} == {k: tuple(r) for k, r in b.items()}


def test_paths_of_a_deep_chain_are_streamed(spark):
    """The walk holds one path at a time."""
    ids = [f"{i:06d}" for i in range(20_000)]
    rows = _walk(ids, [None, *ids[:-1]], "paths")
    assert max(len(r[4]) for r in rows) == 7 * 20_000 - 1


def test_rings(spark):
    got = solve(spark, {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "me": "me", "u": "me"}, bound=2)
    assert (got["c"].root_id, got["c"].node_depth, got["c"].node_state) == ("a", 0, "cycle")
    assert (got["e"].root_id, got["e"].node_depth, got["e"].node_state) == ("a", 2, "below_cycle")
    assert (got["me"].node_state, got["u"].root_id, got["u"].node_state) == ("cycle", "me", "below_cycle")


def test_dirty_rows(spark):
    data = [(" A ", " ", 1, "x"), ("b", "\ta ", 1, "x"), ("b", "zz", 0, "x"), ("B", "a", 1, "y"), (None, "a", 1, "x"), ("  ", "a", 1, "x"), ("c", "", 5, None)]
    df = spark.createDataFrame(data, "k string, p string, o int, id string").withColumn("parent", F.lit(1)).withColumn("comp", F.lit(2))
    got = {r.id: (r.root_id, r.node_depth) for r in resolve_hierarchy(df, "k", "p", "o", "id").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("c", 0)}
    assert resolve_hierarchy(df.limit(0), "k", "p", "o").count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (7, 7), (5, 6), (5, 6)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "x bigint, y bigint")
    for options in ({}, {"bound": 1, "per_task": 20}, {"fragment": F.lit(1), "per_task": 40, "bound": 1}):
        got = {r.node: r.comp for r in connected_components(df, "x", "y", Scratch(spark, "t"), **options).collect()}
        assert got == {x: find(x) for x in up}, options
    assert connected_components(df.limit(0), "x", "y", Scratch(spark, "t")).count() == 0
