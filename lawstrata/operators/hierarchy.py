"""Parent-child links to full hierarchies, with rings.

Connected components are found first (``components``), every component is co-located, and an
iterative depth-first traversal with node colouring walks each from its roots: white nodes are
unseen, grey ones lie on the current path, black ones are done; a link from the current node to a
grey one is a back edge and closes a ring. A component larger than ``bound`` is never brought into
one task: pointer doubling gives the same columns for it, in a number of rounds that grows with
the logarithm of its depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawstrata.functions.text import norm_id
from lawstrata.operators.components import connected_components
from lawstrata.session import Scratch, enough_partitions

#: Nodes of a component that one task may traverse.
BOUND = 250_000

TREE, CYCLE, BELOW = "tree", "cycle", "below_cycle"
PAIRS = "ancestor string, id string, distance int"
SCHEMA = "id string, root_id string, node_depth int, node_state string, path string, n_descendants bigint, pre bigint, last bigint"


def current_rows(df: DataFrame, keys: list[str], order: str, fields: dict[str, Column]) -> DataFrame:
    """One row for each key: the fields of the row with the greatest ``order``; ties go to the greatest fields.

    The aggregate combines on the map side, so a key that holds a third of the rows is no hot spot.
    """
    rows = df.select(*keys, F.struct(F.col(order).alias("__o"), *(c.alias(n) for n, c in fields.items())).alias("__r"))
    return rows.groupBy(*keys).agg(F.max("__r").alias("__r")).select(*keys, *(F.col(f"__r.{n}").alias(n) for n in fields))


def _walk(ids: list[str], parents: list[str | None], emit: str) -> Iterator[tuple]:
    """Rows of one component: of SCHEMA, with paths if ``emit`` is ``paths``; of PAIRS if it is ``pairs``.

    A path is put together from the nodes on the stack when its row is given out, so no more than the
    current one is held.
    """
    known = {x: k for k, x in enumerate(ids)}
    up = [known.get(p, -1) if p is not None else -1 for p in parents]
    children: list[list[int]] = [[] for _ in ids]
    for k, p in enumerate(up):
        if p >= 0:
            children[p].append(k)
    n = len(ids)
    color, root, ring = bytearray(n), [""] * n, bytearray(n)
    # rings: climb with colours; grey met again closes one
    for start in range(n):
        trail, x = [], start
        while x >= 0 and color[x] == 0:
            color[x] = 1
            trail.append(x)
            x = up[x]
        if x >= 0 and color[x] == 1:
            on = trail[trail.index(x) :]
            least = min(ids[k] for k in on)
            for k in on:
                ring[k], root[k] = 1, least
        for k in trail:
            color[k] = 2
    color, pre, clock = bytearray(n), [0] * n, 0
    for start in range(n):
        if not (ring[start] or up[start] < 0):
            continue
        above, p = [], parents[start]  # a parent that is no node of its own
        if not ring[start]:
            root[start] = ids[start] if p is None else p
            above = [] if p is None else [p]
        color[start], pre[start], stack = 1, clock, [(start, 0)]
        clock += 1
        while stack:
            x, k = stack[-1]
            if k == len(children[x]):
                color[x] = 2
                if emit == "pairs":
                    yield from ((ids[y], ids[x], len(stack) - 1 - d) for d, (y, _) in enumerate(stack[:-1]))
                else:
                    state = CYCLE if ring[x] else BELOW if ring[start] else TREE
                    path = "/".join([*above, *(ids[y] for y, _ in stack)]) if emit == "paths" else None
                    yield ids[x], root[start], len(above) + len(stack) - 1, state, path, clock - 1 - pre[x], pre[x], clock - 1
                stack.pop()
                continue
            stack[-1] = (x, k + 1)
            y = children[x][k]
            if color[y] or ring[y]:  # a back edge, or another node of the ring, which starts its own walk
                continue
            color[y], pre[y] = 1, clock
            clock += 1
            stack.append((y, 0))


def _traverse(emit: str):
    names = [c.split()[0] for c in (PAIRS if emit == "pairs" else SCHEMA).split(", ")]

    def components(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], list[str | None]]]:
        comp, ids, parents = None, [], []
        for pdf in batches:
            for c, x, p in zip(pdf["comp"].tolist(), pdf["id"].tolist(), pdf["parent"].tolist(), strict=True):
                if c != comp:
                    yield ids, parents
                    comp, ids, parents = c, [], []
                ids.append(x)
                parents.append(p)
        yield ids, parents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        chars = 0
        for ids, parents in components(batches):
            for row in _walk(ids, parents, emit):
                out.append(row)
                chars += len(row[4] or "") if emit == "paths" else 0
                if len(out) >= 20_000 or chars > 8_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, chars = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def _doubled(cur: DataFrame, scratch: Scratch, name: str, step) -> DataFrame:
    """Repeats ``step`` (cur -> cur, whose ``at`` is twice as far up each time) until no node has an ``at``."""
    cur, k = scratch.cut(cur, f"{name}0"), 0
    while cur.where("at is not null").limit(1).count():
        k += 1
        cur = scratch.cut(step(cur), f"{name}{k}")
    return cur


def intervals(nodes: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """(id, n_descendants, pre, last) of nodes (id, up, top), for components that no task may hold.

    ``up`` is null for roots and nodes of rings; ``top`` names what roots are numbered together. Sizes of
    subtrees, and then places, are summed along pointers that double; siblings are ordered by ranges, so
    that a parent of a third of all nodes is no group of one task.
    """
    jump = lambda cur: cur.select(F.col("id").alias("at"), F.col("at").alias("at2"))

    def sizes(cur: DataFrame) -> DataFrame:
        add = cur.where("at is not null").groupBy("at").agg(F.sum("v").alias("add")).withColumnRenamed("at", "id")
        return cur.join(jump(cur), "at", "left").join(add, "id", "left").select("id", F.col("at2").alias("at"), (F.col("v") + F.coalesce("add", F.lit(0))).alias("v"))

    def places(cur: DataFrame) -> DataFrame:
        above = cur.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("v").alias("add"))
        return cur.join(above, "at", "left").select("id", F.col("at2").alias("at"), (F.col("v") + F.coalesce("add", F.lit(0))).alias("v"))

    size = _doubled(nodes.select("id", F.col("up").alias("at"), F.lit(1).cast("bigint").alias("v")), scratch, "size", sizes).select("id", F.col("v").alias("size"))
    rows = nodes.join(size, "id").withColumn("grp", F.coalesce(F.concat(F.lit("below "), "up"), F.concat(F.lit("top "), "top")))
    rows = scratch.cut(rows.repartitionByRange(parts, "grp", "id").withColumn("range", F.spark_partition_id()), "siblings")
    earlier = lambda by, order: F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = rows.groupBy("range", "grp").agg(F.sum("size").alias("size"))  # a group has no more rows here than there are ranges
    whole = whole.select("range", "grp", earlier(["grp"], "range").alias("base"))
    rows = rows.withColumn("before", earlier(["range", "grp"], "id")).join(whole, ["range", "grp"])
    start = rows.select("id", F.col("up").alias("at"), (F.col("before") + F.col("base") + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("v"))
    pre = _doubled(start, scratch, "pre", places).select("id", F.col("v").alias("pre"))
    return pre.join(size, "id").select("id", (F.col("size") - 1).alias("n_descendants"), "pre", (F.col("pre") + F.col("size") - 1).alias("last"))


def resolve_by_doubling(nodes: DataFrame, scratch: Scratch, with_paths: bool = False, rounds: int = 64) -> DataFrame:
    """id, root_id, node_depth, node_state, path of SCHEMA, for components that no task may hold.

    ``nodes``: id, parent, inner (whether the parent is one of the ids). Every round doubles the
    distance that each open node has climbed. When a round settles no node, those left end in rings;
    as many rounds as bring each of them onto its ring show the ring's nodes, which then serve as
    roots for the rest.
    """

    def finished(out: DataFrame) -> DataFrame:
        return out.select("id", "root_id", F.col("node_depth").cast("int").alias("node_depth"), "node_state", F.array_join("path", "/").alias("path"))

    def climb(start: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
        """start: id, at (the node reached or null), root, depth, path. Settled rows, and open ones if rings are left."""
        cur, settled = scratch.cut(start, f"{name}0"), []
        open_n = cur.where("at is not null").count()
        for k in range(1, rounds + 1):
            settled.append(cur.where("at is null"))
            if not open_n:
                return _union_all(settled), None
            live = cur.where("at is not null")
            nxt = _union_all(settled + [live]).select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
            step = live.drop("root").join(nxt, "at").select(
                "id", F.col("at2").alias("at"), F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"),
                F.concat("path2", "path").alias("path"),
            )
            cur = scratch.cut(step, f"{name}{k}")
            now = cur.where("at is not null").count()
            if now == open_n:
                settled.append(cur.where("at is null"))
                return _union_all(settled), live.select("id", F.col("at")) if k == 1 else live
            open_n = now
        raise RuntimeError("a hierarchy deeper than 2^64")

    # paths as arrays while they grow; without them, nulls
    path = F.array("id") if with_paths else F.lit(None).cast("array<string>")
    start = nodes.select(
        "id", F.when(F.col("inner"), F.col("parent")).alias("at"), F.when(~F.col("inner"), F.coalesce("parent", "id")).alias("root"),
        F.when(F.col("inner") | F.col("parent").isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("depth"),
        (F.when(~F.col("inner") & F.col("parent").isNotNull(), F.array("parent", "id")).otherwise(F.array("id")) if with_paths else path).alias("path"),
    )
    done, live = climb(start, "climb")
    trees = done.select("id", F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), F.lit(TREE).alias("node_state"), "path")
    if live is None:
        return finished(trees)
    left = nodes.join(live.select("id"), "id", "left_semi").select("id", F.col("parent").alias("at"), F.col("id").alias("least"))
    cur, n, k = scratch.cut(left, "ring0"), left.count(), 0
    while 2**k < n:
        k += 1
        nxt = cur.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("least").alias("least2"))
        cur = scratch.cut(cur.join(nxt, "at").select("id", F.col("at2").alias("at"), F.least("least", "least2").alias("least")), f"ring{k}")
    on = scratch.cut(cur.select(F.col("at").alias("id")).distinct().join(cur.select("id", "least"), "id"), "on")
    rings = on.select("id", F.col("least").alias("root_id"), F.lit(0).alias("node_depth"), F.lit(CYCLE).alias("node_state"), path.alias("path"))
    tails = nodes.join(live.select("id"), "id", "left_semi").join(on.select("id"), "id", "left_anti")
    touch = on.select(F.col("id").alias("parent"), F.col("least"))
    start = tails.join(touch, "parent", "left").select(
        "id", F.when(F.col("least").isNull(), F.col("parent")).alias("at"), F.col("least").alias("root"), F.lit(1).alias("depth"),
        (F.when(F.col("least").isNotNull(), F.array("parent", "id")).otherwise(F.array("id")) if with_paths else path).alias("path"),
    )
    below, _ = climb(start, "tail")
    return finished(_union_all([trees, rings, below.select("id", F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), F.lit(BELOW).alias("node_state"), "path")]))


def _union_all(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def _located(df: DataFrame, id_col: str, parent_col: str, order_col: str | None, fragment_col: str | None, bound: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, int]:
    """(nodes of components that a task may walk, nodes of others if there are any, number of all)."""
    raw = df.select(
        norm_id(F.col(id_col)).alias("id"), norm_id(F.col(parent_col)).alias("parent"), (F.lit(0) if order_col is None else F.col(order_col)).alias("ord"),
        F.xxhash64(F.col(fragment_col if fragment_col else id_col)).alias("frag"),
    ).where("id is not null")
    cur = current_rows(raw, ["id"], "ord", {"parent": F.col("parent"), "frag": F.col("frag")})
    known = cur.select(F.col("id").alias("parent"), F.lit(True).alias("inner"))
    nodes = scratch.cut(cur.join(known, "parent", "left").select("id", "parent", "frag", F.coalesce("inner", F.lit(False)).alias("inner")), "nodes")
    total = nodes.count()
    links = nodes.where("inner").select(F.xxhash64("id").alias("x"), F.xxhash64("parent").alias("y"), "frag")
    comp = connected_components(links, "x", "y", scratch, fragment=F.col("frag"))
    placed = nodes.withColumn("x", F.xxhash64("id")).join(comp.withColumnRenamed("node", "x"), "x", "left").select("id", "parent", "inner", F.coalesce("comp", "x").alias("comp"))
    placed = scratch.cut(placed, "placed")
    giant = placed.groupBy("comp").count().where(F.col("count") > bound).select("comp")
    if not giant.limit(1).count():
        return placed, None, total
    return placed.join(giant, "comp", "left_anti"), scratch.cut(placed.join(giant, "comp", "left_semi"), "giants"), total


def _upward(giants: DataFrame, found: DataFrame) -> DataFrame:
    """(id, up, top) as ``intervals`` needs them."""
    ring = F.col("node_state") == CYCLE
    return giants.join(found.select("id", "root_id", "node_state"), "id").select("id", F.when(F.col("inner") & ~ring, F.col("parent")).alias("up"), F.when(ring, F.col("root_id")).otherwise(F.col("id")).alias("top"))


def resolve_hierarchy(
    df: DataFrame, id_col: str, parent_col: str, order_col: str | None = None, fragment_col: str | None = None, with_paths: bool = False, with_intervals: bool = True,
    bound: int = BOUND, per_task: int = 50_000,
) -> DataFrame:
    """SCHEMA, one row for each id: root, depth, state, path, number of descendants, interval.

    * Ids and parents are compared trimmed and in lower case; rows with a null or blank id are left out.
    * Repeated ids: the row with the greatest ``order_col`` counts, ties go to the greatest parent.
    * A null or blank parent: the node is its own root, depth 0. A parent that is no id: that value is
      the root, and depth counts the step to it.
    * A node that is its own parent is a ring of one. ``cycle`` nodes have the least id of their ring
      as root and depth 0; ``below_cycle`` nodes count the steps to the first node of the ring.
    * All descendants of a node in the same component are the nodes with ``pre`` in (pre, last]; a ring
      node's interval holds what hangs below it, not the rest of the ring. Children, and nodes of a ring,
      are numbered in the order of their ids. Components above ``bound`` have the same columns, by pointer
      doubling; ``with_intervals=False`` spares them ``n_descendants``, ``pre`` and ``last``.
    * Other columns of ``df`` are ignored, whatever their names. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "hierarchy")
    small, giants, total = _located(df, id_col, parent_col, order_col, fragment_col, bound, scratch)
    n = enough_partitions(spark, total, per_task)
    walked = small.select("comp", "id", "parent").repartition(n, "comp").sortWithinPartitions("comp", "id").mapInPandas(_traverse("paths" if with_paths else "rows"), SCHEMA)
    if giants is None:
        return walked
    rest = scratch.cut(resolve_by_doubling(giants, scratch, with_paths), "resolved")
    if with_intervals:
        rest = rest.join(intervals(_upward(giants, rest), scratch, n), "id")
    else:
        rest = rest.withColumns({c: F.lit(None).cast("bigint") for c in ("n_descendants", "pre", "last")})
    return walked.unionByName(rest)


def descendants(df: DataFrame, id_col: str, parent_col: str, order_col: str | None = None, fragment_col: str | None = None, bound: int = BOUND, per_task: int = 50_000) -> DataFrame:
    """PAIRS: every node with each of its descendants and the steps between them, as by ``resolve_hierarchy``.

    As many rows as there are steps to the roots in all. Nodes of a ring have no ancestors; what hangs
    below a ring has the ring's node it hangs from as its topmost one.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "descendants")
    small, giants, total = _located(df, id_col, parent_col, order_col, fragment_col, bound, scratch)
    n = enough_partitions(spark, total, per_task)
    walked = small.select("comp", "id", "parent").repartition(n, "comp").sortWithinPartitions("comp", "id").mapInPandas(_traverse("pairs"), PAIRS)
    if giants is None:
        return walked
    up = _upward(giants, resolve_by_doubling(giants, scratch)).where("up is not null")
    jump, k = scratch.cut(up.select("id", F.col("up").alias("at")), "up0"), 0
    pairs = scratch.cut(jump.select(F.col("at").alias("ancestor"), "id", F.lit(1).alias("distance")), "pairs0")
    while jump.limit(1).count():  # pairs up to 2^k steps apart, and where 2^k steps lead
        more = jump.join(pairs.select(F.col("id").alias("at"), "ancestor", "distance"), "at").select("ancestor", "id", (F.col("distance") + 2**k).alias("distance"))
        nxt = jump.join(jump.select(F.col("id").alias("at"), F.col("at").alias("at2")), "at").select("id", F.col("at2").alias("at"))
        k += 1
        pairs, jump = scratch.cut(pairs.union(more), f"pairs{k}"), scratch.cut(nxt, f"up{k}")
    return walked.unionByName(pairs)
