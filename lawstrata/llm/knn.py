"""The k most similar vectors of every vector, by learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced parts: recursive bisection,
each half refined by swaps that lower the number of cut edges. A small softmax classifier learns
the parts of a vector's neighbourhood. Every vector is indexed in its most probable part; a query
is routed to the parts that are probable enough, whose vectors are reranked by cosine. How probable
is enough is set so that the wanted recall is reached on random steps from vectors not trained on.

Vectors travel in 12-bit fixed point, which leaves cosines right to about 0.0001 (0.0003 with 16 numbers), turned so that the
directions in which they vary most come first: where only cosines above a floor count, half of the numbers
and the length of the rest bound a cosine from above, and few pairs need the other half.

Equal vectors (up to length) are indexed once. A part too large for a task is cut into blocks of
index and query rows; each pair of blocks is its own piece of work. A piece with many index rows learns
partitions of its own, in its task, in the same way: a second level that grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawstrata.session import Scratch, parallelism

#: Vectors of the training sample: this many, or one of 64 of a large table, but never more than the second.
SAMPLE, SAMPLE_MOST = 16_384, 65_536
#: Vectors that a part should hold, and the least number of sample vectors for each part.
PART, PER_PART = 8_000, 24
#: Rows of an index block and of a query block, and rows that a task should read.
INDEX_BLOCK, QUERY_BLOCK, PER_TASK = 131_072, 262_144, 30_000
#: Index rows of a piece of work above which it is partitioned again, the sample it learns from, and the recall it asks for.
AGAIN, AGAIN_SAMPLE, AGAIN_RECALL = 32_768, 8_192, 0.998
GRAPH_K = 10
#: Query and index rows that are compared at once: what comes of them stays in a core's cache. The product is divisible by 8.
TILE = 512, 512


@dataclass
class Router:
    """The classifier: a vector's best part is where it is indexed, its parts of at least ``least`` are searched.

    The shares are the index and query rows of each part for one vector, as the sample has them.
    """

    weights: np.ndarray
    bias: np.ndarray
    least: float
    index_share: np.ndarray
    query_share: np.ndarray
    turn: np.ndarray | None = None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best part of each row; (row, part) of all others to be searched."""
        p = self.probabilities(x)
        best = p.argmax(1)
        p[np.arange(len(x)), best] = -1.0
        row, part = np.nonzero(p >= self.least)
        return best, row, part


def exact_neighbours(x: np.ndarray, k: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indices and cosines of the k nearest rows of each row of unit vectors, itself left out."""
    n = len(x)
    k = min(k, n - 1)
    at, sim = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for s in range(0, n, step):
        c = x[s : s + step] @ x.T
        c[np.arange(len(c)), np.arange(s, s + len(c))] = -2
        best = np.argpartition(-c, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(c, best, 1)
        o = np.argsort(-v, axis=1, kind="stable")
        at[s : s + step], sim[s : s + step] = np.take_along_axis(best, o, 1), np.take_along_axis(v, o, 1)
    return at, sim


def balanced_parts(x: np.ndarray, graph: np.ndarray, depth: int, passes: int = 6) -> np.ndarray:
    """A part of 2^depth for each row: balanced halves of halves, with few edges of ``graph`` cut."""
    n = len(x)
    src = np.repeat(np.arange(n), graph.shape[1])
    a, b = np.concatenate([src, graph.ravel()]), np.concatenate([graph.ravel(), src])
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(5)
    for _ in range(depth):
        nxt = np.zeros(n, np.int64)
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            y = x[own] - x[own].mean(0)
            v = rng.standard_normal(x.shape[1]).astype(np.float32)
            for _ in range(8):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) + 1e-12
            nxt[own[np.argsort(y @ v, kind="stable")[len(own) // 2 :]]] = 1
        same = part[a] == part[b]
        sa, sb = a[same], b[same]
        for _ in range(passes):
            ones = np.bincount(sa, weights=nxt[sb], minlength=n)
            degree = np.bincount(sa, minlength=n)
            gain = np.where(nxt == 1, degree - 2 * ones, 2 * ones - degree)  # edges won by a change of side
            moved = 0
            for p in range(part.max() + 1):
                own = part == p
                left, right = (np.flatnonzero(own & (nxt == s)) for s in (0, 1))
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = min(len(left), len(right))
                k = int((gain[left[:m]] + gain[right[:m]] > 0).sum() * 0.7)
                nxt[left[:k]], nxt[right[:k]] = 1, 0
                moved += k
            if not moved:
                break
        part = part * 2 + nxt
    return part


def train_router(x: np.ndarray, expected: int, k: int, recall: float, floor: float) -> Router:
    """From sample vectors of unit length; ``expected`` is the number of all vectors."""
    want = max(1, min(expected // PART, len(x) // PER_PART))
    depth = max(0, int(np.floor(np.log2(want))))
    parts = 1 << depth
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32), 1.0, np.ones(1), np.zeros(1))
    graph, sim = exact_neighbours(x, GRAPH_K)
    part = balanced_parts(x, graph, depth)
    # a vector's target: its own part, and those of its neighbours by the fourth power of the cosine
    near_parts = np.concatenate([part[:, None], part[graph]], 1)
    shares = np.concatenate([np.ones((len(x), 1), np.float32), np.maximum(sim, 0.0) ** 4], 1)
    shares /= shares.sum(1, keepdims=True)
    rng = np.random.default_rng(11)
    held = len(x) // 8  # not trained on; they say how probable is enough
    w, b = np.zeros((x.shape[1], parts), np.float32), np.zeros(parts, np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    t = 0
    for epoch in range(24):
        order = held + rng.permutation(len(x) - held)
        for s in range(0, len(order), 512):
            own = order[s : s + 512]
            y = x[own]
            z = y @ w + b
            z = np.exp(z - z.max(1, keepdims=True))
            g = z / z.sum(1, keepdims=True)
            np.subtract.at(g, (np.arange(len(own))[:, None], near_parts[own]), shares[own])
            g /= len(own)
            t += 1
            for p, m, v, d in ((w, mw, vw, y.T @ g), (b, mb, vb, g.sum(0))):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (0.15 if epoch < 16 else 0.03) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    router = Router(w, b, 1.0, np.ones(parts), np.ones(parts))
    # pairs to judge by: neighbours in the sample, whose vectors are sparse, stand closer in the table;
    # so each vector held out gets neighbours by a random step to a cosine that the sample's pairs have
    known = sim[:, :k][sim[:, :k] >= floor]
    if floor > 0 and len(known) >= 20:
        a = x[np.repeat(np.arange(held), k)]
        c = rng.choice(known, (len(a), 1)).astype(np.float32)
        step = rng.standard_normal(a.shape, dtype=np.float32)
        step -= (step * a).sum(1, keepdims=True) * a
        b = c * a + np.sqrt(np.maximum(1 - c * c, 0)) * step / np.sqrt((step * step).sum(1, keepdims=True))
    else:
        a, b = x[np.repeat(np.arange(held), k)], x[graph[:held, :k].ravel()]
    at = np.empty(len(a), np.float32)
    for s in range(0, len(a), 2048):  # a pair is found from either side
        pa_, pb_ = router.probabilities(a[s : s + 2048]), router.probabilities(b[s : s + 2048])
        own, ta, tb = np.arange(len(pa_)), pa_.argmax(1), pb_.argmax(1)
        at[s : s + 2048] = np.where(ta == tb, 1.0, np.maximum(pa_[own, tb], pb_[own, ta]))
    router.least = 0.0 if recall >= 1 else float(np.sort(at)[min(len(at) - 1, int((1 - recall) * len(at)))])
    best, _, part = (np.concatenate(z) for z in zip(*(router.parts(x[k : k + 2048]) for k in range(0, len(x), 2048)), strict=True))
    router.index_share, router.query_share = np.bincount(best, minlength=parts) / len(x), np.bincount(part, minlength=parts) / len(x)
    return router


def turned(x: np.ndarray) -> np.ndarray:
    """An orthogonal matrix that brings the directions in which unit vectors vary most to the front."""
    return np.ascontiguousarray(np.linalg.eigh(x.T.astype(np.float64) @ x)[1][:, ::-1]).astype(np.float32)


def packed(x: np.ndarray) -> pa.Array:
    """Vectors in 12-bit fixed point, each by its greatest number; two numbers in three bytes."""
    q = np.rint(x * (2047.0 / np.maximum(np.abs(x).max(1, keepdims=True), 1e-30))).astype(np.int32) + 2048
    if q.shape[1] % 2:
        q = np.concatenate([q, np.full((len(q), 1), 2048, np.int32)], 1)
    a, b = q[:, ::2], q[:, 1::2]
    data = np.stack([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4], 2).astype(np.uint8)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (3 * a.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of ``packed``."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), (dim + 1) // 2, 3).astype(np.int32)
    x = np.empty((len(column), 2 * data.shape[1]), np.float32)
    x[:, ::2], x[:, 1::2] = data[:, :, 0] | ((data[:, :, 1] & 15) << 8), (data[:, :, 1] >> 4) | (data[:, :, 2] << 4)
    x = x[:, :dim] - 2048
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable vectors: all numbers there and finite, not all zero."""
    lens = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lens == dim)
    flat = (column if len(at) == len(column) else column.take(pa.array(at))).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(at), dim)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(x).all(1) & (norm > 0) & np.isfinite(norm)
    return at[good], (x[good] / norm[good, None]).astype(np.float32)


def _hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of the vectors' bytes, -0.0 counting as 0.0."""
    from lawstrata.llm.words import mix

    h = np.zeros(len(x), np.uint64)
    bits = (x + np.float32(0)).view(np.uint32).astype(np.uint64)
    for j in range(x.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, j] + np.uint64(j + 1))
    return h.view(np.int64)


def _keys(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column("vec"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), batch.column("ord").take(pa.array(at)), pa.array(_hashes(x), pa.int64())], names=["id", "ord", "v"])

    return run


def _route(dim: int, router: Router | None):
    """(part, side, v, vec) rows: an index row (side 0, or 1 if it also asks) in the best part, query rows (side 2) in the others searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are sent once
        for batch in batches:
            at, x = unit_rows(batch.column("vec"), dim)
            v = _hashes(x)
            new = [i for i, h in enumerate(v.tolist()) if not (h in seen or seen.add(h))]
            x, v, ask = x[new], v[new], np.asarray(batch.column("ask").take(pa.array(at[new])), bool)
            if not len(x):
                continue
            best, row, part = (np.zeros(len(x), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)) if router is None else router.parts(x)
            keep = ask[row]
            row, part = row[keep], part[keep]
            y = x if router is None or router.turn is None else x @ router.turn
            side = np.concatenate([np.where(ask, 1, 0), np.full(len(row), 2)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([best, part]), pa.int32()), pa.array(side, pa.int32()), pa.array(np.concatenate([v, v[row]]), pa.int64()), packed(y).take(pa.array(np.concatenate([np.arange(len(y)), row])))], names=["part", "side", "v", "vec"])

    return run


def reaching(q: np.ndarray, x: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of x) of all products of at least ``floor``, of which there should be few; for a row of q those of x ascend."""
    product, hit = np.empty(TILE[0] * TILE[1], np.float32), np.zeros(TILE[0] * TILE[1], bool)
    words = hit.view(np.uint64)
    r, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for u in range(0, len(x), TILE[1]):
        xt = np.ascontiguousarray(x[u : u + TILE[1]].T)
        for s in range(0, len(q), TILE[0]):
            part = q[s : s + TILE[0]]
            n = len(part) * xt.shape[1]
            np.matmul(part, xt, out=product[:n].reshape(len(part), -1))
            np.greater_equal(product[:n], np.float32(floor), out=hit[:n])
            hit[n : n + 7] = False  # the rest of the last word
            some = np.flatnonzero(words[: (n + 7) // 8])
            if len(some):
                row, col = np.divmod((some[:, None] * 8 + np.arange(8))[hit.reshape(-1, 8)[some]], xt.shape[1])
                r.append(s + row)
                j.append(u + col)
    return np.concatenate(r), np.concatenate(j)


def above(q: np.ndarray, x: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, cosine) of all pairs with at least ``floor``, which is above 0."""
    d = q.shape[1] // 2
    if d < 16:
        c = q @ x.T
        r, j = np.nonzero(c >= np.float32(floor))
        return r, j, c[r, j]
    # a cosine is at most that of the first numbers plus the product of the others' lengths
    bound = lambda y: np.concatenate([y[:, :d], np.sqrt((y[:, d:] ** 2).sum(1, keepdims=True))], 1)
    r, j = reaching(bound(q), bound(x), floor - 1e-5)
    c = np.empty(len(r), np.float32)
    for s in range(0, len(r), 1 << 18):
        c[s : s + (1 << 18)] = np.einsum("ij,ij->i", q[r[s : s + (1 << 18)]], x[j[s : s + (1 << 18)]])
    keep = c >= np.float32(floor)
    return r[keep], j[keep], c[keep]


def _rerank(dim: int, k: int, floor: float, recall: float):
    """Rows come by place, which is cell * 4 + side: index rows (0), index rows that also ask (1), query rows (2)."""

    def best_of(q: np.ndarray, qv: np.ndarray, x: np.ndarray, xv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, neighbour, cosine): the k best of each query among x, itself left out."""
        if floor > 0:  # few reach it; sort those only
            r, j, val = above(q, x, floor)
            other = qv[r] != xv[j]
            r, j, val = r[other], j[other], val[other]
            o = np.lexsort((-val, r))
            r, j, val = r[o], j[o], val[o]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            return qv[r[keep]], xv[j[keep]], val[keep]
        out = []
        for s in range(0, len(q), 512):
            c = q[s : s + 512] @ x.T
            if len(own := np.flatnonzero(np.isin(qv[s : s + 512], xv))):
                c[own, np.searchsorted(xv, qv[s + own])] = -2  # xv ascends
            m = min(k, c.shape[1])
            best = np.argpartition(-c, m - 1, axis=1)[:, :m]
            val = np.take_along_axis(c, best, 1)
            r, j = np.nonzero(val >= max(floor, -1.5))
            out.append((qv[s + r], xv[best[r, j]], val[r, j]))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    class Index:
        """The index rows of a piece of work; many of them in parts of their own, which a router learns from a sample of them."""

        def __init__(self, x: np.ndarray, v: np.ndarray):
            self.router, self.parts = None, [(x, v)]
            if len(x) > AGAIN and recall < 1:
                sample = x[np.argsort(v, kind="stable")[:AGAIN_SAMPLE]]  # by hash
                self.router = train_router(sample, len(x), k, max(recall, AGAIN_RECALL), floor)
                own = np.concatenate([self.router.probabilities(x[s : s + 4096]).argmax(1) for s in range(0, len(x), 4096)])
                self.parts = [(x[own == p], v[own == p]) for p in range(len(self.router.bias))]

        def ask(self, q: np.ndarray, qv: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(q), 8192):
                part, pv = q[s : s + 8192], qv[s : s + 8192]
                near = None
                if self.router is not None:
                    p = self.router.probabilities(part)
                    near = p >= self.router.least
                    near[np.arange(len(p)), p.argmax(1)] = True
                for n, (x, v) in enumerate(self.parts):
                    at = slice(None) if near is None else np.flatnonzero(near[:, n])
                    if len(x) and len(part[at]):
                        a, b, c = best_of(part[at], pv[at], x, v)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c.astype(np.float64))], names=["q", "n", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, xs, vs, asks, index = None, [], [], [], None
        qs: list[np.ndarray] = []
        qvs: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal index, qs, qvs
            if index is None and xs:
                x, v, ask = np.concatenate(xs), np.concatenate(vs), np.concatenate(asks)
                _, first = np.unique(v, return_index=True)
                index = Index(x[first], v[first])
                own = first[ask[first]]
                if len(own):
                    yield from index.ask(x[own], v[own])
            if index is not None and qs:
                q, qv = np.concatenate(qs), np.concatenate(qvs)
                _, first = np.unique(qv, return_index=True)
                yield from index.ask(q[first], qv[first])
            qs, qvs = [], []

        for batch in batches:
            places = np.asarray(batch.column("place"))
            cells = places >> 2
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if cells[s] != cell:
                    yield from flush()
                    cell, xs, vs, asks, index = cells[s], [], [], [], None
                part = batch.slice(s, e - s)
                x = unpacked(part.column("vec"), dim)
                side, v = places[s:e] & 3, np.asarray(part.column("v"))
                inner = side < 2
                if inner.any():
                    xs.append(x[inner])
                    vs.append(v[inner])
                    asks.append(side[inner] == 1)
                if (~inner).any():
                    qs.append(x[~inner])
                    qvs.append(v[~inner])
                    if sum(map(len, qs)) >= 8192:
                        yield from flush()
        yield from flush()

    return run


def most_similar(df: DataFrame, id_col: str, vector_col: str, k: int, order_col: str | None = None, dim: int | None = None, min_cosine: float = -1.0, recall: float = 0.97, queries: Column | None = None, sample: int | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): for each vector its k most similar others with at least ``min_cosine``.

    * Vectors that are null, all zero, not of ``dim`` numbers, or hold a null, NaN or infinite number
      are left out, as are null ids. ``dim`` defaults to the most frequent length.
    * Of a repeated id, the row with the greatest ``order_col`` among the usable ones counts.
    * Vectors of unequal length are compared by cosine. Copies count as neighbours of
      cosine 1; of many copies, the least k ids are taken. Other ties go by a hash of the vectors.
    * ``queries`` (a condition on ``df``) restricts who asks, not who is found.
    * An empty table, or a single vector, gives no rows. Other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "knn")
    src = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vec"), (F.lit(0) if order_col is None else F.col(order_col)).alias("ord"), F.coalesce(F.lit(True) if queries is None else queries, F.lit(False)).alias("ask")).where("id is not null and vec is not null")
    if dim is None:
        lengths = src.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        dim = lengths[0]["d"] if lengths else 1
    empty = spark.createDataFrame([], df.select(F.col(id_col).alias("id"), F.col(id_col).alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).schema)
    id_type, ord_type = src.schema["id"].dataType.simpleString(), src.schema["ord"].dataType.simpleString()
    keys = src.select("id", "ord", "vec").mapInArrow(_keys(dim), f"id {id_type}, ord {ord_type}, v bigint")
    cur = keys.groupBy("id").agg(F.max(F.struct("ord", "v")).alias("r")).select("id", F.col("r.v").alias("v"))
    cur = scratch.cut(cur, "current")
    total = cur.count()
    if total < 2:
        return empty
    stale = scratch.cut(keys.join(cur, ["id", "v"], "left_anti").select("v").distinct().join(cur, "v", "left_anti"), "stale")
    has_stale = stale.limit(1).count() > 0
    sample = sample or min(SAMPLE_MOST, max(SAMPLE, total // 64))
    near_size = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / total))
    rows = src.where(near_size).select("vec").limit(sample).toArrow().column("vec").combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], pa.list_(pa.float32()))
    x = unit_rows(rows, dim)[1]
    x = x[np.unique(_hashes(x), return_index=True)[1]]
    router = train_router(x, total, k, recall, min_cosine) if len(x) >= 2 * PER_PART else None
    if router is not None:
        router.turn = turned(x)
    routed = src.select("id", "vec", "ask").mapInArrow(_route(dim, router), "part int, side int, v bigint, vec binary")
    if has_stale:
        routed = routed.join(stale, "v", "left_anti")
    parts = 1 if router is None else len(router.bias)
    blocks = [] if router is None else [(p, int(np.ceil(i * total / INDEX_BLOCK)), int(np.ceil(q * total / QUERY_BLOCK))) for p, (i, q) in enumerate(zip(router.index_share, router.query_share, strict=True))]
    blocks = [b for b in blocks if b[1] > 1 or b[2] > 1]  # no more than there are parts
    if blocks:
        cells = _blocks(routed, spark.createDataFrame(blocks, "part int, bi int, bq int"))
    else:
        cells = routed.select(F.col("part").cast("bigint").alias("cell"), "side", "v", "vec")
    copies = 1.0 if router is None else 1.0 + float(router.query_share.sum())
    pieces = parts + sum(i * q - 1 for _, i, q in blocks)
    n = max(parallelism(spark), min(pieces, int(np.ceil(total * copies / PER_TASK))))
    # cell and side in one number: of what is shuffled, all but the vector should be little
    cells = cells.select((F.col("cell") * 4 + F.col("side")).alias("place"), "v", "vec")
    found = cells.repartition(n, F.shiftright("place", 2)).sortWithinPartitions("place").mapInArrow(_rerank(dim, k if queries is not None else 2 * k, min_cosine, recall), "q bigint, n bigint, cosine double")
    if queries is None:  # a pair found from one side counts for both; twice k, as one side may have nearer ones
        both = F.array(F.struct("q", "n", "cosine"), F.struct(F.col("n").alias("q"), F.col("q").alias("n"), "cosine"))
        found = found.select(F.explode(both).alias("x")).select("x.*")  # not a union, which would rerank twice
    return _with_copies(found, cur, scratch, k)


def _blocks(routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every index block of a large part meets every query block of it, in a cell of their own."""
    r = routed.join(F.broadcast(sizes), "part", "left").select("part", "side", "v", "vec", F.coalesce("bi", F.lit(1)).alias("bi"), F.coalesce("bq", F.lit(1)).alias("bq"))
    i, q = F.pmod(F.xxhash64("v"), F.col("bi")).cast("int"), F.pmod(F.xxhash64("v", F.lit(1)), F.col("bq")).cast("int")
    # in a divided part, a row that is indexed and asks becomes one row of each kind
    divided = (F.col("bi") > 1) | (F.col("bq") > 1)
    sides = F.when(divided & (F.col("side") == 1), F.array(F.lit(0), F.lit(2))).otherwise(F.array("side"))
    r = r.withColumn("side", F.explode(sides))
    i_of = F.when(F.col("side") < 2, F.array(i)).otherwise(F.sequence(F.lit(0), F.col("bi") - 1))
    q_of = F.when(F.col("side") < 2, F.sequence(F.lit(0), F.col("bq") - 1)).otherwise(F.array(q))
    r = r.withColumn("i", F.explode(i_of)).withColumn("j", F.explode(q_of))
    return r.select(((F.col("part").cast("bigint") * 4096 + F.col("i")) * 4096 + F.col("j")).alias("cell"), "side", "v", "vec")


def _with_copies(found: DataFrame, cur: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """From neighbours between distinct vectors to neighbours between ids."""
    from pyspark.sql import Window

    best = found.groupBy("q", "n").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "n"))
    best = scratch.cut(best.withColumn("r", rank).where(F.col("r") <= k), "best")
    many = scratch.cut(cur.groupBy("v").count().where("count > 1").select("v"), "many")
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    if not many.limit(1).count():
        pairs = best.join(cur.select(F.col("v").alias("q"), "id"), "q").join(cur.select(F.col("v").alias("n"), F.col("id").alias("neighbour")), "n")
        return pairs.select("id", "neighbour", "cosine", F.col("r").alias("rank"))
    # the least k + 1 ids of every vector stand for its copies
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    single = cur.join(many, "v", "left_anti").select("v", "id")
    heads = single.union(cur.join(many, "v", "left_semi").select("v", "id").withColumn("p", place).where(F.col("p") <= k + 1).select("v", "id"))
    pairs = best.join(cur.select(F.col("v").alias("q"), "id"), "q").join(heads.select(F.col("v").alias("n"), F.col("id").alias("neighbour")), "n").select("id", "neighbour", "cosine")
    copies = cur.join(many, "v", "left_semi")
    own = copies.join(heads.withColumnRenamed("id", "neighbour"), "v").where(F.col("id") != F.col("neighbour")).select("id", "neighbour", F.lit(1.0).alias("cosine"))
    return pairs.union(own).withColumn("rank", order).where(F.col("rank") <= k)
