"""Near-duplicate texts by multi-index hashing.

A text's fingerprint has 50 symbols, each the minimum of one hash function over the text's word
shingles: two texts agree in a symbol with the probability of their Jaccard similarity, so the
Hamming distance of fingerprints (differing symbols) measures it. The fingerprint is cut into ten
segments of five symbols. In each segment every text enumerates its Hamming ball of radius one: a
ball over so large an alphabet is the union of five patterns, each with one symbol masked, and two
texts are within radius one in a segment just if they share a pattern. Patterns are the keys of one
hash table for each (segment, mask); matches are verified by the complete Hamming distance, then by
the exact similarity of the shingle sets.

At similarity s a pair meets in a segment with probability s^5 + 5 s^4 (1 - s), so it is found with
0.984 at s = 0.6, 0.9995 at 0.7 and more above.

Texts with equal shingle sets form a class that enters the tables once. A pattern that many classes share
is cut into blocks; each pair of blocks is a piece of work of its own, which compares whole fingerprints
where they lie and gives out only pairs that are close, and those only at the first pattern they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawstrata.llm.words import jaccard, mix, shingles, words
from lawstrata.operators.components import connected_components
from lawstrata.session import Scratch, enough_partitions, parallelism

SEGMENTS, WIDTH = 10, 5
SYMBOLS = SEGMENTS * WIDTH
#: Classes that may share a pattern before it is hot, and classes of a block of a hot pattern.
COMMON, BLOCK = 64, 2048
#: Copies up to which a class is written out as all pairs of keys; above, as links to its least key.
SPELL_OUT = 64
#: Keys of a block of a class that is written out.
KEYS = 256
#: Cells of the bitmap that thins the rows before the second shuffle: 65,536 words, whatever the data.
CELLS = 1 << 22

_rng = np.random.default_rng(20_240_229)
_MUL = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def fingerprint(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, SYMBOLS) array of 16-bit symbols; no set may be empty."""
    starts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    flat = np.concatenate(sets)
    low = np.stack([np.minimum.reduceat(flat * _MUL[k] + _ADD[k], starts) for k in range(SYMBOLS)], 1)
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _prints(size: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sig: list[bytes | None] = [None] * len(texts)
            digest: list[bytes | None] = [None] * len(texts)
            at, sets = [], []
            for k, t in enumerate(texts):
                w = words(t) if t else []
                if len(w) >= least and len(w) >= size:
                    s = shingles(w, size)
                    at.append(k)
                    sets.append(s)
                    digest[k] = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
            if at:
                for k, row in zip(at, fingerprint(sets), strict=True):
                    sig[k] = row.tobytes()
            kept = [t if d is not None else None for t, d in zip(texts, digest, strict=True)]
            cid = pa.array([None if d is None else int.from_bytes(d, "little", signed=True) for d in digest], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("key"), batch.column("ord"), cid, pa.array(sig, pa.binary()), pa.array(kept, pa.string())], names=["grp", "key", "ord", "cid", "sig", "text"])

    return run


def _close(least_equal: int):
    """Pairs whose fingerprints agree in at least so many symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
            yield batch.filter(pa.array((a == b).sum(1) >= least_equal)).select(["a", "b"])

    return run


def _verify(size: int, threshold: float):
    """Pairs whose shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, np.ndarray] = {}

            def of(cid: int, text: str, seen: dict = seen) -> np.ndarray:
                if cid not in seen:
                    seen[cid] = shingles(words(text), size)
                return seen[cid]

            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True)
            sim = np.array([jaccard(of(a, ta), of(b, tb)) for a, b, ta, tb in rows], np.float64)
            part = batch.append_column("similarity", pa.array(sim)).filter(pa.array(sim >= threshold, pa.bool_()))
            yield part.select(["a", "b", "similarity"])

    return run


def _schema(df: DataFrame, *names: str, **more: str) -> T.StructType:
    """Columns of ``df`` and further ones, all of them nullable."""
    schema = T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])
    for n, kind in more.items():
        schema.add(n, T.DataType.fromDDL(kind))
    return schema


def _patterns() -> Column:
    """The 50 keys of a fingerprint: for each segment, the ball of radius one as its masked patterns; the low six bits number them."""
    keys = []
    for s in range(SEGMENTS):
        for m in range(WIDTH):
            first = 2 * WIDTH * s + 1
            rest = F.concat(F.substring("sig", first, 2 * m), F.substring("sig", first + 2 * m + 2, 2 * (WIDTH - 1 - m)))
            keys.append(F.shiftleft(F.xxhash64("g", rest), 6).bitwiseOR(F.lit(s * WIDTH + m)))
    return F.array(*keys)


def _first_shared(x: np.ndarray, y: np.ndarray, least_equal: int, pattern: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of x, of y) that agree in at least ``least_equal`` symbols and share no pattern before this one; of one block, each pair once."""
    segment, mask = divmod(pattern, WIDTH)
    total = np.zeros((len(x), len(y)), np.uint8)
    before = np.zeros((len(x), len(y)), bool)
    for s in range(SEGMENTS):
        own = np.zeros_like(total)
        for k in range(s * WIDTH, (s + 1) * WIDTH):
            own += x[:, k : k + 1] == y[:, k]
        if s < segment:
            before |= own >= WIDTH - 1
        elif s == segment and mask:
            before |= own == WIDTH  # shares this segment's first pattern
        total += own
    found = (total >= least_equal) & ~before
    return np.nonzero(np.triu(found, 1) if same else found)


def _hot(least_equal: int):
    """Pairs of close fingerprints within cells (key, i, j) of hot patterns; rows come by cell and block."""

    def pairs(cell: tuple, cids: list[np.ndarray], sigs: list[np.ndarray], blks: list[np.ndarray]) -> pa.RecordBatch:
        _, i, j, pattern = cell
        cid, blk = np.concatenate(cids), np.concatenate(blks)
        sig = np.concatenate(sigs)
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s in range(0, len(left), 512):
            at = left[s : s + 512]
            onward = right[s:] if i == j else right  # of one block, what comes later
            r, c = _first_shared(sig[at], sig[onward], least_equal, pattern, i == j)
            a.append(cid[at[r]])
            b.append(cid[onward[c]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            key, i, j, p = (np.asarray(batch.column(c)) for c in ("key", "i", "j", "p"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            cid, blk = np.asarray(batch.column("cid")), np.asarray(batch.column("blk"))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                cell = int(key[s]), int(i[s]), int(j[s]), int(p[s])
                if cell != now:
                    if now:
                        yield pairs(now, *held)
                    now, held = cell, ([], [], [])
                for x, y in zip(held, (cid, sig, blk), strict=True):
                    x.append(y[s:e])
        if now:
            yield pairs(now, *held)

    return run


def _matches(prints: DataFrame, scratch: Scratch, least_equal: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes that share a pattern and agree in at least ``least_equal`` symbols."""
    table = prints.select("cid", F.explode(_patterns()).alias("key"))
    # numbers only, so that the aggregate hashes and does not sort
    shared = table.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("a"), F.max("cid").alias("b"))
    shared = scratch.cut(shared.where("n > 1"), "shared")
    two = shared.where("n = 2").select("a", "b")
    many = shared.where("n > 2").select("key", "n")
    cell = F.shiftright("key", 6).bitwiseAND(F.lit(CELLS - 1))
    bitmap = many.withColumn("c", cell).groupBy(F.shiftright("c", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("bits"))
    members = table.withColumn("c", cell).withColumn("word", F.shiftright("c", 6)).join(F.broadcast(bitmap), "word").where("shiftrightunsigned(bits, cast(c % 64 as int)) & 1 = 1")
    members = members.select("key", "cid").join(many, "key")
    hot = many.where(F.col("n") > COMMON)
    heated = hot.limit(1).count() > 0
    if heated:  # read by both branches
        members = scratch.cut(members, "members")
    lists = members.where(F.col("n") <= COMMON).groupBy("key").agg(F.array_sort(F.collect_list("cid")).alias("m"))
    each = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = two.union(lists.select(F.explode(each).alias("p")).select("p.a", "p.b")).distinct()
    side = lambda x: prints.select(F.col("cid").alias(x), F.col("sig").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_close(least_equal), _schema(pairs, "a", "b"))
    if not heated:
        return near
    rows = members.where(F.col("n") > COMMON).join(prints.select("cid", "sig"), "cid")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    work = hot.select(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK)).alias("rows")).first()["rows"]
    rows = rows.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("p"), "blk", "cid", "sig")
    line = rows.repartition(enough_partitions(prints.sparkSession, work, 20_000), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return near.union(line.mapInArrow(_hot(least_equal), _schema(pairs, "a", "b"))).distinct()


def near_duplicate_classes(df: DataFrame, key: Column | str, text: Column | str, order: Column | str | None = None, group: Column | str | None = None, threshold: float = 0.8, shingle: int = 5, least_words: int = 1) -> tuple[DataFrame, DataFrame, Scratch]:
    """(members, links): members has grp, key, cid (class of equal shingle sets); links has a, b, similarity.

    ``links`` are the pairs of different classes, a < b, of one group whose similarity reaches
    ``threshold``; a class belongs to one group. Keys are compared as given; of a repeated key the row with the greatest ``order``
    counts, ties go to the row with the greatest class. Null keys, and texts that are null, empty or
    have fewer than ``least_words`` words or no shingle, are in neither table. Texts are used whole.
    ``threshold`` must be at least 0.5: below, the tables would miss too much.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must lie between 0.5 and 1")
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    key, text, order, group = (F.col(c) if isinstance(c, str) else c for c in (key, text, order, group))
    src = df.select((F.lit("") if group is None else group).alias("grp"), key.alias("key"), (F.lit(0) if order is None else order).alias("ord"), text.alias("text")).where("key is not null")
    prints = src.mapInArrow(_prints(shingle, least_words), _schema(src, "grp", "key", "ord", cid="bigint", sig="binary", text="string"))
    now = prints.groupBy("grp", "key").agg(F.max_by(F.struct("cid", "sig", "text"), F.struct("ord", "cid")).alias("r"))
    docs = scratch.cut(now.where("r.cid is not null").select("grp", "key", F.xxhash64("grp", "r.cid").alias("cid"), F.xxhash64("grp").alias("g"), "r.sig", "r.text"), "docs")
    classes = docs.groupBy("cid").agg(F.first("g").alias("g"), F.first("sig").alias("sig"))
    classes = scratch.cut(classes, "classes")
    side = lambda df, x, c: df.select(F.col("cid").alias(x), F.col(c).alias(f"{c[0]}{x}"))
    # 4.4 standard deviations below the expected number of equal symbols
    floor = int(SYMBOLS * threshold - 4.4 * (SYMBOLS * threshold * (1 - threshold)) ** 0.5) if threshold < 0.9 else int(SYMBOLS * threshold * 0.75)
    near = scratch.cut(_matches(classes, scratch, floor), "near")
    held = near.select(F.col("a").alias("cid")).union(near.select("b")).distinct()
    texts = docs.select("cid", "text").join(held, "cid", "left_semi").groupBy("cid").agg(F.min("text").alias("text"))
    texts = scratch.cut(texts, "texts")
    both = near.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b").select("a", "b", "ta", "tb")
    links = both.mapInArrow(_verify(shingle, threshold), _schema(near, "a", "b", similarity="double"))
    return docs.select("grp", "key", "cid"), scratch.cut(links, "links"), scratch


def near_duplicate_pairs(df: DataFrame, key: Column | str, text: Column | str, order: Column | str | None = None, group: Column | str | None = None, spell_out: int | None = SPELL_OUT, **options) -> DataFrame:
    """(grp, key_a, key_b), key_a < key_b: the pairs of keys of one group whose texts are near-duplicates.

    A class of more than ``spell_out`` texts with equal shingle sets is written as links between its
    least key and each other key, and its links to other classes as those of its least key; every
    smaller class is written out in full. None writes all classes out in full, whatever their size.
    """
    members, links, scratch = near_duplicate_classes(df, key, text, order, group, **options)
    size = members.groupBy("cid").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    m = members.join(size, "cid")
    star = None
    if spell_out is not None:
        m = scratch.cut(m, "members")
        star = m.where((F.col("n") > spell_out) & (F.col("key") != F.col("least"))).select("grp", F.col("least").alias("x"), F.col("key").alias("y"))
        m = m.where((F.col("n") <= spell_out) | (F.col("key") == F.col("least"))).withColumn("n", F.when(F.col("n") <= spell_out, F.col("n")).otherwise(1))
    # a large class is cut into blocks of keys; pairs of blocks are dealt out before they become pairs of keys
    blk = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / KEYS)).alias("blk")
    blocks = scratch.cut(m.groupBy("cid", blk).agg(F.first("grp").alias("grp"), F.first("n").alias("n"), F.collect_list("key").alias("keys")), "blocks")
    side = lambda x, keys, *more: blocks.select(F.col("cid").alias(x), F.col("keys").alias(keys), *more)
    across = links.select("a", "b").join(side("a", "xs", "grp"), "a").join(side("b", "ys"), "b").select("grp", "xs", "ys", F.lit(False).alias("same"))
    several = blocks.where("n > 1")
    within = several.select("cid", "grp", F.col("keys").alias("xs"), F.col("blk").alias("i")).join(several.select("cid", F.col("keys").alias("ys"), F.col("blk").alias("j")), "cid").where("i <= j").select("grp", "xs", "ys", F.expr("i = j").alias("same"))
    pairs = across.union(within).repartition(parallelism(df.sparkSession))
    pairs = pairs.select("grp", "ys", "same", F.explode("xs").alias("x")).select("grp", "same", "x", F.explode("ys").alias("y")).where("not same or x < y").select("grp", "x", "y")
    if star is not None:
        pairs = pairs.union(star)
    return pairs.select("grp", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def near_duplicate_groups(df: DataFrame, key: Column | str, text: Column | str, order: Column | str | None = None, group: Column | str | None = None, **options) -> DataFrame:
    """(grp, key, group_id, n_copies, n_links): for each text its group of near-duplicates and the number of its links.

    Groups are the connected components of the links between classes; ``group_id`` is the least key of
    the group, ``n_copies`` the number of texts with the same shingle set, ``n_links`` the number of
    different classes it is linked with.
    """
    members, links, scratch = near_duplicate_classes(df, key, text, order, group, **options)
    comp = connected_components(links, "a", "b", scratch)
    degree = links.select(F.col("a").alias("cid")).union(links.select("b")).groupBy("cid").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("cid").agg(F.count("*").alias("n_copies"), F.min("key").alias("least"))
    classes = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).join(degree, "cid", "left")
    classes = scratch.cut(classes, "groups")
    name = classes.groupBy("comp").agg(F.min("least").alias("group_id"))
    classes = classes.join(name, "comp").select("cid", "group_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return members.join(classes, "cid").select("grp", "key", "group_id", "n_copies", "n_links")
