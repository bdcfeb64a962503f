"""Token counts with a public tokenizer's vocabulary file; its path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Where the vocabulary files of public tokenizers lie.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that cuts texts before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIMS = 3


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _projection(n: int) -> np.ndarray:
    """Signs by which each token adds to each of DIMS coordinates: a hashed vector projected at random."""
    return (np.random.default_rng(77).integers(0, 2, (n, DIMS), dtype=np.int8) * 2 - 1).astype(np.float32)


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        signs = _projection(enc.n_vocab)
        for batch in batches:
            n, at = [], np.zeros((batch.num_rows, DIMS), np.float32)
            for k, t in enumerate(batch.column("text").to_pylist()):
                ids = enc.encode_ordinary(t) if t else []
                n.append(len(ids))
                if ids:
                    # distinct tokens, so that a page is placed by what it speaks of, not by its length
                    own = np.unique(np.array(ids, np.int64))
                    at[k] = signs[own].sum(0) / np.sqrt(len(own))
            cols = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), *(pa.array(at[:, d]) for d in range(DIMS))], names=[*names, "tokens", *(f"c{d}" for d in range(DIMS))])

    return run


def measured(df: DataFrame, columns: dict[str, Column], text: Column, path: str = VOCABULARY) -> DataFrame:
    """``columns``, the number of tokens of the whole text (0 for null), and its place c0, c1, c2."""
    src = df.select(*(c.alias(n) for n, c in columns.items()), text.alias("text"))
    kinds = ", ".join(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in columns)
    return src.mapInArrow(_measure(path), f"{kinds}, tokens bigint, c0 float, c1 float, c2 float")
