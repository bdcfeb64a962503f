"""Words, word hashes and shingles in numpy, for use inside Arrow batches."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\W_]+")
MARK = re.compile(r"\[\[[^\]]*\]\]")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S33 = np.uint64(33)
_CACHE: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, ``[[...]]`` markers left out."""
    return WORD.findall(MARK.sub(" ", text).lower())


def word_hashes(tokens: list[str]) -> np.ndarray:
    if len(_CACHE) > 500_000:
        _CACHE.clear()
    out = []
    for w in tokens:
        h = _CACHE.get(w)
        if h is None:
            h = _CACHE[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(tokens: list[str], size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words than that give none."""
    if len(tokens) < size:
        return np.empty(0, np.uint64)
    h = word_hashes(tokens)
    n = len(h) - size + 1
    x = h[:n].copy()
    for k in range(1, size):
        x = mix(x * _A + h[k : k + n] + _B)
    return np.unique(mix(x))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if not len(a) and not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
