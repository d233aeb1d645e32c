"""Words of a text and its word shingles, as lists and as sets of hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
# Words of a shingle of a set.
SHINGLE = 5


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode().lower().split()


def shingles(tokens: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; a shorter text is one run."""
    if len(tokens) <= size:
        return [b" ".join(tokens)] if tokens else []
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]


def hashes(features: list[bytes], seed: int = SEED) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(f, seed) for f in features), np.uint64, len(features))


def mixed(hashed: np.ndarray, n: int) -> np.ndarray:
    """The ``n``-th new hash of each hash: an offset and the finishing steps of SplitMix64."""
    x = hashed + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``SHINGLE`` words; a shorter text is one run."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    each = hashes(tokens)
    size = min(SHINGLE, len(each))
    total = np.full(len(each) - size + 1, size, np.uint64)
    for i in range(size):
        total = mixed(total, i) + each[i : len(each) - size + 1 + i]
    return np.unique(mixed(total, size))
