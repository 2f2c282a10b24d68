"""Vectorised hashing of bytes and word shingles: prefix polynomial hashes modulo 2**64 over a buffer of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd base with its inverse modulo 2**64, and multipliers of the final mix.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of texts that are hashed together.
BUFFER = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits; the low bits of a polynomial hash modulo 2**64 depend on low bits alone."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, n of them at least; those of a common buffer are remembered."""
    size = max(n, BUFFER + 1)
    if size not in _powers:
        made = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, "uint64")
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > BUFFER + 1:
            return made[0], made[1]
        _powers[size] = (made[0], made[1])
    return _powers[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base**place over all prefixes of ``data``."""
    out = np.zeros(len(data) + 1, "uint64")
    np.cumsum((data.astype("uint64") + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the ranges, independent of where they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def buffers(texts: list[bytes], size: int = BUFFER) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts that have up to ``size`` bytes together, or are one longer text."""
    i = total = 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) + 1 > size:
            yield i, j
            i, total = j, 0
        total += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ROLES = mixed(np.arange(1, 65, dtype="uint64") * np.uint64(BASE)) | np.uint64(1)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the index of each text's first word (with the end of all)."""
    lengths = np.fromiter((len(t) for t in texts), "int64", len(texts))
    data = np.frombuffer(b" ".join([*texts, b""]), "uint8")
    if lower:
        data = _LOWER[data]
    space = _IS_SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    firsts = np.searchsorted(begins, np.concatenate(([0], np.cumsum(lengths + 1))))
    return mixed(range_hash(prefix_hash(data), begins, ends) + (ends - begins).astype("uint64") * _M2), firsts


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; a shorter text is one shingle, or none."""
    out = []
    for i, j in buffers(texts):
        words, firsts = word_hashes(texts[i:j])
        total = max(len(words) - n + 1, 0)
        whole = np.zeros(total, "uint64")
        for k in range(n):
            whole += words[k : k + total] * _ROLES[k]
        whole = mixed(whole)
        for a, b in zip(firsts[:-1], firsts[1:]):
            if b - a >= n:
                out.append(np.unique(whole[a : b - n + 1]))
            elif b > a:
                w = words[a:b]
                out.append(mixed((w * _ROLES[: b - a]).sum(keepdims=True, dtype="uint64") + _ROLES[32 + b - a]))
            else:
                out.append(np.zeros(0, "uint64"))
    return out
