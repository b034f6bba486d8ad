"""Word shingles as 64-bit hashes, and MinHash signatures (numpy, one text at a time)."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z and every separator to a blank, on the bytes of a text.
LOWER = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that its powers have inverses
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word of the lower-cased text, in order.

    Words are maximal runs without white space. The hash of a word is a
    polynomial in its bytes, taken from prefix sums over the whole text.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], data == 32, [True])).astype(np.int8)))
    if not len(edge):
        return np.empty(0, np.uint64)
    start, end = edge[::2], edge[1::2]
    up = _grown("up", _BASE, len(data))[:len(data)]
    down = _grown("down", _INVERSE, len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's runs of ``words`` words; of a
    shorter text its whole sequence; empty without words."""
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    out = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + w[k:len(w) - n + 1 + k] + np.uint64(k + 1))
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return both, len(a) + len(b) - both


def signature_seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, n + 1, dtype=np.uint64)
    return mix(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(k + np.uint64(1 << 40))


def signature(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each seed the least of the shingles' values (high 32 bits of a keyed product)."""
    mult, add = seeds
    out = np.full(len(mult), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 512):
        values = shingles[at:at + 512, None] * mult + add
        np.minimum(out, values.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)
