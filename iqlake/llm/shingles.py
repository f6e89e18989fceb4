"""Word shingles as 64-bit hashes, vectorised over whole texts."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the two polynomial hashes (fixed values).
BYTE_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word; words are maximal runs without ASCII white space, A-Z in lower case."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = SPACES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    if not len(edge):
        return np.zeros(0, np.uint64)
    starts, ends = edge[0::2], edge[1::2]
    # Horner's rule over all words at once, one step a byte of the longest word; long words are few, so work shrinks fast.
    size = ends - starts
    h = np.full(len(starts), 0x1234567, np.uint64) + size.astype(np.uint64)
    live = np.arange(len(starts))
    for j in range(int(size.max())):
        live = live[size[live] > j]
        if len(live) < 4 and j > 64:
            for k in live.tolist():
                for byte in raw[starts[k] + j : ends[k]].tolist():
                    h[k] = (int(h[k]) * int(BYTE_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            break
        h[live] = h[live] * BYTE_BASE + raw[starts[live] + j].astype(np.uint64) + np.uint64(1)
    return mix(h)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words are one shingle, no word none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = h * WORD_BASE + w[j : len(w) - k + 1 + j]
    return np.unique(mix(h + np.uint64(k)))


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, on sorted sets; False if either is empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlaps(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of a sorted set with several non-empty others, in one pass over these."""
    cat = np.concatenate(others)
    at = np.searchsorted(a, cat)
    at[at == len(a)] = 0
    return np.add.reduceat(a[at] == cat, np.cumsum([0, *(len(x) for x in others[:-1])]))
