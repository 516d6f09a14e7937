"""Content-defined anchors: places in byte strings that equal surroundings mark alike.

The anchors of a text are its K-byte strings whose hash is the least in some window of W consecutive ones. Any
string of K + W - 1 bytes so holds an anchor, at the same offset wherever the string stands.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_229)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string of ``data``, by prefix sums of a polynomial modulo 2^64."""
    n = len(data)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(_BASE, n), out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * _powers(_INVERSE, n - k + 1))


def polynomial_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same hash of each stretch of ``data``, which may differ in length."""
    powers = _powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers, out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts])


def sliding(x: np.ndarray, w: int, f: np.ufunc, edge: int) -> np.ndarray:
    """``f`` over each window of ``w`` values, one for each start: a prefix and a suffix of two blocks meet in each."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, edge, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, w)
    ahead = f.accumulate(padded, axis=1).ravel()
    back = f.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents laid end to end in ``data``; ``starts`` has each document's start.

    No anchor crosses documents. Windows may, which only adds anchors at their edges.
    """
    h = gram_hashes(data, k)
    if len(h) == 0:
        return np.empty(0, np.int64), h
    for s in starts[1:]:
        h[max(0, s - k + 1) : s] = NONE
    at = least_in_windows(h, w)
    return at, h[at]


def least_in_windows(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the hashes that are the least of some window of ``w`` consecutive ones; ``NONE`` is no hash."""
    # windows that stick out at either end are filled up with no string
    wide = np.concatenate([np.full(w - 1, NONE), h, np.full(w - 1, NONE)])
    least = sliding(wide, w, np.minimum, NONE)
    most = sliding(np.where(least == NONE, np.uint64(0), least), w, np.maximum, np.uint64(0))
    return np.flatnonzero((most == h) & (h != NONE))
