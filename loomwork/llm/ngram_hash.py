"""Words of many texts as 64-bit hashes, vectorised over one byte buffer."""

from __future__ import annotations

import numpy as np

from loomwork.llm.common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _VALUE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD**i and its inverse modulo 2**64 for i < n."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up = np.full(size, _ODD, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    up, down = _POWERS[size]
    return up[:n], down[:n]


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte values times rising powers (one longer than raw), and the inverse powers: the
    hash of raw[a:b] is (sums[b] - sums[a]) * inverse[a]."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[:-1], out=sums[1:])
    return sums, down


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII lower case), and the number of words of each text. Equal words
    have equal hashes; different ones differ but for 64-bit accidents."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums, down = prefix_sums(_LOWER[raw])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    n = np.searchsorted(starts, stops, side="right")
    return hashes, np.diff(n, prepend=0)
