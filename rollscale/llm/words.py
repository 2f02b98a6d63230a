"""Hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

from rollscale.llm.common import Memo, mix, remembered

MEMO = 200_000
STEP = 0x9E3779B97F4A7C15


def _memo() -> Memo:
    return remembered("words", lambda: Memo(MEMO))


def hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, a row per word."""
    memo = _memo()
    for w in memo.missing(set(words)):
        memo.young[w] = xxhash.xxh3_128_digest(w)
    data = b"".join(map(memo.young.__getitem__, words))
    return np.frombuffer(data, "<u8").reshape(-1, 2)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every run of `width` values, by doubling."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    step = STEP | 1
    power, have, sums, out, done = step, 1, h, None, 0
    rest = width
    while rest:
        if rest & 1:
            # `out` covers the first `done` values of a run, `sums` the next `have`.
            if out is None:
                out = sums
            else:
                n = len(sums) - done
                out = out[:n] * np.uint64(power) + sums[done : done + n]
            done += have
        rest >>= 1
        if rest:
            n = len(sums) - have
            sums = sums[:n] * np.uint64(power) + sums[have:]
            power, have = power * power % (1 << 64), have * 2
    n = len(h) - width + 1
    return mix(out[:n])


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; fewer words are one run."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    width = min(width, len(words))
    n = len(words) - width + 1
    out = h[:n, 0] + np.uint64(width)
    for k in range(1, width):
        out = mix(out) * np.uint64(STEP) + h[k : k + n, k & 1]
    return np.unique(mix(out))


def squeeze(values: np.ndarray) -> bytes:
    """Sorted unsigned values as byte planes of their differences, which compress well."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(len(steps), -1).T.tobytes()


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)
