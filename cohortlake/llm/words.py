"""Vectorised word splitting and 64-bit hashing over raw UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: ``[^\x20\x09-\x0D]`` by byte.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and every byte of a longer UTF-8 character.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, size: int) -> np.ndarray:
    """base**i for i below size, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < size:
        step = np.full(max(size, 1 << 16), _BASE if kind == "up" else _INVERSE, U)
        step[0] = 1
        have = np.cumprod(step, dtype=U)
        if len(have) <= 8 << 20:
            _powers[kind] = have
    return have[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s[i]: the sum over bytes before i of (byte + 1) * base**position."""
    s = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("up", max(1, len(data)))[: len(data)], out=s[1:])
    return s


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends]; equal bytes give equal values wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    raw = (sums[ends] - sums[starts]) * _power("down", int(starts.max()) + 1)[starts]
    return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of class ``inside`` within each row.

    Returns starts, ends and, for each row, the index of its first word
    (with the total appended).
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = inside[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = word[0]
    change[-1] = word[-1]
    np.not_equal(word[1:], word[:-1], out=change[1:-1])
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    edge = np.unique(edge)
    edge = edge[word[edge] & word[edge - 1]]  # a row's border inside a run ends one word and starts another
    change[edge] = False
    at = np.flatnonzero(change)
    starts = np.sort(np.concatenate([at[0::2], edge]))
    ends = np.sort(np.concatenate([at[1::2], edge]))
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``size`` words (all its words as one run
    if there are fewer) and the index of each row's first run."""
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(words)) - first[rows] if len(words) else np.zeros(0, np.int64)
    length = np.minimum(n, size)[rows]
    keep = at + length <= n[rows]
    begin = np.flatnonzero(keep)
    length = length[begin]
    h = np.zeros(len(begin), U)
    for j in range(size):
        live = length > j
        h[live] = mix(h[live] * U(0xC2B2AE3D27D4EB4F) + words[begin[live] + j] + U(j + 1))
    return h, np.concatenate([[0], np.cumsum(np.bincount(rows[begin], minlength=len(n)))]).astype(np.int64)
