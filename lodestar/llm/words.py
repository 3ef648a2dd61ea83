"""Words and word shingles of many texts at once, as 64-bit hashes.

A word is a longest run of bytes other than ASCII white space, with A-Z as a-z. A word's hash is a
polynomial over random byte values, taken from running sums, so a block of texts is hashed by a few
passes over its bytes and no Python code runs for each word.
"""

from __future__ import annotations

import numpy as np

from lodestar.llm.frames import mix, seeds

_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = seeds(256, 1)[LOWER]
_VALUE[_SPACE] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, kept and extended as needed."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_BACK, n)


def _segment(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _Powers.to(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _Powers.up[: len(data)], out=total[1:])
    hashes = (total[ends] - total[starts]) * _Powers.down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the texts starts and ends; a text's edge ends a word."""
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
    return starts, ends


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, text after text, and the place of each text's first word among them.

    ``spans`` are those of ``word_spans``, if they are known.
    """
    starts, ends = spans or word_spans(data, offsets)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        begin = int(starts[first])
        last = max(int(np.searchsorted(ends, begin + _SEGMENT, "right")), first + 1)
        stop = int(ends[last - 1])
        out[first:last] = _segment(data[begin:stop], starts[first:last] - begin, ends[first:last] - begin)
        first = last
    return out, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where each text's begin.

    ``size`` words make a shingle; a text of fewer words is one shingle, a text of none has none.
    """
    weights = seeds(size + 1, 2) | np.uint64(1)
    lengths = np.diff(firsts)
    n = len(hashes)
    whole = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        whole += hashes[j : j + len(whole)] * weights[j]
    whole = mix(whole + weights[size:] * np.uint64(size))
    short = np.zeros(len(lengths), np.uint64)
    for j in range(size - 1):
        has = lengths > j
        short[has] += hashes[firsts[:-1][has] + j] * weights[j]
    short = mix(short + lengths.astype(np.uint64) * weights[size])
    parts, counts = [], np.zeros(len(lengths) + 1, np.int64)
    for i, length in enumerate(lengths):
        if length >= size:
            own = np.sort(whole[firsts[i] : firsts[i + 1] - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        else:
            own = short[i : i + (length > 0)]
        parts.append(own)
        counts[i + 1] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(counts)
