"""Numpy helpers for the work inside tasks: flat byte buffers, spans, hashes and ragged gathers.

Texts of an Arrow batch are handled in chunks of bounded size, so memory does not depend on the number of rows in a
batch; one very long text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 2_000_000
_U = np.uint64
#: Constants of the splitmix64 finaliser.
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=_U)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about `size` characters together, one text at least."""
    lo = total = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > lo and total + n > size:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def flatten(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one buffer, each followed by a line feed, and the start of each part (one more at the end)."""
    buf = np.frombuffer(b"\n".join(parts) + b"\n" + bytes(8), dtype=np.uint8)
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return buf, starts


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    gap = SPACE[buf[:-8]]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if gap.size and not gap[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes a step."""
    eight = np.ndarray(len(buf) - 7, dtype="<u8", buffer=buf, strides=(1,))
    n = end - start
    h = mix(mix(n.astype(_U)) ^ (eight[start] & _MASK[np.minimum(n, 8)]))
    rest, at = np.flatnonzero(n > 8), 8
    while rest.size:
        left = n[rest] - at
        h[rest] = mix(h[rest] ^ (eight[start[rest] + at] & _MASK[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    return h


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i]+1, ... of all slices, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def first_of(values: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array begins a new value."""
    if not values.size:
        return np.zeros(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
