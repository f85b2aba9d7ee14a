"""Cutting texts into the pieces that byte-pair encoders work on, for whole buffers of bytes at once.

Two pattern families are covered, for texts of characters below U+0140; others go through the tokenizer library:
`spaced` keeps white space and joins one blank to the piece behind it; `bare` drops white space and takes each digit
alone. Both split off the English endings after an apostrophe.
"""

from __future__ import annotations

import unicodedata

import numpy as np

GAP, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: First lead byte of UTF-8 that is too large for the tables below.
LARGE = 0xC5


def _kind(c: int) -> int:
    if 9 <= c <= 13 or c in (0x20, 0x85, 0xA0):
        return GAP
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)


_KIND = np.array([_kind(c) for c in range(0x140)], dtype=np.int8)
_BYTE = np.concatenate((_KIND[:128], np.full(128, OTHER, dtype=np.int8)))


def simple(part: bytes) -> bool:
    """Whether all characters lie below U+0140."""
    return part.isascii() or int(np.frombuffer(part, dtype=np.uint8).max()) < LARGE


def kinds(buf: np.ndarray) -> np.ndarray:
    """Kind of the character that each byte belongs to."""
    out = _BYTE[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    if lead.size:
        code = ((buf[lead] & 0x1F).astype(np.int32) << 6) | (buf[lead + 1] & 0x3F)
        out[lead] = out[lead + 1] = _KIND[code]
    return out


def _endings(buf: np.ndarray, kind: np.ndarray, fresh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of apostrophes that begin an ending, and its length in letters."""
    at = at[(buf[at] == 39) & (kind[at + 1] == LETTER) & fresh[at]]
    a, b = buf[at + 1], buf[at + 2]
    one = np.isin(a, np.frombuffer(b"stmd", dtype=np.uint8))
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    size = np.where(one, 1, np.where(two, 2, 0))
    return at[size > 0], size[size > 0]


def pieces(buf: np.ndarray, starts: np.ndarray, bare: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces. `buf` has a line feed after each text (never part of a piece) and padding."""
    n = int(starts[-1])
    kind = kinds(buf[: n + 8])
    begin = np.zeros(n + 1, dtype=bool)
    begin[starts] = True
    stop = np.zeros(n + 8, dtype=bool)
    stop[starts[1:] - 1] = True  # the line feeds between texts
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(kind[1:n], kind[: n - 1], out=change[1:])
    change |= begin[:n]
    change[stop[:n]] = True
    solid = kind[:n] != GAP
    if bare:
        tail = (buf[:n] & 0xC0) == 0x80
        change |= (kind[:n] == NUMBER) & ~tail
        flags = change
    else:
        blank = np.zeros(n, dtype=bool)
        blank[1:] = (buf[: n - 1] == 32) & ~begin[1:n]
        flags = change & ~(solid & blank)
        # The last white space before something solid begins a piece; U+0085 and U+00A0 take two bytes.
        first = np.flatnonzero(change & solid & ~begin[:n])
        first = first[(kind[first - 1] == GAP) & ~stop[first - 1]]
        flags[np.where(buf[first - 1] >= 0x80, first - 2, first - 1)] = True
    lone = np.flatnonzero((buf[:n] == 39) & change)
    if lone.size:
        at, size = _endings(buf, kind, change if bare else flags, lone)
        flags[at + 1] = False
        after = at + 1 + size
        flags[after] |= kind[after] == LETTER
    s = np.flatnonzero(flags)
    e = np.append(s[1:], n)
    keep = ~stop[s]
    if bare:
        keep &= solid[s]
    return s[keep], e[keep]


class Known:
    """Values of pieces by their hash, kept between the batches of a worker up to `limit` entries."""

    def __init__(self, limit: int = 400_000, dtype: type = np.int32):
        self.limit, self.dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.offset = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=self.dtype)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is not known."""
        if not self.hashes.size:
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.place[at], -1)

    def add(self, hashes: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        row = np.arange(len(hashes)) + len(self.offset)
        self.offset = np.concatenate((self.offset, len(self.pool) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.pool = np.concatenate((self.pool, flat.astype(self.dtype)))
        both, place = np.concatenate((self.hashes, hashes)), np.concatenate((self.place, row))
        order = np.argsort(both, kind="stable")
        self.hashes, self.place = both[order], place[order]

    @property
    def full(self) -> bool:
        return len(self.hashes) > self.limit
