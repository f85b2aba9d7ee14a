"""Word shingles and MinHash signatures of many texts at once.

A-Z are lower-cased and words are runs without ASCII white space. The shingles of a text are its distinct runs of
`words` words, as 64-bit hashes; a text with fewer words is one shingle as a whole, one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tabloom.llm.arrays import chunks, flatten, mix, span_hashes
from tabloom.llm.arrays import words as word_spans

_U = np.uint64


def shingle_sets(texts: list[str | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each chunk of texts the sorted distinct shingle hashes of all, and how many each text has."""
    for lo, hi in chunks(texts):
        raw = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts[lo:hi]]
        buf, starts = flatten(raw)
        s, e = word_spans(buf)
        hashes = span_hashes(buf, s, e)
        owner = np.searchsorted(starts, s, "right") - 1
        count = np.bincount(owner, minlength=len(raw)).astype(np.int64)
        made = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
        of_text = np.repeat(np.arange(len(raw)), made)
        first = np.cumsum(count) - count
        at = first[of_text] + np.arange(len(of_text)) - (np.cumsum(made) - made)[of_text]
        length = np.minimum(count[of_text], size)
        value = mix(length.astype(_U))
        for k in range(size):
            word = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else value
            value = np.where(k < length, mix(value ^ word), value)
        order = np.lexsort((value, of_text))
        of_text, value = of_text[order], value[order]
        keep = np.ones(len(value), dtype=bool)
        keep[1:] = (value[1:] != value[:-1]) | (of_text[1:] != of_text[:-1])
        yield value[keep], np.bincount(of_text[keep], minlength=len(raw)).astype(np.int64)


def signatures(values: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A row of minima for each text with shingles, one column a seed, as 32-bit numbers."""
    some = counts[counts > 0]
    starts = np.cumsum(some) - some
    out = np.zeros((len(some), len(seeds)), dtype=np.int32)
    for k, (factor, shift) in enumerate(seeds if len(some) else ()):
        low = np.minimum.reduceat(values * factor + shift, starts)
        out[:, k] = (low >> _U(32)).astype(np.uint32).view(np.int32)
    return out


def seeds(number: int) -> np.ndarray:
    """Pairs of an odd factor and a shift, always the same."""
    base = mix(np.arange(2 * number, dtype=_U) + _U(7)).reshape(number, 2)
    base[:, 0] |= _U(1)
    return base


def set_prints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart, 0 for empty sets."""
    some = counts > 0
    begin = (np.cumsum(counts) - counts)[some]
    out = []
    for salt in (_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)):
        total = np.zeros(len(counts), dtype=_U)
        if some.any():
            total[some] = np.add.reduceat(mix(values ^ salt), begin)
        out.append(total.view(np.int64))
    return out[0], out[1]


def parity_sketches(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """`size` 64-bit numbers for each text: one bit a bucket, set if an odd number of its shingles fall there.

    Two sets differ in at least as many shingles as their sketches do in bits.
    """
    out = np.zeros((len(counts), size), dtype=_U)
    owner = np.repeat(np.arange(len(counts)), counts)
    bucket = mix(values ^ _U(0x2545F4914F6CDD1D)) % _U(64 * size)
    np.bitwise_xor.at(out, (owner, (bucket >> _U(6)).astype(np.int64)), _U(1) << (bucket & _U(63)))
    return out.view(np.int64)
