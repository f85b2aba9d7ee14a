import numpy as np

from tabloom.llm.near import SKETCH
from tabloom.llm.shingles import parity_sketches


def test_sketches_never_differ_in_more_bits_than_sets_in_elements():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: 300 - k], draw.integers(0, 1 << 63, k, dtype=np.uint64)))) for k in (0, 1, 9, 80, 300)]
    sets.append(np.zeros(0, dtype=np.uint64))
    sketches = parity_sketches(np.concatenate(sets), np.array([len(s) for s in sets]), SKETCH).view(np.uint64)
    assert not sketches[-1].any()
    for a, x in zip(sets, sketches):
        for b, y in zip(sets, sketches):
            bits = sum(int(v).bit_count() for v in x ^ y)
            assert bits <= len(np.setxor1d(a, b))
