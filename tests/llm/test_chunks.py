"""Packed numbers and word lists."""

import numpy as np

from imunis.llm.chunks import pack, unpack


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    rows = [np.zeros(0, np.uint32), np.array([0, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**32 - 1], np.uint32), np.zeros(0, np.uint32),
            *[(2 ** rng.uniform(0, 32, n)).astype(np.uint32) for n in (1, 1000, 0, 3)]]
    values, at = unpack(pack(np.concatenate(rows), np.array([len(r) for r in rows])))
    assert len(at) == len(rows) + 1
    for r, s, e in zip(rows, at, at[1:]):
        assert (values[s:e] == r).all() and e - s == len(r)
    assert [len(x) for x in unpack(pack(np.zeros(0, np.uint32), np.array([0, 0])))] == [0, 3]
    assert [len(x) for x in unpack(pack(np.zeros(0, np.uint32), np.zeros(0, np.int64)))] == [0, 1]
