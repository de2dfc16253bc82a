import numpy as np
import pyarrow as pa
import pytest

from rivalry.operators import boosting as B


@pytest.mark.parametrize("depth", [1, 4, 8])
def test_leaves_of_columns_are_those_of_a_walk(depth):
    rng = np.random.default_rng(depth)
    bins, t = rng.integers(0, 32, (500, 6)).astype(np.uint8), B.Tree(depth)
    inner = 2**depth - 1
    t.feature[:inner], t.bin[:inner] = rng.integers(0, 6, inner), rng.integers(0, 31, inner)
    for i in range(1, inner):
        if rng.random() < 0.2 or t.feature[(i - 1) // 2] < 0:
            t.feature[i] = -1
    want = []
    for row in bins:
        at = 0
        while t.feature[at] >= 0:
            at = 2 * at + 1 + int(row[t.feature[at]] > t.bin[at])
        want.append(at)
    assert t.leaf(np.ascontiguousarray(bins.T)).tolist() == want


def test_bytes_of_a_sliced_column():
    column = pa.array([bytes([i] * 3) for i in range(9)], pa.binary())
    assert B._bytes(column.slice(4, 2)).tolist() == [4, 4, 4, 5, 5, 5]
    assert not len(B._bytes(column.slice(4, 0)))
