import random

import numpy as np
import pytest

from codeloom.operators import nearmiss as N


@pytest.mark.parametrize("bound", [N.MAX_BROADCAST_VALUES, 0])
def test_equals_brute_force(spark, bound):
    rng = random.Random(2)
    data = [(i, i % 5 if i % 5 else i % 2, [rng.gauss(i % 3, 1.0) for _ in range(4)]) for i in range(300)]
    data += [(1000 + i, 9, [rng.gauss(i % 4, 2.0) for _ in range(4)]) for i in range(25)]
    df = spark.createDataFrame(data, "id int, y int, v array<double>")
    out = N.nearmiss_undersample(df, "y", "id", "v", max_values=bound, pivots=5, block_rows=4)
    near = np.array([v for _, y, v in data if y == 9])
    want = {i for i, y, _ in data if y == 9}
    for label in sorted({y for _, y, _ in data} - {9}):
        dist = sorted((round(float(np.sort(np.sqrt(((near - np.array(v)) ** 2).sum(1)))[:3].mean()), 6), i)
                      for i, y, v in data if y == label)
        want |= {i for _, i in dist[:25]}
    assert {r.id for r in out.collect()} == want


def test_whole_numbers_need_no_differences(monkeypatch):
    """Distances of id arrays come from one product for each block, with the same values to the last bit."""
    import numpy as np

    from codeloom.operators import nearmiss as N

    random = np.random.default_rng(4)
    rows, others = random.integers(0, 60000, (70, 9)).astype(float), random.integers(0, 60000, (50, 9)).astype(float)
    others[7] = rows[3]
    monkeypatch.setattr(N, "_STEP", 16)
    want = np.sort(np.sqrt(((rows[:, None] - others[None]) ** 2).sum(axis=2)), axis=1)
    assert N._exact_squares(rows, others) and not N._exact_squares(rows + 0.5, others) and not N._exact_squares(rows * 1e5, others)
    assert (N._k_smallest(rows, others, 3) == want[:, :3]).all()
    assert (N._k_smallest(rows, others[:2], 3)[:, :2] == np.sort(np.sqrt(((rows[:, None] - others[None, :2]) ** 2).sum(axis=2)), axis=1)).all()
    assert np.abs(N._k_smallest(rows + 0.5, others, 3) - np.sort(np.sqrt(((rows[:, None] + 0.5 - others[None]) ** 2).sum(axis=2)), axis=1)[:, :3]).max() < 1e-9


@pytest.mark.parametrize("high, shift", [(90, 0.0), (60000, 0.0), (90, 0.25)])
def test_packed_minority_has_the_same_distances(spark, monkeypatch, high, shift):
    """Small whole numbers are broadcast at a byte each, where eight bytes a value would take the join by cells; the
    distances are those of all pairs, to the last bit where numbers are whole."""
    def cells(*_):
        raise AssertionError("cells were cut")

    monkeypatch.setattr(N, "_cell_distances", cells)
    random_ = np.random.default_rng(8)
    x = random_.integers(0, high, (400, 12)).astype(float) + shift
    df = spark.createDataFrame([(i, "few" if i < 150 else "many", x[i].tolist()) for i in range(400)], "id long, y string, v array<double>")
    bound = 150 * 12 // 8 if high == 90 and not shift else N.MAX_BROADCAST_VALUES
    found, label, n = N.minority_distances(df, "y", "id", "v", max_values=bound)
    want = np.sort(np.sqrt(((x[150:, None] - x[None, :150]) ** 2).sum(axis=2)), axis=1)[:, :3]
    got = {r.id: r.distance for r in found.collect()}
    assert n == 150 and sorted(got) == list(range(150, 400))
    for i, d in got.items():
        mean = (want[i - 150][0] + want[i - 150][1] + want[i - 150][2]) / 3
        assert d == mean if not shift else abs(d - mean) < 1e-9


def test_vectors_of_different_lengths_are_refused():
    import pyarrow as pa

    assert N._matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        N._matrix(pa.array([[1.0], [2.0, 3.0, 4.0]]))
