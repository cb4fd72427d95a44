from __future__ import annotations

import numpy as np
import pytest

from botica.llm.embeddings import compare, near_vectors, steps
from tests.llm.test_ngrams import check, expected

SCHEMA = "vec_id long, embedding array<double>, label int, unit string, cell string"


def alike(a, b):
    x, y = a[1], b[1]
    if a[2] is None or a[2] != b[2] or not x or not y or len(x) != len(y) or None in x or None in y:
        return False
    x, y = np.array(x), np.array(y)
    if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
        return False
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return bool(x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98)


def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(240):
        x = centres[k % 6] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.6])
        rows.append((k, (x * rng.choice([1, 1e-200, 1e200])).tolist(), int(k % 6 > 3), "u", "c"))
    same = rows[0][1]
    rows += [(1000 + k, same, 0, None, None) for k in range(40)]
    odd = [None, [], [0.0] * 8, [None] * 8, [float("nan"), *same[1:]], [float("inf"), *same[1:]], same[:4]]
    rows += [(2000 + k, v, 0, "u", "c") for k, v in enumerate(odd)]
    rows += [(2100, same, None, "u", "c"), (None, same, 0, "u", "c"), (3000, same, 0, "u", "c"), (3000, same, 0, "u", "c")]
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_against_brute_force(spark, block):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    check(near_vectors(frame, block=block).collect(), expected(rows, alike))


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 12)) * np.linspace(3, 0.1, 12)
    x /= np.linalg.norm(x, axis=1)[:, None]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    a, b = compare(x, axes, lambda a, b: np.ones(len(a), dtype=bool), 0.9, rows=37)
    want = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(map(tuple, want.tolist()))


def test_steps_cover_all_axes():
    for dims in (1, 2, 3, 5, 64, 100):
        assert [k for s in steps(dims) for k in range(dims)[s]] == list(range(dims))


def test_nothing(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
