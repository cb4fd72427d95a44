from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from botica.llm.negatives import Lists, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, dims string, score string"


def ints(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(256 * x) for x in vector]


def brute(rows, anchors):
    """By the words of the contract; rows are told apart by their place."""
    valid = []
    for place, (id_, vector, label, *_) in enumerate(rows):
        whole = ints(vector)
        if label is None or whole is None or any(x * x * max(1, len(whole)) >= 2**63 for x in whole):
            continue
        valid.append((place, id_, (label + 1) % 10 if id_ is not None and id_ % 7 == 0 else label, whole))
    out = []
    for place, id_, label, vector in valid:
        if id_ is None or id_ % anchors:
            continue
        scored = [
            (-sum(a * b for a, b in zip(vector, w)), i is None, i or 0, p, i, own)
            for p, i, own, w in valid
            if p != place and len(w) == len(vector)
        ]
        scored.sort(key=lambda s: s[:4])
        for minus, *_, positive, _own in [s for s in scored if s[5] == label][:5]:
            score = -minus
            fits = [s for s in scored if s[5] != label and 80 * score <= -100 * s[0] <= 100 * score][:5]
            out += [(id_, positive, k + 1, s[4], score, -s[0]) for k, s in enumerate(fits)]
    return out


def run(spark, rows, anchors, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives(frame, F.col("id") % anchors == 0, label=label, **more).collect()
    assert all(r["rank"] >= 1 for r in found)
    return [tuple(r) for r in found]


def same(found, want):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(found, key=key) == sorted(want, key=key)


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    rows = [(k, (centres[k % 5] + rng.normal(size=6) * 0.2).tolist(), k % 4, "r", "d", "s") for k in range(200)]
    # Ties, copies with one id, and rows that take no part.
    rows += [(200 + k, rows[k % 3][1], k % 2, None, None, None) for k in range(30)]
    rows += [(20, rows[20][1], 0, "r", "d", "s"), (20, rows[20][1], 1, "r", "d", "s"), (None, rows[5][1], 1, "r", "d", "s")]
    odd = [None, [], [None] * 6, [float("nan")] * 6, [float("inf")] * 6, [1e30] * 6, [0.0] * 6, rows[0][1][:4]]
    rows += [(400 + 10 * k, v, 1, "r", "d", "s") for k, v in enumerate(odd)]
    rows += [(500, rows[0][1][:4], 0, "r", "d", "s"), (510, rows[3][1], None, "r", "d", "s"), (520, [], 0, "r", "d", "s")]
    return rows


@pytest.mark.parametrize("block", [7, 4096])
def test_against_brute_force(spark, block):
    same(run(spark, vectors(), 10, block=block), brute(vectors(), 10))


def test_the_threshold_stops_early_and_loses_nothing():
    rng = np.random.default_rng(5)
    rows = rng.integers(-300, 300, size=(3000, 6))
    rows[:40] += 800
    anchor = rng.integers(100, 300, size=6)
    lists = Lists(rows)
    every = rows @ anchor
    asked = []

    def enough(places, scores, threshold):
        asked.append(threshold)
        met = np.zeros(len(rows), dtype=bool)
        met[places] = True
        assert met.all() or every[~met].max() <= threshold
        return len(scores) >= 5 and threshold < np.sort(scores)[-5]

    places, scores = lists.best(anchor, enough)
    assert len(places) < 1500
    assert np.sort(scores)[-5:].tolist() == np.sort(every)[-5:].tolist()
    assert asked == sorted(asked, reverse=True)


def test_one_label_or_no_anchors_or_nothing(spark):
    rows = [(k, [1.0, float(k)], 3, "r", "d", "s") for k in range(1, 6)]
    assert run(spark, rows, 5) == run(spark, rows, 1000) == []
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
