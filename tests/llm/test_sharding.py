from __future__ import annotations

from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from botica.llm.sharding import byte_shards, differencing


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(2, 6))
def test_differencing_places_every_part_once(sizes, shards):
    sums = np.zeros((len(sizes), shards), dtype=np.int64)
    sums[:, 0] = sizes
    places = differencing(sums)
    assert all(sorted(p) == list(range(shards)) for p in places.tolist())
    totals = np.bincount(places[:, 0], sizes, shards)
    assert totals.max() - totals.min() <= max(sizes)


def test_classic_example():
    # 8 7 6 5 4: differencing leaves 2, greedy placing 4.
    sums = np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    totals = np.bincount(differencing(sums)[:, 0], sums[:, 0], 2)
    assert sorted(totals) == [14, 16]


@pytest.mark.parametrize("parts", [1, 1000])
def test_shards(messy, messy_rows, parts):
    rows = byte_shards(messy, 4, parts=parts).collect()
    want = sorted((len((r[1] or "").encode()) + 8, crc32((r[1] or "").encode())) for r in messy_rows)
    assert sorted((r.size, r.text_crc32) for r in rows) == want
    slots, shards = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        shards[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert set(slots) <= set(range(4))


def test_even_bytes_beside_a_hot_group(spark):
    rows = [(k, "copy " * 40) for k in range(200)] + [(1000 + k, f"{k} " * (k % 37 + 1)) for k in range(3000)]
    found = byte_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4, parts=50).collect()
    totals = defaultdict(int)
    for r in found:
        totals[r.shard] += r.size
    assert max(totals.values()) - min(totals.values()) < 0.01 * sum(totals.values()) / 4


def test_nothing(nothing):
    assert byte_shards(nothing).count() == 0
