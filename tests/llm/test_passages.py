from __future__ import annotations

from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from botica.llm import passages, suffixes
from tests.llm.conftest import story

WIDTH = 50


def brute(rows, width=WIDTH):
    """id, n_bytes, n_removed, n_spans, kept_sha256, by the words of the contract."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, x in data:
        for p in range(len(x) - width + 1):
            if i is not None:
                first[x[p : p + width]] = min(i, first.get(x[p : p + width], i))
    out = []
    for i, x in data:
        goes, end = bytearray(len(x)), 0
        for p in range(len(x) - width + 1):
            if i is not None and first[x[p : p + width]] < i:
                goes[max(p, end) : p + width] = b"\1" * (p + width - max(p, end))
                end = p + width
        spans = sum(1 for k, g in enumerate(goes) if g and (not k or not goes[k - 1]))
        kept = bytes(b for b, g in zip(x, goes) if not g)
        out.append((i, len(x), sum(goes), spans, sha256(kept).hexdigest()))
    return out


def check(found, rows):
    key = lambda r: tuple((v is None, v) for v in r)
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("block, bucket, hot", [(1 << 20, 1 << 24, 4096), (2000, 5000, 4096), (500, 3000, 1)])
def test_against_brute_force(messy, messy_rows, block, bucket, hot):
    found = passages.repeated_passages(messy, block_bytes=block, bucket_bytes=bucket, hot_blocks=hot).collect()
    check(found, [(r[0], r[1]) for r in messy_rows])


@pytest.mark.parametrize("hot", [4096, 1])
def test_passages_of_all_kinds(spark, hot):
    line = story(5, 12)
    rows = [(k, f"{story(100 + k, 20)} {line} {story(200 + k, 20)}") for k in range(40)]
    rows += [(50, "a" * 3000), (51, "b" + "a" * 200), (52, "ab" * 400), (53, "ab" * 30 + "c"), (54, "a" * 49)]
    rows += [(55, line[:50]), (56, line[:49]), (57, line + line), (58, "é" * 60), (59, "x" + "é" * 60)]
    # Two passages that touch, one id twice, no id, and rows out of order.
    rows += [(60, line[:60] + story(101, 20)[:60]), (61, line), (61, line), (None, line), (None, line), (-3, line[5:90])]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    check(passages.repeated_passages(docs, block_bytes=400, bucket_bytes=2000, hot_blocks=hot).collect(), rows)


def test_kept_bytes_and_spans(spark):
    line = story(6, 10)
    rows = [(1, line), (2, "head " + line + " tail"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r for r in passages.repeated_passages(docs, with_kept=True).collect()}
    assert found[2].kept == b"head  tail"
    assert [tuple(s) for s in found[2].spans] == [(5, 5 + len(line))]
    assert found[1].kept == line.encode() and found[1].spans == []
    assert found[3].kept == found[4].kept == b""


def test_long_text(spark):
    long = story(7, 200_000)
    rows = [(1, long), (2, long[1000:9000] + story(8, 30)), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: (r.n_bytes, r.n_removed, r.n_spans) for r in passages.repeated_passages(docs).collect()}
    assert found[1] == (len(long), 0, 0)
    assert found[3] == (len(long), len(long), 1)
    assert found[2][1] >= 8000 and found[2][2] == 1


def test_nothing(nothing):
    assert passages.repeated_passages(nothing).count() == 0


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 12))
def test_suffixes_in_order(letters, repeats):
    text = np.repeat(np.array(letters, dtype=np.uint8) * 60, repeats)
    word, depth = suffixes.words(text), len(text) + 8
    order = suffixes.suffix_array(text, word, depth)
    padded = [(text[k:].tobytes() + bytes(depth))[:depth] for k in order]
    assert sorted(order.tolist()) == list(range(len(text))) and padded == sorted(padded)
    common = [next((k for k in range(10) if a[k] != b[k]), 10) for a, b in zip(padded, padded[1:]) if depth >= 10]
    if depth >= 10:
        assert suffixes.shared(word, order, 10).tolist() == common


def test_keys_fill_buckets_evenly():
    raw = np.frombuffer(story(9, 20_000).encode(), dtype=np.uint8)
    key = passages.stretches(raw, np.array([len(raw)]), 50, 20)[3]
    counts = np.bincount((key >> np.uint64(61)).astype(int), minlength=8)
    assert counts.min() > 0.7 * counts.mean() and counts.max() < 1.3 * counts.mean()


def test_no_hot_pass_without_hot_keys(spark, monkeypatch):
    labels, keep = [], passages.written
    monkeypatch.setattr(passages, "written", lambda df, label: labels.append(label) or keep(df, label))
    rows = [(k, f"{story(300 + k, 20)} {story(5, 12)}") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, wanted in ((4096, False), (1, True)):
        labels.clear()
        check(passages.repeated_passages(docs, block_bytes=400, hot_blocks=hot).collect(), rows)
        assert ("passage-hot" in labels) == wanted


def test_strings_go_without_their_stretch(spark):
    """A hot stretch of n bytes has n strings: with its bytes each, they would be n * n bytes."""
    rows = spark.createDataFrame([(b"a" * 400, 1, 7, b"")], "stretch binary, block long, least long, spots binary")
    plan = passages._hot_spans(rows, WIDTH)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if " AS string#" in line]
    assert made and not any(" stretch#" in line.split("AS string#")[0].split("substring")[0] for line in made)


def test_hot_strings_are_not_sent_through_the_driver(spark):
    """A small file of stretches holds many strings: its size says nothing of theirs."""
    rows = spark.createDataFrame([(b"a" * 400, 1, 7, b"")], "stretch binary, block long, least long, spots binary")
    plan = passages._hot_spans(rows, WIDTH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "BroadcastExchange" not in plan
