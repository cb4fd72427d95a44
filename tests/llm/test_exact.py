from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pytest
from hypothesis import given
from hypothesis import strategies as st

from botica.llm import exact


def plain(text):
    return (text or "").encode().lower()


@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunks_make_the_whole(text, chunk):
    for which in (0, 1):
        parts = [text[k : k + chunk] for k in range(0, len(text), chunk)]
        after = [len(text) - k - len(p) for k, p in zip(range(0, len(text), chunk), parts)]
        joined = sum(exact.shifted(exact.chunk_hash(p, which), n, which) for p, n in zip(parts, after))
        prime, radix = exact.PRIMES[which], exact.RADIXES[which]
        value = 0
        for b in text:
            value = (value * radix + b + 1) % prime
        assert joined % prime == value


def brute(rows):
    groups = defaultdict(list)
    for k, row in enumerate(rows):
        groups[plain(row[1])].append(row[0])
    return groups


@pytest.mark.parametrize("chunk", [7, exact.CHUNK])
def test_against_brute_force(messy, messy_rows, chunk):
    groups = brute(messy_rows)
    found = exact.exact_copies(messy, chunk_bytes=chunk).collect()
    want = []
    for row in messy_rows:
        ids = groups[plain(row[1])]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((row[0], keep, len(ids), sha256(plain(row[1])).hexdigest()))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.id, r.keep_id, r.group_size, r.sha256) for r in found), key=key) == sorted(want, key=key)
    kept = [r for r in found if r.kept]
    assert sorted(r.sha256 for r in kept) == sorted(sha256(t).hexdigest() for t in groups)
    assert all(r.id == r.keep_id for r in kept)


def test_unequal_texts_of_one_fingerprint_stay_apart(spark, monkeypatch):
    # All remainders are 0 then: only lengths tell fingerprints apart.
    monkeypatch.setattr(exact, "PRIMES", (1, 1))
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "ABC"), (4, "x"), (5, "y")], "doc_id long, text string")
    found = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_copies(docs, chunk_bytes=2).collect()}
    assert found == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 1, True)}


def test_dropping_keeps_all_columns(messy, messy_rows):
    left = exact.drop_exact_copies(messy)
    assert left.columns == messy.columns
    rows = left.collect()
    assert sorted(plain(r.text) for r in rows) == sorted(brute(messy_rows))
    assert {r.size for r in rows} <= {"c", None}


def test_nothing(nothing):
    assert exact.exact_copies(nothing).count() == 0
    assert exact.drop_exact_copies(nothing).count() == 0
