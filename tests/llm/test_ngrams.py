from __future__ import annotations

import numpy as np
import pytest

from botica.llm.links import components, forest
from botica.llm.ngrams import BANDS, drop_near_copies, fewest_matches, near_copies, signature
from botica.llm.words import many_word_hashes, shingles, word_hashes
from tests.llm.conftest import story


def runs(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, alike):
    """By place of a row: its number of links and the places that links reach."""
    links = [{j for j in range(len(rows)) if j != i and alike(rows[i], rows[j])} for i in range(len(rows))]
    reach = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        reach.append(seen)
    return [len(x) for x in links], reach


def expected(rows, alike):
    counts, reach = brute(rows, alike)
    name = lambda ids: min((i for i in ids if i is not None), default=None)
    return [(r[0], n, name(rows[k][0] for k in seen)) for r, n, seen in zip(rows, counts, reach)]


def alike(a, b):
    one, two = runs(a[1]), runs(b[1])
    return bool(one) and bool(two) and len(one & two) / len(one | two) >= 0.8


def check(found, want):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.id, r.n_links, r.component_id) for r in found), key=key) == sorted(want, key=key)
    kept = [r for r in found if r.kept]
    assert all(r.id == r.component_id for r in kept)


@pytest.mark.parametrize("block", [2, 512])
def test_against_brute_force(messy, messy_rows, block):
    found = near_copies(messy, block=block).collect()
    check(found, expected(messy_rows, alike))
    groups = {frozenset(x) for x in brute(messy_rows, alike)[1]}
    assert sum(r.kept for r in found) == len(groups)


def test_a_large_group_of_near_copies(spark):
    words = story(5, 120).split()
    rows = [(k, " ".join([*words[: k % 100], f"own{k}", *words[k % 100 + 1 :]])) for k in range(150)]
    rows += [(1000 + k, story(k + 200, 80)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_copies(docs, block=16).collect(), expected(rows, alike))


def test_dropping_keeps_all_columns(messy, messy_rows):
    left = drop_near_copies(messy)
    assert left.columns == messy.columns
    groups = {frozenset(x) for x in brute(messy_rows, alike)[1]}
    rows = left.collect()
    assert len(rows) == len(groups)
    assert {r.doc_id for r in rows} >= {0, 1, 2, 24, 25, 26, 27, 29, 31}


def test_posterior_bound():
    for n in (32, 64, 128):
        least = fewest_matches(n, 0.8, 1e-9)
        # Chances that the similarity is 0.8 or more, by summing the beta density.
        s = np.linspace(0, 1, 200_001)
        for m, above in ((least, True), (least - 1, False)):
            density = s**m * (1 - s) ** (n - m)
            assert (density[s >= 0.8].sum() / density.sum() >= 1e-9) == above


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = signature(common[:3600]), signature(common[400:])
    same = (a.view("<u2") == b.view("<u2")).mean()
    assert len(a) == BANDS and abs(same - 0.8) < 0.12


def test_words_do_not_depend_on_spans(monkeypatch):
    from botica.llm import words

    texts = [story(k, 40 * k).encode() for k in range(6)] + [b"", b" \t", b"x" * 500 + b" y"]
    whole = [word_hashes(t).tolist() for t in texts]
    monkeypatch.setattr(words, "SPAN", 64)
    assert [word_hashes(t).tolist() for t in texts] == whole
    hashes, counts = many_word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert hashes.tolist() == sum(whole, [])
    assert len(shingles(hashes[:3], 5)) == 1 and not len(shingles(hashes[:0], 5))


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 4), (9, 4), (7, 7)] + [(500, 500 + k) for k in range(1, 40)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == (
        {k: 100 for k in range(100, 161)} | {k: 3 for k in (3, 4, 5, 9)} | {500 + k: 500 for k in range(40)}
    )


def test_forest():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, 120), rng.integers(0, 200, 120)
    root = list(range(200))
    for _ in range(200):
        for x, y in zip(a, b):
            root[x] = root[y] = min(root[x], root[y])
    assert forest(200, a, b).tolist() == root


def test_nothing(nothing):
    assert near_copies(nothing).count() == 0
    assert drop_near_copies(nothing).count() == 0
