from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from botica.llm.packing import WordTokenizer, cuts, pack
from botica.llm.queries import word_bpe


@given(st.integers(1, 50_000), st.sampled_from([1, 8, 2048]))
def test_cuts_are_the_binary_digits(length, longest):
    ends = cuts(length, longest)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == length
    assert all(s & (s - 1) == 0 and s <= longest for s in sizes)
    assert sizes == sorted(sizes, reverse=True)
    assert all(n == 1 for s, n in Counter(sizes).items() if s < longest)


@pytest.fixture(scope="module")
def both():
    return WordTokenizer(word_bpe()), Tokenizer.from_str(word_bpe())


@given(st.text(max_size=80))
def test_remembered_words_are_the_tokenizers(both, text):
    ours, whole = both
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(ours.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["a<|endoftext|>b <|ENDOFTEXT|>", "İstanbul ẞ ﬁ x́ 'S can't CAN'T, it's. 'll", "ª. É, ΑΣ ς\x1c,", "a.b ...!? \"q\" x5%."],
)
def test_odd_words(both, text):
    assert np.frombuffer(both[0].encode(text.encode()), "<u4").tolist() == both[1].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("longest", [64, 2048])
def test_round_trip(messy, messy_rows, both, longest):
    pieces = pack(messy, word_bpe(), end_id=1, sequence_length=longest).collect()
    assert sorted(p.sequence_id for p in pieces) == list(range(len(pieces)))
    assert all(p.offset == 0 and p.length & (p.length - 1) == 0 and p.length <= longest for p in pieces)
    want = Counter((r[0], tuple(both[1].encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in messy_rows)
    for key in {k for k in want if want[k] == 1 and sum(n for (i, _), n in want.items() if i == k[0]) == 1}:
        own = sorted((p for p in pieces if p.id == key[0]), key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0, *(p.length for p in own)])[:-1])
        assert tuple(np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist()) == key[1]
        assert {p.doc_tokens for p in own} == {len(key[1])}
    sizes = defaultdict(int)
    for p in pieces:
        sizes[p.id] += p.length
    total = defaultdict(int)
    for (doc, ids), n in want.items():
        total[doc] += n * len(ids)
    assert sizes == total


def test_nothing(nothing):
    assert pack(nothing, word_bpe(), end_id=1).count() == 0


def test_lengths_are_powers_of_two(messy):
    with pytest.raises(ValueError):
        pack(messy, word_bpe(), end_id=1, sequence_length=100)
