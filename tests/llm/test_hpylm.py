from __future__ import annotations

import pickle
import re
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest
from pyspark import RDD

from botica.llm import hpylm
from botica.llm.hpylm import END, ORDER, Subtrees, _packed, _unpacked, grams, score_texts, seat, seat_upper, symbols

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def check(rows, found):
    """All but the model's score against plain counting."""
    learned = [r for r in rows if crc32(("" if r[0] is None else str(r[0])).encode()) % 10]
    counts = Counter(w for r in learned for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        t = tokens(r[1])
        base = sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[(r[0], r not in learned, len(t), sum(counts[w] > 0 for w in t), n, round(base, 5))] += 1
    got = Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)
    assert got == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in found)


def test_messy(messy, messy_rows):
    check(messy_rows, score_texts(messy).collect())


def test_held_out_texts_are_likelier_than_under_unigrams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = score_texts(docs).collect()
    check([tuple(r) for r in docs.collect()], found)
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_predictions_add_up_to_one():
    texts = [symbols(t) for t in (b"the cat sat", b"The cat ran", b"a dog", b"")]
    assert texts[1] == b"the cat ran \n" and texts[3] == b"\n"
    keys, counts = np.unique(grams(texts)[0], return_counts=True)
    # All symbols after one context that was seen, and after one that was not.
    seen = int(grams([symbols(b"the cat sat")])[0][8]) >> 8
    for context in (seen, int.from_bytes(b"qzqat"[:ORDER], "big")):
        every = np.unique(np.concatenate([keys, (context << 8) + np.arange(256)]))
        n = np.zeros(len(every), dtype=np.int64)
        n[np.searchsorted(every, keys)] = counts
        tree = Subtrees(every, n)
        customers = np.zeros(1 << 16, dtype=np.int64)
        customers[tree.keys[1]] = tree.customers[1]
        upper = seat_upper(customers.reshape(256, 256), 3, 1)
        assert np.allclose(upper.sum(axis=1), 1)
        for _ in range(3):
            tree.sweep(upper, np.random.default_rng(5))
            total = tree.predictive(upper)[ORDER][every >> 8 == context].sum()
            assert total == pytest.approx(1)
        assert all((t <= c).all() and ((t > 0) == (c > 0)).all() for t, c in ((tree.tables[k], tree.customers[k]) for k in tree.tables))


def test_seating_opens_as_many_tables_as_expected():
    rng = np.random.default_rng(3)
    d, strength, p, c, n = 0.7, 1.0, 0.4, 300, 4000
    tables = seat(np.full(n, c), lambda k, t: (strength + d * t) * p, d, rng)
    one = []
    for _ in range(1500):
        t = 1
        for at in range(1, c):
            new = (strength + d * t) * p
            t += rng.random() < new / (new + at - d * t)
        one.append(t)
    assert tables.mean() == pytest.approx(np.mean(one), rel=0.04)


def test_grams():
    keys, sizes = grams([b"ab\n", b"\n"])
    fill = bytes([END]) * ORDER
    want = [(fill + b"ab\n")[k : k + ORDER + 1] for k in range(3)] + [fill + b"\n"]
    assert [int(k).to_bytes(ORDER + 1, "big") for k in keys] == want and sizes.tolist() == [3, 1]


def test_nothing(spark, nothing):
    assert score_texts(nothing).count() == 0
    # Only held-out texts: nothing to learn from.
    held = next(k for k in range(100) if crc32(str(k).encode()) % 10 == 0)
    docs = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    row = score_texts(docs).collect()[0]
    assert (row.n_known, row.train_tokens) == (0, 0) and row.score == pytest.approx(3 * log10(0.5))


def numbers(held):
    """Ids of texts that are held out, or that are not."""
    return (k for k in range(10**6) if (crc32(str(k).encode()) % 10 == 0) == held)


def scored(spark, learned, *held):
    """The scores of held-out texts, given texts to learn from."""
    rows = [(k, t) for texts, ids in ((learned, numbers(False)), (held, numbers(True))) for t, k in zip(texts, ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.id: r.score for r in score_texts(docs).collect()}
    return [found[k] for _, k in zip(held, numbers(True))]


def test_order_of_words_counts(spark):
    rng = np.random.default_rng(11)
    follow = rng.integers(0, 150, (150, 3))

    def text(n):
        at, out = 0, []
        for _ in range(n):
            at = follow[at][rng.integers(3)]
            out.append(f"w{at * 7919 % 1009}")
        return out

    held = [text(60) for _ in range(20)]
    mixed = [list(rng.permutation(t)) for t in held]
    found = scored(spark, [" ".join(text(100)) for _ in range(200)], *(" ".join(t) for t in held + mixed))
    assert all(a > b + 20 for a, b in zip(found[:20], found[20:]))


def test_unknown_words_are_spelt(spark):
    learned = ["walk walks walked walking talk talks talked talking stalk stalks balk balked " * 3] * 5
    like, unlike, long = scored(spark, learned, "walk balking", "walk xqzjvkw", "walk " + "xq" * 2000)
    assert like > unlike + 3 and np.isfinite(long) and long < 100 * unlike


def test_parts_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    once = {r.id: r.score for r in score_texts(docs).collect()}
    monkeypatch.setattr("botica.llm.hpylm.PART_BYTES", 1 << 17)
    again = {r.id: r.score for r in score_texts(docs).collect()}
    assert all(abs(s - again[k]) < 0.01 * abs(s) + 0.5 for k, s in once.items())


def test_spelling_looks_five_bytes_back(spark):
    assert ORDER == 5
    rng = np.random.default_rng(5)
    letters = "abcdefghijkl"

    def word(shift):
        k = int(rng.integers(12))
        return "".join(rng.choice(list("pqrst"), 6)) + letters[k] + "mmmm" + letters[(k + shift) % 12]

    learned = [" ".join(word(1) for _ in range(40)) for _ in range(60)]
    right, wrong = scored(spark, learned, " ".join(word(1) for _ in range(30)), " ".join(word(5) for _ in range(30)))
    assert right > wrong + 20


def test_little_is_exchanged(spark, monkeypatch):
    """Pairs of words are told as numbers, and texts stay where they are stored."""
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(4000)]
    texts = [" ".join(names[k] for k in rng.integers(0, 4000, 200)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    sizes, deal = [], RDD.partitionBy

    def dealt(pieces, *rest):
        sizes.append(pieces.map(lambda piece: len(pickle.dumps(piece))).sum())
        return deal(pieces, *rest)

    monkeypatch.setattr(RDD, "partitionBy", dealt)
    assert score_texts(docs).count() == len(texts)
    assert sum(sizes) < 1.6 * sum(map(len, texts))


def test_packed_numbers_come_back():
    columns = [np.array(c) for c in ([0, 1, 255], [], [256, 70_000], [2**40, 5])] + [np.array([2**64 - 1], np.uint64)]
    assert [c.tolist() for c in _unpacked(_packed(*columns))] == [c.tolist() for c in columns]


def test_one_worker_a_task_reads_texts(spark, monkeypatch):
    """Executors hold one Python worker for each task, and in it one block after another."""
    seen, tell = [], hpylm._told

    def told(*given):
        seen.append(tell(*given))
        return seen[-1]

    monkeypatch.setattr(hpylm, "_told", told)
    monkeypatch.setattr(hpylm, "BLOCK_BYTES", 1 << 14)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = score_texts(docs).collect()
    check([tuple(r) for r in docs.collect()], rows)
    assert len(seen) == 2
    for rdd in seen:
        # The last stage: what stands above the first exchange.
        stage = rdd.toDebugString().decode().split("+-(")[0]
        assert len(re.findall(r"\bPythonRDD\[", stage)) == 1
        assert rdd.count() > rdd.getNumPartitions()
