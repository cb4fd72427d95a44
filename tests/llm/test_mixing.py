from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from botica.llm.mixing import WORD, mix_documents, mixed_sources, schedule, source_targets
from botica.llm.staging import as_read


def words(text):
    return re.findall(WORD, text or "")


def targets(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, found = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > 2 * sizes[s] * total}
        if not over:
            return sizes, found | {s: left * weight[s] / total for s in open_}
        for s in over:
            found[s] = Fraction(2 * sizes[s])
        left -= sum(found[s] for s in over)
        open_ -= over
    return sizes, found


@pytest.mark.parametrize("block", [3, None])
def test_against_brute_force(messy, messy_rows, block):
    rows = mixed_sources(messy, block_words=block).collect()
    sizes, want = targets(messy_rows)
    assert Counter((r.id, r.size) for r in rows) == Counter((r[0], len(words(r[1]))) for r in messy_rows)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by_target = defaultdict(int)
    for r in rows:
        by_target[(r.source_size, round(r.target, 6))] += r.taken
    expected = defaultdict(int)
    for s, t in want.items():
        expected[(sizes[s], round(float(t), 6))] += int(t + Fraction(1, 2))
    assert by_target == expected


def test_documents_follow_the_mix(messy, messy_rows):
    mixed = mix_documents(messy, block_words=5)
    assert mixed.columns == messy.columns
    rows = mixed.collect()
    _, want = targets(messy_rows)
    taken = Counter()
    for r in rows:
        taken[r.source] += len(words(r.text))
    assert taken == Counter({s: int(t + Fraction(1, 2)) for s, t in want.items() if t >= 0.5})
    whole = {(r[0], r[1]) for r in messy_rows}
    cut = [r for r in rows if (r.doc_id, r.text) not in whole]
    assert len(cut) <= 2 * len(want)
    for r in cut:
        assert any(r.doc_id == i and " ".join(words(t)).find(r.text) >= 0 for i, t in whole)


def test_schedule_is_even_along_the_way(spark, messy, messy_rows):
    rows = [(k, "w " * 100, f"s{k % 4}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from botica.llm.mixing import _sized

    shares = source_targets(_sized(docs, "doc_id", "text", "source"))
    slots = sorted(schedule(shares, 50).collect())
    total, quota = len(slots), {r.name: r.quota for r in shares.collect()}
    seen = Counter()
    for k, slot in enumerate(slots[: total // 2], 1):
        assert slot.block == seen[slot.name]
        seen[slot.name] += 1
    for name, n in quota.items():
        assert abs(seen[name] - n / sum(quota.values()) * (total // 2)) < 4


def test_files_as_read_give_the_same_mix(spark, messy, tmp_path):
    folder = str(tmp_path / "docs")
    messy.filter("doc_id is not null").repartition(3).write.parquet(folder)
    docs = spark.read.parquet(folder)
    assert as_read(docs).select("place").distinct().count() == docs.count()
    # Rows in memory and rows of a further step have to be copied.
    assert as_read(spark.createDataFrame([(1,)], "a int")) is None
    assert as_read(docs.filter("doc_id > 0")) is None
    read, copied = (mix_documents(docs, block_words=5, plain_files=plain) for plain in (True, False))
    taken = lambda df: Counter((r.doc_id, r.source) for r in df.collect())
    assert taken(read) == taken(copied)
    assert read.columns == docs.columns


def test_reruns_agree(messy):
    once = Counter(map(tuple, mixed_sources(messy).collect()))
    assert once == Counter(map(tuple, mixed_sources(messy.repartition(5)).collect()))


def test_nothing(nothing):
    assert mixed_sources(nothing).count() == 0
    assert mix_documents(nothing).count() == 0


def near_shares(taken, quota, most):
    """The words of every source in each run from the first on, against its share of them."""
    seen, total = Counter(), sum(quota.values())
    for name, words in taken:
        seen[name] += words
        so_far = sum(seen.values())
        assert all(abs(seen[s] - n / total * so_far) <= most for s, n in quota.items())
    assert seen == quota


def test_the_mix_is_even_in_the_order_of_its_slots(spark, tmp_path):
    from botica.llm.mixing import mix

    rows = [(k, f"w{k} " * 100, "aaaabbc"[k % 7]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = mix(docs, block_words=50).collect()
    quota = Counter()
    for r in pieces:
        quota[r.source] += r.words
    assert [r.slot for r in pieces] == sorted(r.slot for r in pieces)
    near_shares([(r.source, r.words) for r in pieces], quota, 250)
    taken = Counter()
    for r in pieces:
        taken[r.id] += r.words
        assert 0 <= r.start and r.start + r.words <= 100 and r["pass"] in (0, 1)
    assert taken == Counter({r.id: r.taken for r in mixed_sources(docs, block_words=50).collect() if r.taken})
    # The documents too, file by file.
    folder = f"{tmp_path}/mixed"
    mix_documents(docs, block_words=50).write.parquet(folder)
    read = spark.read.parquet(folder).selectExpr("_metadata.file_name f", "_metadata.row_index n", "source", "text")
    in_order = sorted(read.collect(), key=lambda r: (r.f, r.n))
    near_shares([(r.source, len(words(r.text))) for r in in_order], quota, 500)


def test_the_mix_of_messy_rows(messy, nothing):
    from botica.llm.mixing import mix

    pieces = mix(messy, block_words=5).collect()
    assert sum(r.words for r in pieces) == sum(r.taken for r in mixed_sources(messy).collect())
    assert [r.slot for r in pieces] == sorted(r.slot for r in pieces)
    assert mix(nothing).count() == 0
