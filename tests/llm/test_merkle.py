from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from botica.llm import merkle
from tests.llm.conftest import COLUMNS, document

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    values = (None if row[f] is None else str(row[f]) for f in FIELDS)
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """The root, and for each node its siblings with their sides."""
    places, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for path, p in zip(paths, places):
            other = p ^ 1
            path.append((nodes[other], other < p) if other < len(nodes) else None)
        nodes = [digest("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        places = [p // 2 for p in places]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        entries = sorted(groups[name], key=lambda e: e[:3])
        trees[name] = (entries, *climb([e[2] for e in entries]))
    root, upper = climb([trees[n][1] for n in names])
    out = []
    for name, above in zip(names, upper):
        entries, subroot, paths = trees[name]
        for (named, _, own, row), path in zip(entries, paths):
            path = [*path, *above]
            node = own
            if named and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None:
                node = leaf(row | {"n_chars": row["n_chars"] + 1})
            for step in path:
                node = digest(node) if step is None else digest(step[0] + node if step[1] else node + step[0])
            proof = digest("".join(s[0] for s in path if s is not None))
            out.append((row["doc_id"], own, subroot, root, proof, node, node == root))
    return out


def check(docs, rows):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = [tuple(r) for r in merkle.manifest(docs, tampered=chosen).collect()]
    key = lambda r: tuple((v is None, v) for v in r)
    want = brute([dict(zip(COLUMNS.fieldNames(), r)) for r in rows])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_against_brute_force(messy, messy_rows):
    check(messy, messy_rows)


def test_many_leaves_odd_ids_and_groups(spark):
    ids = [*range(-40, 2500), *(k * 70_000 for k in range(1, 60)), 1 << 40, -(1 << 62), (1 << 63) - 1, -(1 << 63)]
    rows = [document(k, f"text {k}", lang="en") for k in ids]
    # One id many times, with equal and with different rows; many small groups; ids without end.
    rows += [document(77, f"copy {k % 9}", lang="en") for k in range(300)]
    rows += [document(None, f"unnamed {k % 4}", lang="en") for k in range(20)]
    rows += [document(k, "t", lang=f"g{k % 37}é") for k in range(90)] + [document(1, "t", lang=""), document(2, "t", lang=None)]
    rows += [(5, "long", "", None, (1 << 63) - 1, *"abcdefghi"), (21, "long", "xx", None, (1 << 63) - 1, *"abcdefghi")]
    check(spark.createDataFrame(rows, COLUMNS).repartition(4), rows)


@pytest.mark.parametrize("rows", [1, 2, 3, 1024, 1025])
def test_sizes_around_an_array(spark, rows):
    docs = [document(k, "t", lang="x") for k in range(rows)]
    check(spark.createDataFrame(docs, COLUMNS), docs)


def test_places_need_no_sort_of_all_rows(messy):
    docs = messy.select(F.col("doc_id").alias("id"), F.lit("t").alias("tree"), F.sha2("text", 256).alias("leaf"))
    plan = merkle.ranks(merkle.numbered(docs, "t")).where("slot >= 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rank(" not in plan


def test_nothing(nothing):
    assert merkle.manifest(nothing).count() == 0
