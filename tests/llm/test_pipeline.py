"""The stages of the pipeline on planted rows, against plain Python, and the whole run."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from botica.llm import quality
from botica.llm.queries import word_bpe
from tests.llm.conftest import COLUMNS, document, story

STAGES = dict(corpus_pipeline.STAGES)


def plain(text):
    return (text or "").encode().lower()


def words(text):
    return plain(text).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")


def shingles(text):
    found = [w for w in words(text) if w]
    width = min(5, len(found))
    return {tuple(found[k : k + width]) for k in range(len(found) - width + 1)} if found else set()


def planted():
    """Distinct stories, exact and near copies of some, short, empty and null texts."""
    rows = [document(k, story(300 + k, 150 + 7 * k), source="abc"[k % 3]) for k in range(24)]
    rows += [document(100 + k, rows[k][1].upper() if k % 2 else rows[k][1]) for k in range(8)]
    rows += [document(200 + k, rows[k][1] + f" tail{k}", source="b") for k in range(8, 14)]
    rows += [document(300, None), document(301, ""), document(302, "two words"), document(303, "Two Words", None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(planted(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and labels: stories are good, runs of one word are poor."""
    path = tmp_path_factory.mktemp("corpus")
    rows = planted() + [document(1000 + k, f"buy{k % 5} now " * (40 + k)) for k in range(60)]
    rows += [document(2000 + k, story(900 + k, 120 + k)) for k in range(60)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(1000 + k, 0, 0) for k in range(60)] + [(2000 + k, 1, 0) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_in_order():
    assert list(STAGES) == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "source_mixing", "packing"]


def test_quality_keeps_what_the_scores_accept(spark, folder):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    kept = STAGES["quality_classifier"](spark, given, folder)
    assert kept.columns == given.columns
    scores = quality.quality_scores(given, spark.read.parquet(f"{folder}/labels.parquet"))
    want = sorted(r["id"] for r in scores.where("predicted = 1").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert {2000 + k for k in range(60)} <= set(want) and not {1000 + k for k in range(60)} & set(want)


def test_exact_dedup_keeps_the_largest_id(spark, docs):
    kept = STAGES["exact_dedup"](spark, docs, "")
    largest = {}
    for row in planted():
        largest[plain(row[1])] = max(row[0], largest.get(plain(row[1]), row[0]))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(largest.values())


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    rows = planted()
    parent = {r[0]: r[0] for r in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = {r[0]: shingles(r[1]) for r in rows}
    for a in sets:
        for b in sets:
            same = plain(dict((r[0], r[1]) for r in rows)[a]) == plain(dict((r[0], r[1]) for r in rows)[b])
            both = len(sets[a] | sets[b])
            if a < b and (same or (both and len(sets[a] & sets[b]) / both >= 0.8)):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    kept = [r["doc_id"] for r in STAGES["ngram_jaccard_join"](spark, docs, "").collect()]
    groups = Counter(root(k) for k in kept)
    # Texts without words are copies of nothing here, or of each other: one of them stays at least.
    worded = {root(k) for k in sets if sets[k]}
    assert {g: n for g, n in groups.items() if g in worded} == dict.fromkeys(worded, 1)


def test_mixing_takes_each_source_to_its_target(spark, docs):
    from botica.llm.mixing import mixed_sources

    found = STAGES["source_mixing"](spark, docs, "")
    assert found.columns == docs.columns
    taken = Counter()
    for row in found.collect():
        taken[row["doc_id"]] += sum(1 for w in words(row["text"]) if w)
    want = {r["id"]: r["taken"] for r in mixed_sources(docs).collect() if r["taken"]}
    assert taken == want
    originals = {r[0]: r[1] for r in planted()}
    for row in found.collect():
        whole = [w for w in words(originals[row["doc_id"]]) if w]
        part = [w for w in words(row["text"]) if w]
        assert any(whole[k : k + len(part)] == part for k in range(len(whole) - len(part) + 1))


def test_packing_holds_every_id_once(spark, docs):
    tokenizer = Tokenizer.from_str(word_bpe())
    pieces = defaultdict(list)
    for row in STAGES["packing"](spark, docs, "").collect():
        pieces[row["doc_id"]].append((row["start"], np.frombuffer(bytes(row["ids"]), dtype="<u4").tolist()))
    for doc_id, text in ((r[0], r[1]) for r in planted()):
        got = [i for _, ids in sorted(pieces[doc_id]) for i in ids]
        assert got == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_run_is_its_stages(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    assert not ids & {1000 + k for k in range(60)}
    # Of the planted copies only the last ones can be left.
    assert not ids & set(range(8)) and ids <= {r[0] for r in planted()} | {2000 + k for k in range(60)}
    lengths = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("one"))
    assert lengths.where("n < one").count() == 0
