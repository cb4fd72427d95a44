from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest

from botica.llm.quality import FEATURES, QuadraticDiscriminant, keep_good, quality_scores, statistics

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, truth[r.id]) for r in rows if r.held_out and r.id in truth]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert np.mean([p for p, t in held if t]) > 0.97


def test_score_is_the_difference_of_densities():
    rng = np.random.default_rng(2)
    p = len(FEATURES)
    x = {0: rng.normal(size=(400, p)) * 2 + 1, 1: rng.normal(size=(900, p))}
    sums = {k: np.hstack([np.ones((len(v), 1)), v]).T @ np.hstack([np.ones((len(v), 1)), v]) for k, v in x.items()}
    model = QuadraticDiscriminant(sums, towards_pooled=0, towards_diagonal=0)
    point = rng.normal(size=(5, p))
    logs = []
    for k in (0, 1):
        cov = np.cov(x[k].T, bias=True)
        away = point - x[k].mean(axis=0)
        far = (away @ np.linalg.inv(cov) * away).sum(axis=1)
        logs.append(np.log(len(x[k]) / 1300) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * far)
    assert np.allclose(model.score(point), 1 / (1 + np.exp(logs[0] - logs[1])), atol=0.02)


@pytest.mark.parametrize("text", [b"", b" \n", b"a", b"x" * 100_000, b"a b " * 400_000, "é\n".encode() * 50])
def test_statistics_are_finite(text):
    assert len(statistics(text)) == len(FEATURES)
    assert np.isfinite(statistics(text)).all()


@pytest.mark.parametrize("given,score", [([], 0.5), ([(0, 1), (1, 1)], 1.0), ([(0, 0), (1, 0)], 0.0)])
def test_few_labels(spark, messy, given, score):
    labels = spark.createDataFrame([(i, q) for i, q in given] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality_scores(messy, labels).collect()} == {score}


def test_keeping_good_ones(spark, messy, messy_rows, nothing):
    labels = spark.createDataFrame([(k, int(k < 8)) for k in range(12)] + [(2, 0), (99, 1)], "doc_id long, quality int")
    scores = quality_scores(messy, labels).collect()
    left = keep_good(messy, labels)
    assert left.columns == messy.columns
    ids = sorted(((r.doc_id is None, r.doc_id) for r in left.collect()))
    assert ids == sorted((r.id is None, r.id) for r in scores if r.predicted)
    assert quality_scores(nothing, labels).count() == 0
    assert keep_good(nothing, labels).count() == 0
