"""Text quality by a regularised quadratic discriminant.

Each class of labelled documents has a Gaussian over transformed statistics of the
text. Its covariance is shrunk towards the one of all classes and towards a diagonal,
and its Cholesky factor is kept, so that a score is a difference of log densities.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.llm.staging import ship_code, widened, written
from botica.llm.words import SPAN, as_bytes, batches, mix, release, word_hashes

_KINDS = ("lower", "upper", "digit", "blank", "line", "stop", "sign", "pipe", "high")
_kind = np.full(256, _KINDS.index("sign"), dtype=np.uint8)
_kind[:32] = _KINDS.index("blank")
_kind[32] = _KINDS.index("blank")
_kind[10] = _KINDS.index("line")
_kind[48:58] = _KINDS.index("digit")
_kind[65:91] = _KINDS.index("upper")
_kind[97:123] = _KINDS.index("lower")
_kind[[33, 39, 44, 45, 46, 58, 59, 63]] = _KINDS.index("stop")
_kind[[60, 62, 91, 93, 95, 123, 124, 125]] = _KINDS.index("pipe")
_kind[128:] = _KINDS.index("high")

FEATURES = (
    *(f"share_{kind}" for kind in _KINDS),
    "log_bytes",
    "log_words",
    "word_bytes",
    "log_lines",
    "line_words",
    "distinct_words",
    "distinct_lines",
    "top_word",
    "distinct_pairs",
    "word_entropy",
)


def statistics(text: bytes) -> list[float]:
    """Statistics of one text, transformed to spread evenly; all of them finite."""
    counts = np.zeros(len(_KINDS), dtype=np.int64)
    for at in range(0, len(text), SPAN):
        part = _kind[np.frombuffer(text[at : at + SPAN], dtype=np.uint8)]
        counts += np.bincount(part, minlength=len(_KINDS))
    shares = np.arcsin(np.sqrt(counts / max(1, len(text))))
    words = word_hashes(text)
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    if n:
        repeats = np.unique(words, return_counts=True)[1]
        pairs = len(np.unique(mix(words[:-1]) + words[1:])) if n > 1 else 1
        of_all = repeats / n
        entropy = float(-(of_all * np.log(of_all)).sum())
    else:
        repeats, pairs, entropy = np.zeros(1), 0, 0.0
    root = lambda part, whole: float(np.arcsin(np.sqrt(part / max(1, whole))))
    return [
        *shares.tolist(),
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(np.log1p(len(text) / max(1, n))),
        float(np.log1p(len(lines))),
        float(np.log1p(n / max(1, len(lines)))),
        root(len(repeats) if n else 0, n),
        root(len(set(lines)), len(lines)),
        root(int(repeats.max()), n),
        root(pairs, max(1, n - 1)),
        entropy / float(np.log(n + 1)) if n else 0.0,
    ]


def _measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        texts = as_bytes(batch.column("text"))
        rest = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        for first, last in batches(texts):
            got = [statistics(t) for t in texts[first:last]]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).slice(first, last - first) for k in rest),
                    pa.array(got, pa.list_(pa.float64())),
                ],
                [*(batch.schema.names[k] for k in rest), "features"],
            )
    release()


def text_statistics(docs: DataFrame, text_col: str = "text", *columns) -> DataFrame:
    """The given columns and ``features``; null texts are empty."""
    ship_code(docs.sparkSession)
    slim = docs.select(*columns, F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_measure, widened(slim.drop("text"), "features array<double>"))


def _moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's count, sum and sum of products for each class."""
    p = len(FEATURES)
    totals: dict[int, np.ndarray] = {}
    for batch in parts:
        x = np.array(batch.column("features").to_pylist(), dtype=np.float64).reshape(-1, p)
        y = np.array(batch.column("label").to_pylist())
        for label in set(y.tolist()):
            own = np.hstack([np.ones(((y == label).sum(), 1)), x[y == label]])
            totals[label] = totals.get(label, 0) + own.T @ own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.int32()), pa.array([t.ravel() for t in totals.values()], pa.list_(pa.float64()))],
        ["label", "sums"],
    )


class QuadraticDiscriminant:
    """Two shrunk Gaussians and their prior; made from sums over all labelled rows.

    ``towards_pooled`` and ``towards_diagonal`` are the shares of the pooled covariance
    and of its diagonal. One class without rows, or none, gives a constant score.
    """

    def __init__(
        self, sums: dict[int, np.ndarray], towards_pooled: float = 0.7, towards_diagonal: float = 0.05
    ):
        p = len(FEATURES)
        counts = {label: s[0, 0] for label, s in sums.items()}
        total = sum(counts.values())
        self.constant = None
        if len(sums) < 2:
            self.constant = 1.0 if 1 in sums else 0.0 if 0 in sums else 0.5
            return
        means = {label: s[0, 1:] / s[0, 0] for label, s in sums.items()}
        scatter = {
            label: s[1:, 1:] - counts[label] * np.outer(means[label], means[label]) for label, s in sums.items()
        }
        pooled = sum(scatter.values()) / total
        # A floor keeps features without spread from dividing by nothing.
        floor = 1e-4 * np.trace(pooled) / p + 1e-9
        self.classes = {}
        for label in (0, 1):
            own = scatter[label] / counts[label]
            own = (1 - towards_pooled) * own + towards_pooled * pooled
            own = (1 - towards_diagonal) * own + towards_diagonal * np.diag(np.diag(own))
            factor = np.linalg.cholesky(own + floor * np.eye(p))
            shift = np.log(counts[label] / total) - np.log(np.diag(factor)).sum()
            self.classes[label] = (means[label], np.linalg.inv(factor), shift)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = {}
        for label, (mean, inverse, shift) in self.classes.items():
            away = (x - mean) @ inverse.T
            logs[label] = shift - 0.5 * (away * away).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(measured: DataFrame) -> QuadraticDiscriminant:
    """The model of the rows (features, label); labels other than 0 and 1 are left out.

    Only each class's sums reach the driver: a number of features squared.
    """
    rows = measured.where("label in (0, 1)").select("features", F.col("label").cast("int"))
    partial = rows.mapInArrow(_moments, "label int, sums array<double>")
    place = partial.select("label", F.posexplode("sums").alias("place", "value"))
    totals = place.groupBy("label", "place").agg(F.sum("value").alias("value"))
    p = len(FEATURES) + 1
    sums: dict[int, np.ndarray] = {}
    for label, at, value in totals.collect():
        sums.setdefault(label, np.zeros(p * p))[at] = value
    return QuadraticDiscriminant({label: s.reshape(p, p) for label, s in sums.items()})


def scored(measured: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """``features`` replaced by ``score``."""
    rest = [c for c in measured.columns if c != "features"]

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = np.array(batch.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(model.score(x), pa.float64())], [*rest, "score"]
            )

    return measured.mapInArrow(score, widened(measured.select(*rest), "score double"))


def _held_out(column: str = "id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where(
        "id is not null and label is not null"
    )


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: better), predicted.

    ``labels`` has doc_id and quality. The model learns from labelled documents whose
    crc32 of the id as text isn't a multiple of 5 (a null id is neither labelled nor
    held out), and sees the text alone. Null and empty texts are scored by their
    statistics like any other. An empty table gives an empty result; labels of one
    class a constant score, no labels 0.5.
    """
    measured = written(text_statistics(docs, text_col, F.col(id_col).alias("id")), "quality")
    known = measured.join(_labelled(labels), "id").where(~_held_out())
    return scored(measured, fit(known)).select(
        "id",
        F.coalesce(_held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
) -> DataFrame:
    """The documents, all their columns, that score at least ``threshold``.

    The texts are measured twice, to fit the model and to drop rows where they are read:
    no document is shuffled or stored.
    """
    measured = text_statistics(docs, text_col, F.col(id_col).alias("id"))
    model = fit(measured.join(_labelled(labels), "id").where(~_held_out()))
    names = [f"c{k}" for k in range(len(docs.columns))]
    place = docs.columns.index(text_col)

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = as_bytes(batch.column(place).cast(pa.string()))
            good = [model.score(np.array([statistics(t)]))[0] >= threshold for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))
        release()

    return docs.toDF(*names).mapInArrow(keep, docs.toDF(*names).schema).toDF(*docs.columns)


def describe(model: QuadraticDiscriminant) -> str:
    """The class means by feature, as JSON text."""
    if model.constant is not None:
        return json.dumps({"constant": model.constant})
    return json.dumps(
        {label: dict(zip(FEATURES, m[0].round(4).tolist(), strict=True)) for label, m in model.classes.items()}
    )
