"""Hard negatives of anchor vectors by Fagin's threshold algorithm.

Vectors become integers and are dealt to blocks of one label and near places. In a
block each dimension has its list of rows in order of the component. An anchor reads
all lists at once, from the end that its own sign favours, scores the rows it meets in
integers, and stops when what any row not yet met could score falls strictly below the
k-th best score of every window that the anchor asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botica.llm.staging import numbered, ship_code, written

# Rows of a block, and anchors that are sent to it together.
BLOCK = 4096
ANCHORS = 256
# Lists are read this deep at first, then twice as deep each time.
DEPTH = 8
_LONG = (1 << 63) - 1


def _ints(scale: int) -> Column:
    """Components times ``scale``, rounded down; null for a vector that takes no part."""
    product = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale)).cast("double")).cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Products of two such vectors fit into a long.
    bound = F.lit(float(_LONG)) / F.greatest(F.size("vector"), F.lit(1))
    small = F.forall(product, lambda x: x * x < bound)
    return F.when(F.coalesce(finite & small, F.lit(False)), F.transform(product, lambda x: x.cast("long")))


class Lists:
    """One block's rows, and for each dimension the rows in ascending order of it."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, self.order, axis=0)

    def best(self, anchor: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the rows met until ``enough(places, scores, threshold)``.

        No row that was not met scores above the threshold.
        """
        count = len(self.rows)
        dims = np.flatnonzero(anchor)
        weights = anchor[dims]
        met = np.zeros(count, dtype=bool)
        places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, step = 0, DEPTH
        up = weights < 0
        if count:
            ends = np.where(up, self.sorted[0, dims], self.sorted[-1, dims])
            if enough(places[0], scores[0], int((weights * ends).sum())):
                return places[0], scores[0]
        while at < count:
            stop = min(count, at + step)
            if len(dims):
                # The lists' next rows: from the low end for negative weights, else from the high one.
                near = self.order[at:stop][:, dims[up]].ravel()
                far = self.order[count - stop : count - at][:, dims[~up]].ravel()
                new = np.concatenate([near, far])
                fresh = np.zeros(count, dtype=bool)
                fresh[new] = True
                new = np.flatnonzero(fresh & ~met)
                last = np.where(up, self.sorted[stop - 1, dims], self.sorted[count - stop, dims])
                threshold = int((weights * last).sum())
            else:
                new, threshold, stop = np.arange(count), 0, count
            met[new] = True
            places.append(new)
            scores.append(self.rows[new] @ anchor)
            at, step = stop, step * 2
            places, scores = [np.concatenate(places)], [np.concatenate(scores)]
            if stop < count and enough(places[0], scores[0], threshold):
                break
        return places[0], scores[0]


def _top(scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k first by falling score, then rising id (null last), then row."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        on = np.flatnonzero(scores >= kth)
    else:
        on = np.arange(len(scores))
    return on[np.lexsort((rows[on], ids[on], unnamed[on], -scores[on]))][:k]


def _matrix(blob: bytes, dims: int, count: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int64).reshape(count, dims)


def _blocks(block: int):
    """Rows of one (dims, label), neighbours in the input, as arrays of a block each."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None

        def out():
            rows, ids, vectors = zip(*held, strict=True)
            data = np.array(vectors, dtype=np.int64).reshape(len(vectors), now[0])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([now[0]], pa.int64()),
                    pa.array([now[1]], pa.int64()),
                    pa.array([rows], pa.list_(pa.int64())),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([data.tobytes()], pa.binary()),
                ],
                ["dims", "label", "rows", "ids", "data"],
            )

        for batch in parts:
            columns = (batch.column(c).to_pylist() for c in ("dims", "label", "row", "id"))
            flat, ends = batch.column("ints"), batch.column("ints").offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False)
            for k, (dims, label, row, id_) in enumerate(zip(*columns, strict=True)):
                if held and ((dims, label) != now or len(held) == block):
                    yield out()
                    held = []
                now = (dims, label)
                held.append((row, id_, values[ends[k] : ends[k + 1]]))
        if held:
            yield out()

    return work


_FOUND = "anchor long, window long, score long, row long, id long"


def _searched(k: int, same: bool, low: int, whole: int):
    """Meets each block with the anchors that were sent to it.

    With ``same`` an anchor asks for the k best other rows; else, for each positive
    score p of its windows, for the k best rows that score from low/whole of p to p.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = rows = ids = unnamed = None
        for batch in parts:
            for entry in batch.to_pylist():
                if entry["data"] is not None:
                    rows = np.array(entry["rows"], dtype=np.int64)
                    unnamed = np.array([i is None for i in entry["ids"]], dtype=bool)
                    ids = np.array([i or 0 for i in entry["ids"]], dtype=np.int64)
                    lists = Lists(_matrix(entry["data"], entry["dims"], len(rows)))
                    continue
                anchors = _matrix(entry["vectors"], entry["dims"], len(entry["anchors"]))
                found = []
                for anchor, vector, windows in zip(entry["anchors"], anchors, entry["windows"], strict=True):
                    if same:
                        bounds = [(None, -_LONG - 1, _LONG)]
                    else:
                        # p * low <= whole * n, rounded up.
                        bounds = [(p, -(-low * p // whole), p) for p in sorted(set(windows))]
                        bounds = [b for b in bounds if b[1] <= b[2]]
                    if not bounds:
                        continue

                    def enough(places, scores, threshold, bounds=bounds, anchor=anchor):
                        for _, least, most in bounds:
                            if threshold < least:
                                continue
                            on = scores[(scores >= least) & (scores <= most)]
                            if same:
                                on = scores[rows[places] != anchor]
                            if len(on) < k or threshold >= np.partition(on, len(on) - k)[len(on) - k]:
                                return False
                        return True

                    places, scores = lists.best(vector, enough)
                    if same:
                        other = rows[places] != anchor
                        places, scores = places[other], scores[other]
                    for window, least, most in bounds:
                        on = np.flatnonzero((scores >= least) & (scores <= most))
                        p, s = places[on], scores[on]
                        top = _top(s, ids[p], unnamed[p], rows[p], k)
                        found += [
                            (anchor, window, int(s[t]), int(rows[p[t]]), None if unnamed[p[t]] else int(ids[p[t]]))
                            for t in top.tolist()
                        ]
                columns = zip(*found, strict=True) if found else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["anchor", "window", "score", "row", "id"]
                )

    return work


def _met(blocks: DataFrame, sent: DataFrame, search) -> DataFrame:
    """Each block followed by the batches of anchors that were sent to it, searched."""
    empty = {"rows": "array<long>", "ids": "array<long>", "data": "binary"}
    asked = {"anchors": "array<long>", "windows": "array<array<long>>", "vectors": "binary"}
    both = blocks.select("block", "dims", *empty, *(F.lit(None).cast(t).alias(c) for c, t in asked.items()))
    both = both.withColumn("kind", F.lit(0)).unionByName(
        sent.select("block", "dims", *asked, *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), F.lit(1).alias("kind"))
    )
    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(search, _FOUND)


def _first(found: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: str | Column = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    whole: int = 100,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components times ``scale``, rounded down, are integers; a score is their inner
    product. Rows for which ``anchors`` (over id) holds are anchors. Their positives are
    the first other rows of the same label by falling score, then id; for each of them
    the negatives are the first rows of other labels whose score is from low/whole of
    the positive's to the positive's. Rows with a null label, a null vector, null or
    non-finite components, or components whose scores would pass a long, take no part;
    vectors of different length do not meet; those without components all score 0. Null
    ids come last; rows repeated with one id are rows of their own, so that an anchor's
    copy can be its positive. Other columns are not looked at; an empty table, or one
    without anchors or other labels, gives an empty result.
    """
    ship_code(vectors.sparkSession)
    id_ = F.col(f"`{id_col}`").cast("long")
    of = F.col(f"`{label}`") if isinstance(label, str) else label
    slim = vectors.select(
        id_.alias("id"), of.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    )
    slim = slim.where("label is not null and vector is not null").withColumn("ints", _ints(scale))
    slim = slim.where("ints is not null").select("id", "label", "ints", F.size("ints").cast("long").alias("dims"))
    slim = slim.withColumn("anchor", F.coalesce(anchors, F.lit(False)))
    staged = numbered(slim, "negative-rows")
    # Near rows share a block: those of a label in the order of their leading components.
    order = ["dims", "label", *(F.try_element_at("ints", F.lit(k)) for k in (1, 2)), "row"]
    dealt = staged.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = dealt.select("dims", "label", "row", "id", "ints").mapInArrow(
        _blocks(block), "dims long, label long, rows array<long>, ids array<long>, data binary"
    )
    blocks = numbered(blocks, "negative-blocks", "block")
    known = blocks.select("block", "dims", "label")

    def batched(rows: DataFrame) -> DataFrame:
        """Anchors in batches: dims, label, anchors, windows, vectors."""
        batch = F.pmod(F.xxhash64("row"), F.greatest(F.ceil(F.col("n") / ANCHORS), F.lit(1))).alias("batch")
        sizes = rows.groupBy("dims", "label").agg(F.count("*").alias("n"))
        rows = rows.join(sizes, ["dims", "label"]).select("dims", "label", "row", "ints", "windows", batch)
        held = rows.groupBy("dims", "label", "batch").agg(F.collect_list(F.struct("row", "windows", "ints")).alias("e"))
        return written(
            held.select(
                "dims",
                "label",
                F.col("e.row").alias("anchors"),
                F.col("e.windows").alias("windows"),
                F.flatten("e.ints").alias("flat"),
            ).mapInArrow(
                _packed, "dims long, label long, anchors array<long>, windows array<array<long>>, vectors binary"
            ),
            "negative-anchors",
        )

    asked = staged.where("anchor").select("row", "id", "label", "dims", "ints")
    nothing = F.array().cast("array<long>").alias("windows")
    sent = batched(asked.select("*", nothing)).join(known, ["dims", "label"])
    found = written(_met(blocks, sent, _searched(positives, True, low, whole)), "positives")
    # The pairs of anchors and positives are a small table: a few rows for each anchor.
    pairs = written(_first(found, ["anchor"], positives, "place"), "negative-pairs")
    windows = pairs.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("windows"))
    sent = batched(asked.join(windows, "row"))
    sent = sent.join(known.withColumnRenamed("label", "other"), "dims").where("label != other")
    found = written(_met(blocks, sent, _searched(negatives, False, low, whole)), "negatives")
    best = _first(found, ["anchor", "window"], negatives, "rank")
    names = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    chosen = pairs.select("anchor", F.col("score").alias("window"), F.col("id").alias("positive_id"))
    return (
        chosen.join(best, ["anchor", "window"])
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            F.col("window").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        data = [
            np.array(x or [], dtype=np.int64).tobytes() for x in batch.column("flat").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("dims", "label", "anchors", "windows")), pa.array(data, pa.binary())],
            ["dims", "label", "anchors", "windows", "vectors"],
        )
