"""Near-equal vectors by a PCA-ordered tiled comparison.

Vectors of one label are turned onto their principal axes, the leading ones first, and
dealt by their place on the first axis: vectors as near as the threshold asks are less
than one step apart there. Tiles of them are compared by products over the leading
axes; what the other axes can add is bounded by the norms of the rest, and a pair is
left as soon as its cosine cannot reach the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.llm.links import by_group, forest, grouped, tiles
from botica.llm.staging import numbered, ship_code, widened, written

# Room for rounding in bounds, far above that of sums of doubles.
SLACK = 1e-9


def _rows_of(column: pa.ListArray, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)


def _units(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector at length one, and a digest of it as it was; null where it has no direction."""
    for batch in parts:
        units, digests = [], []
        for vector, label in zip(batch.column("vector").to_pylist(), batch.column("label").to_pylist(), strict=True):
            unit = digest = None
            if vector and label is not None and None not in vector:
                x = np.array(vector, dtype=np.float64) + 0.0
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    scaled = x / top
                    unit = scaled / np.sqrt(scaled @ scaled)
                    digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            units.append(unit)
            digests.append(digest)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(units, pa.list_(pa.float64())), pa.array(digests, pa.binary())],
            ["id", "label", "unit", "digest"],
        )


def _products(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's sums of products, for each number of dimensions."""
    totals: dict[int, np.ndarray] = {}
    for batch in parts:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            x = _rows_of(batch.column("unit").filter(pa.array(dims == d)), d)
            totals[d] = totals.get(d, 0) + x.T @ x
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.int64()), pa.array([t.ravel() for t in totals.values()], pa.list_(pa.float64()))],
        ["dims", "sums"],
    )


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions the axes, one a column, of falling spread.

    The driver gets dimensions squared numbers, whatever the rows.
    """
    sums = classes.select("dims", "unit").mapInArrow(_products, "dims long, sums array<double>")
    cells = sums.select("dims", F.posexplode("sums").alias("place", "value"))
    found: dict[int, np.ndarray] = {}
    for d, place, value in cells.groupBy("dims", "place").agg(F.sum("value")).collect():
        found.setdefault(d, np.zeros(d * d))[place] = value
    return {d: np.linalg.eigh(s.reshape(d, d))[1][:, ::-1].copy() for d, s in found.items()}


def steps(dims: int) -> list[slice]:
    """The axes in the order of comparison: a quarter of them, then twice as many each time."""
    at, step, out = 0, max(1, dims // 4), []
    while at < dims:
        out.append(slice(at, min(dims, at + step)))
        at, step = at + step, at + step
    return out


def compare(
    units: np.ndarray, axes: np.ndarray, meet, threshold: float, rows: int = 512
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, first below second, for which ``meet`` holds, at or above the threshold."""
    turned = units @ axes
    parts = steps(units.shape[1])
    # What is left of each vector's length after each step.
    rest = [np.sqrt(np.maximum(0, (turned[:, p.stop :] ** 2).sum(axis=1))) for p in parts]
    got_a, got_b = [], []
    for at in range(0, len(units), rows):
        lead = turned[at : at + rows, parts[0]] @ turned[:, parts[0]].T
        a, b = np.nonzero(lead + np.outer(rest[0][at : at + rows], rest[0]) >= threshold - SLACK)
        product = lead[a, b]
        a = a + at
        on = (a < b) & meet(a, b)
        a, b, product = a[on], b[on], product[on]
        for k, part in enumerate(parts[1:], 1):
            product = product + np.einsum("ij,ij->i", turned[a, part], turned[b, part])
            on = product + rest[k][a] * rest[k][b] >= threshold - SLACK
            a, b, product = a[on], b[on], product[on]
        on = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
        got_a.append(a[on])
        got_b.append(b[on])
    return np.concatenate(got_a), np.concatenate(got_b)


def _compared(axes: dict[int, np.ndarray], threshold: float):
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_group(parts, "tile", 2048):
            tile, rep, copies, dims, cell, at, block = (
                part.column(c).to_numpy() for c in ("tile", "rep", "copies", "dims", "cell", "at", "block")
            )
            only = part.column("only").to_numpy(zero_copy_only=False).astype(bool)
            units = part.column("unit").combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]]).tolist()
            for first, last in zip(starts, starts[1:], strict=False):
                own = slice(first, last)
                if last - first < 2 or not (cell[own] == at[own]).any():
                    continue
                c, blk, alone, here = cell[own], block[own], only[first], at[first]

                # Each vector is at its own step and the one below; a pair counts at the lower.
                def meet(a, b, c=c, blk=blk, alone=alone, here=here):
                    return (np.minimum(c[a], c[b]) == here) & (alone | (blk[a] != blk[b]))

                d = int(dims[first])
                a, b = compare(_rows_of(units[own], d), axes[d], meet, threshold)
                weight = np.zeros(last - first, dtype=np.int64)
                np.add.at(weight, a, copies[own][b])
                np.add.at(weight, b, copies[own][a])
                root = forest(last - first, a, b)
                linked = weight > 0
                if linked.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rep[own][linked]), pa.array(weight[linked]), pa.array(rep[own][root[linked]])],
                        ["rep", "weight", "root"],
                    )

    return work


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    block: int = 1024,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of one label and length are linked at a cosine of at least ``threshold``
    (positive), in double precision. Those that are null, empty, zero, or hold null or
    non-finite components, and those without a label, link with nothing. ``n_links``
    counts all other rows linked directly, equal ones too; a group is what links reach,
    named by its smallest id, whose row is kept (null ids come last; of rows repeated
    with one id exactly one stays). An empty table gives an empty result.
    """
    ship_code(vectors.sparkSession)
    slim = vectors.select(
        F.col(id_col).alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    schema = widened(slim.drop("vector"), "unit array<double>, digest binary")
    staged = numbered(slim.mapInArrow(_units, schema), "vectors")

    # Equal vectors are one class, compared by one of them.
    same = staged.where("digest is not null").groupBy("label", "digest")
    same = written(same.agg(F.min("row").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    rows = staged.select("row", "id", "label", "digest")
    rows = rows.join(same.select("label", "digest", "rep"), ["label", "digest"], "left")
    classes = same.select("rep", "label", "copies").join(staged.select(F.col("row").alias("rep"), "unit"), "rep")
    classes = written(classes.withColumn("dims", F.size("unit").cast("long")), "vector-units")
    axes = principal_axes(classes)

    step = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    first = {d: a[:, 0] for d, a in axes.items()}

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            dims = batch.column("dims").to_numpy()
            cell = np.zeros(len(dims), dtype=np.int64)
            for d in np.unique(dims).tolist():
                own = dims == d
                cell[own] = np.floor(_rows_of(batch.column("unit").filter(pa.array(own)), d) @ first[d] / step)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int64())], [*batch.schema.names, "cell"]
            )

    placed = written(classes.mapInArrow(place, widened(classes, "cell long")), "vector-cells")
    members = placed.select("rep", "label", "dims", "cell", F.explode(F.array(F.col("cell") - 1, "cell")).alias("at"))
    members = tiles(members, ["label", "dims", "at"], block)
    members = members.join(placed.select("rep", "copies", "unit"), "rep")
    members = members.select("tile", "rep", "copies", "dims", "cell", "at", "block", "only", "unit")
    found = members.repartition("tile").sortWithinPartitions("tile")
    found = found.mapInArrow(_compared(axes, threshold), "rep long, weight long, root long")
    return grouped(rows, classes, found).select("id", "n_links", "component_id", "kept")
