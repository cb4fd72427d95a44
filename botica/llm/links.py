"""From links between rows to groups of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.llm.staging import written
from botica.workspace import new_folder, remove_folder


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that links reach, for each node with a link.

    Each round hangs every node's larger neighbours, then its smaller ones, under its
    smallest, until all edges are stars; rounds grow with the logarithm of the longest
    path. A round's edges are a table in the shared folder.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        folder = new_folder(spark, "edges")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder), folder

    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    now, folder = stored(pair.distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        former = folder
        now, folder = stored(small.distinct())
        remove_folder(spark, former)
        # Stars: no node hangs under two, and none that hangs has others under it.
        several = now.groupBy("u").count().where("count > 1").isEmpty()
        if several and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """row, id, n_links, component_id, kept.

    ``rows`` has row, id and rep (the row that stands for its copies; null: links with
    nothing), ``classes`` rep and copies, ``found`` rep, weight (rows linked, in parts
    that add up) and root (a linked rep, or itself). The row of a group with the
    smallest id is kept; null ids come last, and of equal ids one.
    """
    found = written(found, "links")
    weights = found.groupBy("rep").agg(F.sum("weight").alias("weight"))
    roots = components(found, "rep", "root").withColumnRenamed("node", "rep")
    of_class = written(
        classes.select("rep", "copies")
        .join(weights, "rep", "left")
        .join(roots, "rep", "left")
        .select(
            "rep",
            F.coalesce("root", "rep").alias("root"),
            (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).cast("long").alias("n_links"),
        ),
        "link-classes",
    )
    placed = written(
        rows.select("row", "id", "rep")
        .join(of_class, "rep", "left")
        .select(
            "row", "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "row").alias("root")
        ),
        "link-rows",
    )
    first = placed.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("first")
    )
    return placed.join(first, "root").select(
        "row",
        "id",
        "n_links",
        F.col("first.id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def tiles(members: DataFrame, key: list[str], width: int) -> DataFrame:
    """Adds tile (a hash of key and two blocks) and block, for keys of several members.

    The members of a key are dealt to blocks of about ``width`` by hash of their rep.
    Two blocks meet in one tile, so that every pair of a key meets, and none in a task
    that grows with the key.
    """
    sizes = members.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    blocks = sizes.select(*key, F.ceil(F.col("n") / width).alias("blocks"))
    dealt = members.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.xxhash64(*key, F.least("block", "other"), F.greatest("block", "other"))
    alone = F.col("blocks") == 1
    return dealt.withColumn("tile", tile).withColumn("only", alone | (F.col("block") == F.col("other"))).drop(
        "blocks", "other"
    )


def by_group(parts: Iterator[pa.RecordBatch], column: str, rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in which each group's rows are neighbours.

    A table has about ``rows`` rows, or as many as its last group needs.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in parts:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(values[1:] != values[:-1])
        if not len(changes):
            continue
        cut = int(changes[-1]) + 1
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held, size = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that links reach from each place; links are pairs of places."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
