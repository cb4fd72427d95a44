"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that stays together. A partial partition holds one sum per
shard; the two of largest spread are joined, one in falling and one in rising order,
until one is left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botica.llm.staging import numbered, ship_code, written


def differencing(sums: np.ndarray) -> np.ndarray:
    """Joins partial partitions (one a row, one shard a column) into a single one.

    Returns, for each row and column, the shard that the column's part goes to.
    """
    n, k = sums.shape
    held = {i: sums[i] for i in range(n)}
    heap = [(-int(spread), i) for i, spread in enumerate(np.ptp(sums, axis=1))]
    heapq.heapify(heap)
    joins = []
    while len(heap) > 1:
        first, second = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        falling = np.argsort(-held[first], kind="stable")
        rising = np.argsort(held[second], kind="stable")
        total = held.pop(first)[falling] + held.pop(second)[rising]
        node = n + len(joins)
        held[node] = total
        joins.append((first, falling, second, rising))
        heapq.heappush(heap, (-int(total.max() - total.min()), node))
    places = np.zeros((n + len(joins), k), dtype=np.int32)
    places[-1:] = np.arange(k)
    for node in range(n + len(joins) - 1, n - 1, -1):
        first, falling, second, rising = joins[node - n]
        places[first, falling] = places[node]
        places[second, rising] = places[node]
    return places[:n]


def balanced_groups(groups: DataFrame, shards: int, parts: int = 1000, buckets: int = 6144) -> DataFrame:
    """group, shard of a table group, bytes with one row per group.

    Groups smaller than a ``parts``-th of a shard are tied into bundles of that size
    first, within at most ``buckets`` hash buckets, so that the differencing, which is
    one task's work, has at most shards * parts * 2 + buckets parts, whatever the input.
    """
    ship_code(groups.sparkSession)
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    least = max(1, total // (shards * parts))
    buckets = min(buckets, max(1, n // 4096))
    bucket = F.pmod(F.xxhash64("group"), F.lit(buckets))
    before = Window.partitionBy("bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    small = groups.where(F.col("bytes") < least).withColumn("bucket", bucket)
    small = small.select("group", "bytes", "bucket", F.floor(so_far / least).alias("part"))
    large = groups.where(F.col("bytes") >= least).select(
        "group", "bytes", F.lit(-1).cast("long").alias("bucket"), F.xxhash64("group").alias("part")
    )
    parted = written(small.unionByName(large), "shard-parts")

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        # The order decides ties, so that reruns agree.
        pdf = pdf.sort_values(["bytes", "bucket", "part"], ascending=False)
        sums = np.zeros((len(pdf), shards), dtype=np.int64)
        sums[:, 0] = pdf["bytes"]
        return pdf[["bucket", "part"]].assign(shard=differencing(sums)[:, 0])

    items = parted.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    # Written, as every row of the input waits for it.
    placed = written(
        items.groupBy(F.lit(0).alias("all")).applyInPandas(
            lambda pdf: balance(pdf), "bucket long, part long, shard int"
        ),
        "shard-places",
    )
    return parted.join(placed, ["bucket", "part"]).select("group", "shard")


def byte_shards(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int = 1000,
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    A size is the text's UTF-8 bytes (null: none) plus 8. Equal texts, null and empty
    ones too, share a shard; otherwise the shards' bytes come as near as differencing
    brings them. Slots count from 0 in each shard without a gap. Null and repeated ids
    are rows like others; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = numbered(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    placed = written(rows.join(balanced_groups(groups, shards, parts), "group").drop("group"), "shard-placed")
    # Slots: rows are counted by written file first, then numbered within each.
    placed = placed.withColumn("file", F.shiftright("row", 40))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "file")
        .agg(F.count("*").alias("n"))
        .select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "file").orderBy("row")) - 1
    return (
        placed.withColumn("place", place)
        .join(starts, ["shard", "file"])
        .select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot"))
    )
