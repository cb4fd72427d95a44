"""Running sums and look-ahead over groups too large for one task.

A window over a whole group puts the group into one task. Here the rows are dealt out
by ranges of (key, order), which Spark measures on the data, and stored once. A group
that fills several ranges is worked on range by range; only one row per range meets in a
task per group. Key columns must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botica.workspace import new_folder


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None) -> DataFrame:
    """The rows with ``_chunk``, the number of their range, as a stored table.

    Without ``pieces`` adaptive execution sizes the ranges.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(pieces, *by) if pieces else df.repartitionByRange(*by)
    folder = new_folder(df.sparkSession, "ranges")
    dealt.withColumn("_chunk", F.spark_partition_id()).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    inclusive: bool = True,
    pieces: int | None = None,
) -> DataFrame:
    """Adds the sum of ``value`` over the group's rows up to (or before) each row."""
    rows = in_ranges(df.withColumn("_value", value), keys, order, pieces)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.withColumn("_offset", F.sum("_total").over(earlier)).drop("_total")
    within = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    zero = F.lit(0)
    return (
        rows.withColumn("_within", F.sum("_value").over(within))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_within", zero) + F.coalesce("_offset", zero))
        .drop("_chunk", "_value", "_within", "_offset")
    )


def next_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    pieces: int | None = None,
) -> DataFrame:
    """Adds the group's next row's ``value`` (never NULL itself), or NULL on the last row."""
    rows = in_ranges(df, keys, order, pieces)
    head = F.struct(*order, F.col(value).alias("_first_value"))
    firsts = rows.groupBy(*keys, "_chunk").agg(F.min(head).alias("_head"))
    later = Window.partitionBy(*keys).orderBy("_chunk")
    following = firsts.select(
        *keys, "_chunk", F.lead("_head._first_value").over(later).alias("_following")
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        rows.withColumn("_within", F.lead(value).over(within))
        .join(following, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_within", "_following"))
        .drop("_chunk", "_within", "_following")
    )
