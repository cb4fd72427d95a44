"""Joining texts on "contains" with equi-joins.

A nested loop over all needle-haystack pairs costs their product. Here a needle
is looked up by one of its character groups (three characters, or the whole
needle where it is shorter): every haystack that contains the needle contains that
group too, so an equi-join finds all candidates and ``contains`` settles them.
The group chosen is the one fewest haystacks have, which keeps common groups
from producing needless candidates. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIZE = 3


def _groups(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - F.lit(size - 1))
    return F.when(
        F.length(text) >= size,
        F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))),
    )


def containment_pairs(needles: DataFrame, needle: str, haystacks: DataFrame, haystack: str) -> DataFrame:
    """Every row of ``haystacks`` with every needle that its text contains.

    Needles must be distinct and not empty.
    """
    by_size = F.array(
        *[F.coalesce(_groups(F.col(haystack), n), F.array().cast("array<string>")) for n in range(1, _SIZE + 1)]
    )
    own = F.coalesce(*[_groups(F.col(needle), n) for n in range(_SIZE, 0, -1)])
    wanted = needles.select(needle).withColumn("_group", F.explode(own))
    # Groups that no needle has are dropped before anything is counted or shuffled.
    hay = haystacks.withColumn("_group", F.explode(F.flatten(by_size)))
    hay = hay.join(wanted.select("_group").distinct(), "_group", "left_semi")

    frequency = hay.groupBy("_group").agg(F.count(F.lit(1)).alias("_count"))
    rarest = (
        wanted.join(frequency, "_group")
        .groupBy(needle)
        .agg(F.min(F.struct("_count", "_group")).alias("_pick"))
        .select(needle, F.col("_pick._group").alias("_group"))
    )
    return rarest.join(hay, "_group").filter(F.contains(F.col(haystack), F.col(needle))).drop("_group")
