from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from botica.sources.tables import read_table
from botica.workspace import new_folder, scratch


def staged_batches(
    spark: SparkSession, work: Callable[[DataFrame, int], None], fmt: str
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands ``work`` each batch as a stored table.

    A batch is computed anew each time it is read; work that joins or reads it twice is
    better done on a written copy, in the caller's session, where skewed joins are split.
    The copy, and what the work itself stores in scratch folders, goes at its end.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            path = new_folder(spark, "batch")
            batch.write.format(fmt).save(path)
            work(read_table(spark, path, fmt), batch_id)

    return process
