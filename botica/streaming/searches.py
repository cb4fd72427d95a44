"""Debounced searches on a stream: closed bursts are stored, open ones wait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from botica.operators.searches import DEFAULT_GAP, debounce_searches
from botica.schemas import SEARCH_SCHEMA
from botica.sources.tables import DEFAULT_FORMAT
from botica.streaming.settling import (
    LATE,
    PENDING,
    newest_batch,
    of_all_batches,
    of_batch,
    settle_batch,
    without_repeats,
)
from botica.streaming.staging import staged_batches

SEARCH_COLUMNS = SEARCH_SCHEMA.fieldNames()
CLOSED = "closed"


def stream_debounced(
    searches: DataFrame,
    state: str,
    checkpoint: str,
    gap: str = DEFAULT_GAP,
    delay: str = "1 minute",
    fmt: str = DEFAULT_FORMAT,
) -> StreamingQuery:
    """Stores each search that no other of its user follows within ``gap``.

    A search waits until the gap after it is settled; then it is stored, or forgotten
    where another one followed. So only a delay and a gap of searches wait.
    """
    spark = searches.sparkSession

    def settle(events: DataFrame, horizon: Column, before: int | None) -> dict[str, DataFrame]:
        settled = F.col("ts") <= horizon - F.expr(f"interval {gap}")
        found = debounce_searches(events, gap).filter(settled)
        return {CLOSED: found.select(*SEARCH_COLUMNS), PENDING: events.filter(~settled)}

    def work(batch: DataFrame, batch_id: int) -> None:
        settle_batch(batch, batch_id, state, delay, settle, fmt)

    return (
        without_repeats(searches.select(*SEARCH_COLUMNS))
        .writeStream.foreachBatch(staged_batches(spark, work, fmt))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_searches(
    spark: SparkSession, state: str, gap: str = DEFAULT_GAP, fmt: str = DEFAULT_FORMAT
) -> DataFrame:
    """Stored searches, and those waiting that nothing has followed so far."""
    waiting = of_batch(spark, state, PENDING, newest_batch(spark, state), fmt, SEARCH_SCHEMA)
    recent = debounce_searches(waiting, gap).select(*SEARCH_COLUMNS)
    return of_all_batches(spark, state, CLOSED, fmt, SEARCH_SCHEMA).unionByName(recent)


def late_searches(spark: SparkSession, state: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    return of_all_batches(spark, state, LATE, fmt, SEARCH_SCHEMA)
