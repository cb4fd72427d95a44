"""Saved carts on a stream of cart events.

``committed`` has the lines of carts whose save is settled, ``pending`` the events that
are not, ``late`` those that came too late, and ``closed`` how many carts each till has
settled, which keeps the carts' numbers going.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from botica.operators.carts import CART_ACTIONS, SAVE, close_carts, number_carts
from botica.schemas import CART_EVENT_SCHEMA, CART_LINE_SCHEMA, CLOSED_CARTS_SCHEMA
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

EVENT_COLUMNS = CART_EVENT_SCHEMA.fieldNames()
LINE_COLUMNS = CART_LINE_SCHEMA.fieldNames()
COMMITTED, CLOSED = "committed", "closed"


def _numbered(events: DataFrame, closed: DataFrame) -> DataFrame:
    """Cart events with ``cart_seq``, counted from the carts a till has settled before."""
    known = number_carts(events).join(closed, "cart", "left")
    seq = F.col("cart_seq") + F.coalesce("closed", F.lit(0))
    return known.withColumn("cart_seq", seq.cast("long")).withColumn("closed", F.coalesce("closed", F.lit(0)))


def settle_carts(spark: SparkSession, state: str, fmt: str):
    def settle(events: DataFrame, horizon: Column, before: int | None) -> dict[str, DataFrame]:
        closed = of_batch(spark, state, CLOSED, before, fmt, CLOSED_CARTS_SCHEMA)
        numbered = _numbered(events, closed)
        past = F.col("ts") <= horizon
        saves = numbered.filter((F.col("action") == SAVE) & past)
        settled = saves.groupBy("cart").agg(F.count(F.lit(1)).alias("_more"))
        totals = (
            closed.join(settled, "cart", "full")
            .withColumn("closed", F.coalesce("closed", F.lit(0)) + F.coalesce("_more", F.lit(0)))
            .select("cart", "closed")
        )
        waiting = (
            numbered.join(settled, "cart", "left")
            .filter(F.col("cart_seq") >= F.col("closed") + F.coalesce("_more", F.lit(0)))
            .select(*EVENT_COLUMNS)
        )
        lines = close_carts(numbered, past).select(*LINE_COLUMNS)
        return {COMMITTED: lines, CLOSED: totals, PENDING: waiting}

    return settle


def stream_saved_carts(
    events: DataFrame, state: str, checkpoint: str, delay: str = "1 hour", fmt: str = DEFAULT_FORMAT
) -> StreamingQuery:
    """Keeps the state tables up to date; an event that is delivered again counts nowhere."""
    spark = events.sparkSession
    wanted = events.select(*EVENT_COLUMNS).filter(F.col("action").isin(*CART_ACTIONS))

    def work(batch: DataFrame, batch_id: int) -> None:
        settle_batch(batch, batch_id, state, delay, settle_carts(spark, state, fmt), fmt)

    return (
        without_repeats(wanted)
        .writeStream.foreachBatch(staged_batches(spark, work, fmt))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_carts(spark: SparkSession, state: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    """Committed lines and those of saved carts that may still change."""
    newest = newest_batch(spark, state)
    waiting = of_batch(spark, state, PENDING, newest, fmt, CART_EVENT_SCHEMA)
    closed = of_batch(spark, state, CLOSED, newest, fmt, CLOSED_CARTS_SCHEMA)
    recent = close_carts(_numbered(waiting, closed)).select(*LINE_COLUMNS)
    return of_all_batches(spark, state, COMMITTED, fmt, CART_LINE_SCHEMA).unionByName(recent)


def late_events(spark: SparkSession, state: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    """Events that arrived after their time had been settled."""
    return of_all_batches(spark, state, LATE, fmt, CART_EVENT_SCHEMA)
