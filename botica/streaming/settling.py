"""Streams whose results can still change: what is settled is stored, the rest waits.

A batch takes the events that the batch before left waiting, adds its own, and settles
what lies a delay behind the newest event. So its cost follows the open events and not
the history, and no state is held by the stream. All tables of a batch are written
first; an empty file named after the batch then publishes them at once. Readers look at
published batches only, and a batch that is delivered again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from botica.sinks.files import create_file, drop_folder, numbered_folders
from botica.sources.tables import read_table, table_exists
from botica.workspace import new_folder

PENDING, LATE, PUBLISHED = "pending", "late", "published"
# How long after its arrival an event that comes again is known to be a repeated one.
REMEMBERED = "7 days"

# (all open events, the settled time, the batch before) -> tables; "pending" is one of them.
Settle = Callable[[DataFrame, Column, int | None], dict[str, DataFrame]]


def newest_batch(spark: SparkSession, state: str, before: int | None = None) -> int | None:
    """The newest published batch, or the newest one before a given batch."""
    known = [n for n in numbered_folders(spark, f"{state}/{PUBLISHED}") if before is None or n < before]
    return known[-1] if known else None


def of_batch(
    spark: SparkSession, state: str, name: str, batch: int | None, fmt: str, schema: StructType
) -> DataFrame:
    """One table of one batch; without a batch it has no rows."""
    if batch is None:
        return spark.createDataFrame([], schema)
    return read_table(spark, f"{state}/{name}/batch_id={batch}", fmt, schema)


def of_all_batches(spark: SparkSession, state: str, name: str, fmt: str, schema: StructType) -> DataFrame:
    """One table of all published batches together."""
    newest = newest_batch(spark, state)
    if newest is None or not table_exists(spark, f"{state}/{name}", fmt):
        return spark.createDataFrame([], schema)
    layout = StructType([*schema.fields]).add("batch_id", "long")
    stored = read_table(spark, f"{state}/{name}", fmt, layout)
    return stored.filter(F.col("batch_id") <= newest).drop("batch_id")


def without_repeats(events: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """A stream's events less those whose ``event_id`` arrived within the time before.

    What is remembered follows when events arrive and not their own times, so that an
    event is never dropped for being late. State falls as soon as it is too old.
    """
    arrived = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remembered)
    return arrived.dropDuplicatesWithinWatermark(["event_id"]).drop("_arrived")


def settle_batch(
    batch: DataFrame, batch_id: int, state: str, delay: str, settle: Settle, fmt: str
) -> None:
    """Settles one batch of events with an ``event_id`` and a time ``ts``.

    An event counts once while it is open. One that arrives when its time has been settled
    goes to the table of late events; ``without_repeats`` keeps repeated ones out of it.
    """
    spark, schema = batch.sparkSession, batch.schema
    before = newest_batch(spark, state, batch_id)
    waiting = of_batch(spark, state, PENDING, before, fmt, schema)
    fresh = batch.dropDuplicates(["event_id"]).join(waiting.select("event_id"), "event_id", "left_anti")
    fresh = fresh.select(*schema.fieldNames())
    if fresh.isEmpty():
        return
    # The newest event always waits, so the next batch finds the same time again.
    reached = F.unix_micros(F.max("ts") - F.expr(f"interval {delay}")).alias("at")
    passed = waiting.agg(reached).first()["at"]
    is_late = F.lit(False) if passed is None else F.unix_micros("ts") <= passed
    folder = new_folder(spark, "open-events")
    waiting.unionByName(fresh.filter(~is_late)).write.format(fmt).save(folder)
    events = read_table(spark, folder, fmt)
    horizon = F.timestamp_micros(F.lit(events.agg(reached).first()["at"]))

    own = f"batch_id={batch_id}"
    tables = settle(events, horizon, before) | {LATE: fresh.filter(is_late)}
    for name, table in tables.items():
        table.write.format(fmt).mode("overwrite").save(f"{state}/{name}/{own}")
    create_file(spark, f"{state}/{PUBLISHED}/{batch_id}")
    # Waiting events of older batches: only the batch before may be asked for again.
    for old in numbered_folders(spark, f"{state}/{PENDING}", "batch_id="):
        if before is not None and old < before:
            drop_folder(spark, f"{state}/{PENDING}/batch_id={old}")
