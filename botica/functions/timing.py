from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from botica.functions.text import trimmed

# Fixed value: how dates and times are typed and exported.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
# The format has no year 0.
_ALL_DIGITS = r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def timestamp_of(text: Column) -> Column:
    """The time in a trimmed text.

    Most times have all their digits; Spark's cast reads those as the format does, and much faster.
    """
    slow = F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT))
    return F.when(F.rlike(text, F.lit(_ALL_DIGITS)), text.try_cast("timestamp")).otherwise(slow)


def parse_timestamp(column: Column) -> Column:
    return timestamp_of(trimmed(column))


def day_start(column: Column) -> Column:
    return F.date_trunc("day", column)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def sale_stamp(column: Column | None = None) -> Column:
    """The given time, or the time of the job where none is given."""
    return F.current_timestamp() if column is None else F.coalesce(column, F.current_timestamp())
