"""Debounced searches: typing on cancels the search that was waiting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.operators.ordered import next_value

# Fixed value: how long the search box waits for further typing.
DEFAULT_GAP = "3 seconds"


def debounce_searches(
    searches: DataFrame, gap: str = DEFAULT_GAP, pieces: int | None = None
) -> DataFrame:
    """Searches not followed by another one of the same user within ``gap``."""
    ahead = next_value(searches, ["user_id"], ["ts", "event_id"], "ts", "_next_ts", pieces)
    waited = F.col("_next_ts") >= F.col("ts") + F.expr(f"interval {gap}")
    return ahead.filter(F.col("_next_ts").isNull() | waited).drop("_next_ts")
