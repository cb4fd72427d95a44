from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(*natural: Column) -> Column:
    """The same row always gets the same key, in every run and on every executor.

    Each part is written with its length, a missing one as a dash, so that different
    parts never make the same text.
    """
    parts = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in natural
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def line_uuid() -> Column:
    """A random id per row; write the rows before using it in two places."""
    return F.uuid()
