"""Text to numbers. Unparsable text gives NULL, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from botica.functions.text import is_blank, trimmed

# Digits with an optional decimal comma or point, and an optional trailing star.
_PRICE = r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*\*?\s*$"


def _point(column: Column) -> Column:
    return F.translate(column, ",", ".")


def parse_price(column: Column) -> Column:
    return _point(F.regexp_extract(column, _PRICE, 1)).try_cast("decimal(18,2)")


def price_flag(column: Column) -> Column:
    """True where the price carries the star mark."""
    return F.coalesce(trimmed(column).endswith("*"), F.lit(False))


def int_of(text: Column) -> Column:
    """The number in a trimmed text."""
    return text.try_cast("int")


def decimal_of(text: Column, scale: int = 4) -> Column:
    """The number in a trimmed text, with a decimal comma or point."""
    return _point(text).try_cast(f"decimal(18,{scale})")


def parse_int(column: Column) -> Column:
    return int_of(trimmed(column))


def parse_decimal(column: Column, scale: int = 4) -> Column:
    return decimal_of(trimmed(column), scale)


def int_or_default(column: Column, default: int = 0) -> Column:
    """Blank text gives the default; text that is no number stays NULL."""
    return F.when(is_blank(column), F.lit(default)).otherwise(parse_int(column))


def decimal_or_default(column: Column, default: str = "0", scale: int = 4) -> Column:
    fallback = F.lit(default).cast(f"decimal(18,{scale})")
    return F.when(is_blank(column), fallback).otherwise(parse_decimal(column, scale))
