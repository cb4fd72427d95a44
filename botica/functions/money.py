"""Decimal amounts: unit amounts are rounded once (half up), totals are exact products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from botica.schemas import FRACTION


def money(column: Column) -> Column:
    return F.round(column, 2).cast("decimal(18,2)")


def format_money(column: Column) -> Column:
    """Two decimals and a decimal comma, no thousands separator."""
    return F.translate(money(column).cast("string"), ".", ",")


def to_fraction(part: Column, whole: Column) -> Column:
    return F.round(part / whole, FRACTION.scale).cast(FRACTION)


def percent_to_fraction(column: Column) -> Column:
    return to_fraction(column, F.lit(100))


def clamp_fraction(column: Column) -> Column:
    """Limits a discount to 0..1; NULL stays NULL."""
    zero, one = F.lit(0).cast(FRACTION), F.lit(1).cast(FRACTION)
    return F.when(column.isNotNull(), F.greatest(zero, F.least(one, column))).cast(FRACTION)


def tax_amount(after_taxes: Column, price: Column) -> Column:
    return (after_taxes - price).cast("decimal(18,2)")


def liquid_price(unit_price: Column, discount: Column) -> Column:
    return money(unit_price * (F.lit(1) - F.coalesce(discount, F.lit(0).cast(FRACTION))))


def line_total(quantity: Column, unit_amount: Column) -> Column:
    return (quantity * unit_amount).cast("decimal(18,2)")


def display_total(quantity: Column, unit_amount: Column) -> Column:
    """The line total, or the unit amount while nothing has been ordered."""
    total = line_total(quantity, unit_amount)
    return F.when(total > 0, total).otherwise(unit_amount)
