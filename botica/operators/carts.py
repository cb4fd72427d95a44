"""Cart totals, edits, and the folding of cart events into saved carts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botica.operators.ordered import running_sum
from botica.operators.pricing import price_lines

SET_QUANTITY, DELETE, SAVE, SEARCH = "set_qty", "delete", "save", "search"
CART_ACTIONS = (SET_QUANTITY, DELETE, SAVE)


def cart_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("cart_id").agg(
        F.sum("total_price_after_taxes").alias("cart_total"),
        F.count(F.lit(1)).alias("line_count"),
    )


def cart_running_total(lines: DataFrame, pieces: int | None = None) -> DataFrame:
    """The cart's total after each line, in the order of ``line_seq``."""
    return running_sum(
        lines,
        ["cart_id"],
        ["line_seq", "transaction_id", "quantity", "total_price_after_taxes"],
        F.col("total_price_after_taxes"),
        "running_total",
        pieces=pieces,
    )


def cart_what_if(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """What each cart would cost with one candidate line added; unknown carts start at 0.

    Only carts that have a candidate are summed.
    """
    totals = cart_totals(lines.join(candidates.select("cart_id"), "cart_id", "left_semi")).select("cart_id", F.col("cart_total").alias("committed_total"))
    return (
        price_lines(candidates)
        .join(totals, "cart_id", "left")
        .withColumn("committed_total", F.coalesce("committed_total", F.lit(0).cast("decimal(28,2)")))
        .withColumn("what_if_total", F.col("committed_total") + F.col("total_price_after_taxes"))
    )


def delete_lines(lines: DataFrame, deletions: DataFrame) -> DataFrame:
    """Lines whose (cart_id, transaction_id) is not among the deletions."""
    keys = ["cart_id", "transaction_id"]
    return lines.join(deletions.select(*keys), keys, "left_anti")


def number_carts(events: DataFrame, pieces: int | None = None) -> DataFrame:
    """Adds ``cart_seq``, the number of saves of the same till before each event."""
    return running_sum(
        events.filter(F.col("action").isin(*CART_ACTIONS)),
        ["cart"],
        ["ts", "event_id"],
        F.when(F.col("action") == SAVE, 1).otherwise(0),
        "cart_seq",
        inclusive=False,
        pieces=pieces,
    )


def close_carts(numbered: DataFrame, counts: Column | None = None) -> DataFrame:
    """Last quantity per product of the carts that a save closes.

    Products whose last action is a deletion or a quantity of 0 are not in the cart.
    ``counts`` restricts the saves that close a cart. A cart's events shrink to one row per
    product before its save meets them.
    """
    is_save = F.col("action") == SAVE
    last = F.max(F.struct("ts", "event_id", "action", "quantity")).alias("last")
    per_product = numbered.groupBy(
        "cart", "cart_seq", is_save.alias("is_save"), F.when(~is_save, F.col("product")).alias("product")
    ).agg(last)
    closing = F.col("is_save")
    if counts is not None:
        closing = closing & counts
    stamp = F.struct("last.event_id", "last.ts")
    cart = Window.partitionBy("cart", "cart_seq")
    return (
        per_product.withColumn("ts", F.col("last.ts"))
        .withColumn("save", F.max(F.when(closing, stamp)).over(cart))
        .filter(F.col("save").isNotNull() & (F.col("last.action") == SET_QUANTITY))
        .filter(F.col("last.quantity") > 0)
        .select(
            "cart",
            "cart_seq",
            "product",
            F.col("last.quantity").alias("quantity"),
            F.col("save.event_id").alias("save_event_id"),
            F.col("save.ts").alias("saved_at"),
        )
    )


def saved_carts(events: DataFrame, pieces: int | None = None) -> DataFrame:
    """Lines of every saved cart; what is set after the last save is still open."""
    return close_carts(number_carts(events, pieces))
