"""Sale lines: catalog data, discounts, taxes and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.functions.money import clamp_fraction, line_total, liquid_price
from botica.schemas import FRACTION, SALES_SCHEMA

SALES_COLUMNS = SALES_SCHEMA.fieldNames()


def price_lines(lines: DataFrame) -> DataFrame:
    """Adds the derived amounts to lines with a price, tax, discount fraction and quantity."""
    return (
        lines.withColumn("discount_applied", clamp_fraction(F.col("discount_applied")))
        .withColumn("liquid_price", liquid_price(F.col("unit_price"), F.col("discount_applied")))
        .withColumn(
            "liquid_price_after_taxes",
            (F.col("liquid_price") + F.col("taxes_price")).cast("decimal(18,2)"),
        )
        .withColumn("total_price", line_total(F.col("quantity"), F.col("liquid_price")))
        .withColumn(
            "total_price_after_taxes",
            line_total(F.col("quantity"), F.col("liquid_price_after_taxes")),
        )
    )


def _sellable(catalog: DataFrame) -> DataFrame:
    """Products with a price and a known tax: no other can be sold from the catalog."""
    return catalog.filter(F.col("unit_price").isNotNull() & F.col("taxes_price").isNotNull()).select(
        F.col("id").alias("product_id"), "industry_name", "product_name", "unit_price", "taxes_price"
    )


def enrich_lines(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Takes industry, name, price and tax of each line from the catalog.

    Lines of products that the catalog does not have, or whose price or tax it does not
    know, are left out; ``unmatched_lines`` lists them.
    """
    return price_lines(lines.join(_sellable(catalog), "product_id")).select(*SALES_COLUMNS)


def unmatched_lines(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """The lines that ``enrich_lines`` leaves out, as they came."""
    return lines.join(_sellable(catalog).select("product_id"), "product_id", "left_anti")


def with_sales_defaults(lines: DataFrame) -> DataFrame:
    """Fills what a line may leave out: product "0", no discount, no quantity."""
    return lines.withColumns(
        {
            "product_id": F.coalesce("product_id", F.lit("0")),
            "product_name": F.coalesce("product_name", F.lit("")),
            "discount_applied": F.coalesce("discount_applied", F.lit(0).cast(FRACTION)),
            "quantity": F.coalesce("quantity", F.lit(0)),
        }
    )
