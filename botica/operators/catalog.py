"""Price list -> product dimension -> searchable catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botica.functions.keys import surrogate_key
from botica.functions.money import tax_amount
from botica.functions.numbers import parse_price, price_flag
from botica.functions.text import display_name, placeholder_to_null
from botica.schemas import DIM_PRODUCT_COLUMNS, PRICE_LIST_HEADERS

# Natural key of a product presentation in the price list.
NATURAL_KEY = ("ggrem_code",)

# The catalog's columns; the last three are computed.
CATALOG_COLUMNS = [
    "id",
    "substance_name",
    "industry_name",
    "ean1",
    "ean2",
    "ean3",
    "product_name",
    "product_presentation",
    "unit_price",
    "unit_price_after_taxes",
    "taxes_price",
    "price_flag",
]


def dim_product(
    price_list: DataFrame, key: Column | None = None, keep: dict[str, Column] | None = None
) -> DataFrame:
    """Renames the price list's headers and adds a key per row; ``keep`` adds more columns."""
    missing = [h for h in PRICE_LIST_HEADERS.values() if h not in price_list.columns]
    if missing:
        raise ValueError(f"price list lacks the headers {missing}")
    renamed = price_list.select(
        *[F.col(f"`{header}`").alias(name) for name, header in PRICE_LIST_HEADERS.items()],
        *[column.alias(name) for name, column in (keep or {}).items()],
    )
    if key is None:
        key = surrogate_key(*[F.col(c) for c in NATURAL_KEY])
    return renamed.withColumn("id", key).select(*DIM_PRODUCT_COLUMNS, *(keep or {}))


def catalog_view(dim: DataFrame) -> DataFrame:
    """Products with a display name, numeric prices and the tax between them."""
    return (
        dim.select(
            "id",
            "substance_name",
            "industry_name",
            *[placeholder_to_null(F.col(c)).alias(c) for c in ("ean1", "ean2", "ean3")],
            display_name(F.col("product_name"), F.col("product_presentation")).alias("product_name"),
            "product_presentation",
            parse_price(F.col("unit_price")).alias("unit_price"),
            parse_price(F.col("unit_price_after_taxes")).alias("unit_price_after_taxes"),
            price_flag(F.col("unit_price_after_taxes")).alias("price_flag"),
        )
        .filter(F.col("product_name").isNotNull())
        .withColumn("taxes_price", tax_amount(F.col("unit_price_after_taxes"), F.col("unit_price")))
        .select(*CATALOG_COLUMNS)
    )
