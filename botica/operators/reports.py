from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: rows a preview shows.
PREVIEW_ROWS = 20


def newest_first(sales: DataFrame) -> DataFrame:
    """Newest sales first, those without a time last; all other columns break ties."""
    first = ["transaction_id", "quantity", "total_price_after_taxes"]
    rest = [c for c in sales.columns if c not in ("sale_datetime", *first)]
    own = [c for c in first if c in sales.columns]
    return sales.orderBy(F.desc_nulls_last("sale_datetime"), *own, *rest)


def newest(sales: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return newest_first(sales).limit(rows)


def preview(table: DataFrame, *order: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """A table's first rows; with an order that has no ties they are always the same."""
    return table.orderBy(*order).limit(rows)
