"""Daily refresh of the product dimension."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botica.functions.text import is_blank
from botica.operators.catalog import NATURAL_KEY, dim_product
from botica.operators.quality import enforce_schema
from botica.schemas import CORRUPT_COLUMN, DIM_PRODUCT_SCHEMA, PRICE_LIST_HEADERS
from botica.sinks.files import newest_file
from botica.sinks.tables import overwrite_table
from botica.sources.files import read_checked_semicolon_csv
from botica.sources.tables import DEFAULT_FORMAT, read_table, table_exists
from botica.workspace import new_folder, scratch


def is_stale(spark: SparkSession, path: str, as_of: datetime, fmt: str = DEFAULT_FORMAT) -> bool:
    """Whether the table is missing, or was last written before the day of ``as_of`` began."""
    if not table_exists(spark, path, fmt):
        return True
    return newest_file(spark, path) < as_of.replace(hour=0, minute=0, second=0, microsecond=0)


def check_price_list(price_list: DataFrame) -> DataFrame:
    """The dimension's columns and ``error``: why a line cannot be a product, if it can't."""
    required = [PRICE_LIST_HEADERS[c] for c in (*NATURAL_KEY, "product_name")]
    error = F.when(F.col(CORRUPT_COLUMN).isNotNull(), "the line does not fit the header")
    for header in required:
        error = error.when(is_blank(F.col(f"`{header}`")), f"{header} is required")
    return dim_product(price_list, keep={"error": error, "line": F.col(CORRUPT_COLUMN)})


def refresh_dimension(
    spark: SparkSession,
    price_file: str,
    path: str,
    fmt: str = DEFAULT_FORMAT,
    rejected_path: str | None = None,
    replace: Callable[[DataFrame, str, str], object] = overwrite_table,
) -> None:
    """Replaces the dimension by the landed file's products.

    With ``replace=publish_version`` (``sinks/snapshots.py``) they become the next version of
    a dimension that others go on reading meanwhile.
    Lines that do not fit the header or lack the natural key or the name are left out and,
    with ``rejected_path``, stored there. A file without any product, or with two of one id,
    leaves the dimension as it is and raises ``ValueError``.
    """
    with scratch(spark):
        folder = new_folder(spark, "price-list")
        check_price_list(read_checked_semicolon_csv(spark, price_file)).write.format(fmt).save(folder)
        checked = read_table(spark, folder, fmt)
        good = checked.filter(F.col("error").isNull()).drop("error", "line")
        if good.isEmpty():
            raise ValueError(f"{price_file} has no product")
        repeated = good.groupBy("id").count().filter("count > 1")
        if not repeated.isEmpty():
            raise ValueError(f"{price_file} has several products of one id")
        if rejected_path is not None:
            bad = checked.filter(F.col("error").isNotNull())
            bad.write.format(fmt).mode("overwrite").save(rejected_path)
        replace(enforce_schema(good, DIM_PRODUCT_SCHEMA), path, fmt)


def refresh_if_stale(
    spark: SparkSession,
    price_file: str,
    path: str,
    as_of: datetime | None = None,
    fmt: str = DEFAULT_FORMAT,
) -> bool:
    """Refreshes a missing or outdated dimension from the landed file; tells whether it did."""
    if not is_stale(spark, path, as_of or datetime.now(), fmt):
        return False
    refresh_dimension(spark, price_file, path, fmt)
    return True
