"""Scans, projections, scalar functions and the product dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botica.functions.keys import surrogate_key
from botica.functions.money import display_total, format_money, clamp_fraction, percent_to_fraction
from botica.functions.numbers import int_or_default, decimal_or_default, parse_price, price_flag
from botica.functions.text import blank_to_null, display_name, is_blank, placeholder_to_null
from botica.functions.timing import day_start, from_epoch
from botica.operators.catalog import dim_product
from botica.operators.reports import preview
from botica.plans import bindings as b
from botica.plans.bindings import plain


def concat_null_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return b.dimension(spark, sf).select(
        "id", display_name(F.col("product_name"), F.col("product_presentation")).alias("display_name")
    )


def parse_price_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("unit_price_after_taxes")
    return plain(
        b.dimension(spark, sf).select(
            "id", raw.alias("raw_price"), parse_price(raw).alias("price"), price_flag(raw).alias("flagged")
        )
    )


def taxes_price(spark: SparkSession, sf: str) -> DataFrame:
    return plain(
        b.catalog(spark, sf).select("id", "unit_price", "unit_price_after_taxes", "taxes_price")
    )


def project_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return plain(b.catalog(spark, sf))


def dim_product_rename(spark: SparkSession, sf: str) -> DataFrame:
    return dim_product(b.price_list(spark, sf))


def surrogate_keys(spark: SparkSession, sf: str) -> DataFrame:
    dim = b.dimension(spark, sf)
    return dim.select(
        "ggrem_code",
        surrogate_key(F.col("ggrem_code")).alias("code_key"),
        surrogate_key(F.col("industry_name"), F.col("product_name"), F.col("product_presentation")).alias(
            "name_key"
        ),
    )


def format_money_br(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,4)") * (
        F.lit(1) - F.col("l_discount").cast("decimal(9,4)")
    )
    return b.line_table(spark, sf).select(
        b.transaction_key().alias("transaction_id"), format_money(price).alias("price_text")
    )


def default_blank_numbers(spark: SparkSession, sf: str) -> DataFrame:
    quantity, discount = F.col("quantity"), F.col("discount_applied")
    return plain(
        b.typed_lines(spark, sf).select(
            "transaction_id",
            int_or_default(quantity).alias("quantity"),
            decimal_or_default(discount).alias("discount_percent"),
            (~is_blank(quantity) & int_or_default(quantity).isNull()).alias("bad_quantity"),
        )
    )


def blank_to_null_fields(spark: SparkSession, sf: str) -> DataFrame:
    return b.typed_lines(spark, sf).select(
        "transaction_id",
        blank_to_null(F.col("product_name")).alias("product_name"),
        blank_to_null(F.col("discount_applied")).alias("discount_text"),
    )


def placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return b.dimension(spark, sf).select(
        "id",
        placeholder_to_null(F.col("ean2")).alias("ean2"),
        placeholder_to_null(F.col("ean3")).alias("ean3"),
        placeholder_to_null(F.col("stripe")).alias("stripe"),
    )


def clamp_discount(spark: SparkSession, sf: str) -> DataFrame:
    percent = decimal_or_default(F.col("discount_applied"))
    return plain(
        b.typed_lines(spark, sf).select(
            "transaction_id", clamp_fraction(percent_to_fraction(percent)).alias("discount")
        )
    )


def display_totals(spark: SparkSession, sf: str) -> DataFrame:
    price = parse_price(F.col("unit_price"))
    quantity = int_or_default(F.col("quantity"))
    return plain(
        b.typed_lines(spark, sf).select("transaction_id", display_total(quantity, price).alias("shown_total"))
    )


def daily_trunc(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return plain(
        b.table(spark, sf, "events").select(
            "event_id",
            day_start(ts).alias("day_start"),
            from_epoch(F.unix_seconds(ts)).alias("whole_second"),
        )
    )


def preview_dim_product(spark: SparkSession, sf: str) -> DataFrame:
    return preview(b.dimension(spark, sf), "product_name", "id")


QUERIES = {
    "preview_dim_product": preview_dim_product,
    "concat_null_propagation": concat_null_propagation,
    "parse_price": parse_price_text,
    "taxes_price": taxes_price,
    "project_catalog": project_catalog,
    "dim_product_rename": dim_product_rename,
    "surrogate_key": surrogate_keys,
    "format_money_br": format_money_br,
    "default_blank_numbers": default_blank_numbers,
    "blank_to_null": blank_to_null_fields,
    "placeholder_to_null": placeholders,
    "clamp_discount": clamp_discount,
    "display_total": display_totals,
    "daily_trunc": daily_trunc,
}

_INTEGER_TEXT = r"'^\s*[+-]?[0-9]+\s*$'"
_DECIMAL_TEXT = r"'^\s*[+-]?[0-9]+([.,][0-9]+)?\s*$'"



def _part_sql(column: str) -> str:
    """A key's part with its length."""
    return f"coalesce(length({column}) || ':' || {column}, '-')"


def dim_select(source: str) -> str:
    return f"{DIM_SELECT} (SELECT * REPLACE (sha256({_part_sql('ggrem_code')}) AS id) FROM {source})"


DIM_SELECT = """
SELECT id, industry_name, industry_cnpj, ggrem_code, registro, ean1, ean2, ean3, substance_name, product_name,
       product_presentation, terapy_class, product_type, price_regime, unit_price, unit_price_after_taxes,
       hospital_restriction, cap, confaz87, icms0, appeal_analysis, credit_concession, stripe
FROM """

CATALOG_SELECT = """
SELECT id, substance_name, industry_name, ean1, ean2, ean3, product_name, product_presentation,
       CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(unit_price_after_taxes AS DOUBLE) AS unit_price_after_taxes,
       CAST(taxes_price AS DOUBLE) AS taxes_price, price_flag
FROM """

ORACLE = {
    "preview_dim_product": f"""WITH {b.PRICE_LIST_SQL}
{DIM_SELECT} price_list ORDER BY product_name, id LIMIT 20""",
    "concat_null_propagation": f"""WITH {b.PRICE_LIST_SQL}
SELECT id, product_name || ' ' || product_presentation AS display_name FROM price_list""",
    "parse_price": f"""WITH {b.PRICE_LIST_SQL}
SELECT id, unit_price_after_taxes AS raw_price,
       CAST(CASE WHEN unit_price_after_taxes LIKE '%-%' THEN NULL
            ELSE TRY_CAST(replace(rtrim(trim(unit_price_after_taxes), '*'), ',', '.') AS DECIMAL(18,2)) END
            AS DOUBLE) AS price,
       unit_price_after_taxes LIKE '%*' AS flagged
FROM price_list""",
    "taxes_price": f"""WITH {b.CATALOG_SQL}
SELECT id, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(unit_price_after_taxes AS DOUBLE) AS unit_price_after_taxes,
       CAST(taxes_price AS DOUBLE) AS taxes_price FROM catalog""",
    "project_catalog": f"WITH {b.CATALOG_SQL} {CATALOG_SELECT} catalog",
    "dim_product_rename": f"""WITH {b.PRICE_LIST_SQL}
{dim_select("price_list")}""",
    "surrogate_key": f"""WITH {b.PRICE_LIST_SQL}
SELECT ggrem_code, sha256({_part_sql("ggrem_code")}) AS code_key,
       sha256({_part_sql("industry_name")} || '|' || {_part_sql("product_name")} || '|'
              || {_part_sql("product_presentation")}) AS name_key
FROM price_list""",
    "format_money_br": """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id,
       replace(CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(9,4))), 2)
               AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS price_text
FROM lineitem""",
    "default_blank_numbers": f"""WITH {b.TYPED_SQL}
SELECT transaction_id,
       CASE WHEN trim(quantity) = '' THEN 0
            WHEN regexp_matches(quantity, {_INTEGER_TEXT}) THEN TRY_CAST(trim(quantity) AS INTEGER) END AS quantity,
       CAST(CASE WHEN trim(discount_applied) = '' THEN 0
            WHEN regexp_matches(discount_applied, {_DECIMAL_TEXT})
            THEN TRY_CAST(replace(trim(discount_applied), ',', '.') AS DECIMAL(18,4)) END AS DOUBLE) AS discount_percent,
       trim(quantity) <> '' AND NOT regexp_matches(quantity, {_INTEGER_TEXT}) AS bad_quantity
FROM typed_lines""",
    "blank_to_null": f"""WITH {b.TYPED_SQL}
SELECT transaction_id, nullif({b.trimmed_sql('product_name')}, '') AS product_name,
       nullif(trim(discount_applied), '') AS discount_text
FROM typed_lines""",
    "placeholder_to_null": f"""WITH {b.PRICE_LIST_SQL}
SELECT id, nullif(trim(ean2), '-') AS ean2, nullif(trim(ean3), '-') AS ean3, nullif(trim(stripe), '-') AS stripe
FROM price_list""",
    "clamp_discount": f"""WITH {b.TYPED_SQL}
SELECT transaction_id,
       CASE WHEN trim(discount_applied) = '' THEN 0.0::DOUBLE
            WHEN regexp_matches(discount_applied, {_DECIMAL_TEXT})
            THEN CAST(greatest(0, least(1, CAST(TRY_CAST(trim(discount_applied) AS DECIMAL(18,2)) / 100
                      AS DECIMAL(18,10)))) AS DOUBLE) END AS discount
FROM typed_lines""",
    "display_total": f"""WITH {b.TYPED_SQL}, amounts AS (
SELECT transaction_id,
       TRY_CAST(replace(unit_price, ',', '.') AS DECIMAL(18,2)) AS price,
       CASE WHEN trim(quantity) = '' THEN 0 ELSE TRY_CAST(trim(quantity) AS INTEGER) END AS quantity
FROM typed_lines)
SELECT transaction_id, CAST(CASE WHEN quantity * price > 0 THEN quantity * price ELSE price END AS DOUBLE) AS shown_total
FROM amounts""",
    "daily_trunc": """
SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_start,
       CAST(date_trunc('second', ts) AS TIMESTAMP) AS whole_second FROM events""",
}
