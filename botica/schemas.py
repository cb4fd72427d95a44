"""Table layouts and header mappings."""

from __future__ import annotations

from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MONEY = DecimalType(18, 2)
# A discount: an amount of cents in a gross of up to some 100 million keeps its value.
FRACTION = DecimalType(18, 10)

# The sales fact's columns, in their stored order.
SALES_SCHEMA = StructType(
    [
        StructField("cart_id", StringType(), False),
        StructField("transaction_id", StringType(), False),
        StructField("sale_datetime", TimestampType(), False),
        StructField("industry_name", StringType(), False),
        StructField("product_id", StringType(), False),
        StructField("product_name", StringType(), False),
        StructField("unit_price", MONEY, False),
        StructField("discount_applied", FRACTION, True),
        StructField("liquid_price", MONEY, False),
        StructField("taxes_price", MONEY, False),
        StructField("liquid_price_after_taxes", MONEY, False),
        StructField("quantity", IntegerType(), False),
        StructField("total_price", MONEY, False),
        StructField("total_price_after_taxes", MONEY, False),
    ]
)

# Dimension column <- price list header, in the dimension's order.
PRICE_LIST_HEADERS = {
    "industry_name": "LABORATÓRIO",
    "industry_cnpj": "CNPJ",
    "ggrem_code": "CÓDIGO GGREM",
    "registro": "REGISTRO",
    "ean1": "EAN 1",
    "ean2": "EAN 2",
    "ean3": "EAN 3",
    "substance_name": "SUBSTÂNCIA",
    "product_name": "PRODUTO",
    "product_presentation": "APRESENTAÇÃO",
    "terapy_class": "CLASSE TERAPÊUTICA",
    "product_type": "TIPO DE PRODUTO (STATUS DO PRODUTO)",
    "price_regime": "REGIME DE PREÇO",
    "unit_price": "PF Sem Impostos",
    "unit_price_after_taxes": "PF 12 %",
    "hospital_restriction": "RESTRIÇÃO HOSPITALAR",
    "cap": "CAP",
    "confaz87": "CONFAZ 87",
    "icms0": "ICMS 0%",
    "appeal_analysis": "ANÁLISE RECURSAL",
    "credit_concession": "LISTA DE CONCESSÃO DE CRÉDITO TRIBUTÁRIO (PIS/COFINS)",
    "stripe": "TARJA",
}

DIM_PRODUCT_COLUMNS = ["id", *PRICE_LIST_HEADERS]
DIM_PRODUCT_SCHEMA = StructType(
    [StructField(c, StringType(), c not in ("id", "product_name")) for c in DIM_PRODUCT_COLUMNS]
)

# The ERP extract's header, in file order.
ERP_SCHEMA = StructType(
    [
        StructField("transaction_id", StringType()),
        StructField("sale_datetime", TimestampType()),
        StructField("product_id", StringType()),
        StructField("product_name", StringType()),
        StructField("quantity", IntegerType()),
        StructField("unit_price", MONEY),
        StructField("total_price", MONEY),
        StructField("payment_method", StringType()),
        StructField("employee_id", StringType()),
        StructField("customer_id", StringType()),
        StructField("prescription_id", StringType()),
        StructField("is_prescription_item", BooleanType()),
        StructField("discount_applied", MONEY),
        StructField("loyalty_points_earned", IntegerType()),
        StructField("store_location_id", StringType()),
    ]
)

CORRUPT_COLUMN = "_corrupt_record"

# Saved carts, and how many of them a till has settled, as a stream keeps them.
CART_LINE_SCHEMA = StructType(
    [
        StructField("cart", LongType()),
        StructField("cart_seq", LongType()),
        StructField("product", LongType()),
        StructField("quantity", IntegerType()),
        StructField("save_event_id", LongType()),
        StructField("saved_at", TimestampType()),
    ]
)
CLOSED_CARTS_SCHEMA = StructType([StructField("cart", LongType()), StructField("closed", LongType())])

SEARCH_SCHEMA = StructType(
    [
        StructField("user_id", LongType()),
        StructField("ts", TimestampType()),
        StructField("event_id", LongType()),
        StructField("text", StringType()),
    ]
)

# Fixed value: the columns of Spark's source of whole files.
FILE_SCHEMA = StructType(
    [
        StructField("path", StringType()),
        StructField("modificationTime", TimestampType()),
        StructField("length", LongType()),
        StructField("content", BinaryType()),
    ]
)

CART_EVENT_SCHEMA = StructType(
    [
        StructField("event_id", LongType()),
        StructField("cart", LongType()),
        StructField("ts", TimestampType()),
        StructField("action", StringType()),
        StructField("product", LongType()),
        StructField("quantity", IntegerType()),
        StructField("text", StringType()),
    ]
)
