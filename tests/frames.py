"""Small hand-made tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from botica.schemas import CART_EVENT_SCHEMA, DIM_PRODUCT_SCHEMA

START = datetime(2024, 5, 1, 8, 0, 0)


def products(spark, rows):
    """Dimension rows from (id, substance, name, presentation, price, price after taxes)."""
    names = DIM_PRODUCT_SCHEMA.fieldNames()
    out = []
    for id_, substance, name, presentation, price, after in rows:
        row = dict.fromkeys(names, "x") | {
            "id": id_,
            "substance_name": substance,
            "product_name": name,
            "product_presentation": presentation,
            "unit_price": price,
            "unit_price_after_taxes": after,
            "ean2": "    -     ",
            "ean3": "",
        }
        out.append(tuple(row[n] for n in names))
    return spark.createDataFrame(out, DIM_PRODUCT_SCHEMA)


def at(seconds):
    return START + timedelta(seconds=seconds)


def events(spark, rows):
    """Cart events from (event_id, cart, seconds, action, product, quantity)."""
    return spark.createDataFrame(
        [(e, c, at(s), a, p, q, None) for e, c, s, a, p, q in rows], CART_EVENT_SCHEMA
    )


def money(text):
    return Decimal(text)
