"""Validation, pricing, carts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botica.operators import carts as c
from botica.operators import pricing as p
from botica.operators import quality as q
from botica.operators import reports
from botica.operators.search import search_batch
from botica.operators.searches import debounce_searches as debounce
from botica.plans import bindings as b
from botica.plans.bindings import plain
from botica.plans.search_queries import PICK_SQL
from botica.schemas import SALES_SCHEMA
from botica.workspace import new_folder

DEBOUNCE_GAP = "600 seconds"


def priced_lines(spark: SparkSession, sf: str) -> DataFrame:
    return p.price_lines(b.sale_lines(spark, sf))


def price_lines(spark: SparkSession, sf: str) -> DataFrame:
    return plain(priced_lines(spark, sf).select(*p.SALES_COLUMNS))


def enrich_lines(spark: SparkSession, sf: str) -> DataFrame:
    return plain(p.enrich_lines(b.order_lines(spark, sf), b.catalog(spark, sf)))


def unmatched_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = b.order_lines(spark, sf).select("transaction_id", "product_id")
    return p.unmatched_lines(lines, b.catalog(spark, sf)).select("transaction_id", "product_id")


def sales_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with some fields left out, and the defaults that take their place."""
    lines = b.sale_lines(spark, sf)
    returned, open_line = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    gaps = lines.withColumns(
        {
            "product_id": F.when(~returned, F.col("product_id")),
            "product_name": F.when(~returned, F.col("product_name")),
            "discount_applied": F.when(~open_line, F.col("discount_applied")),
            "quantity": F.when(~(returned & open_line), F.col("quantity")),
        }
    )
    return plain(
        p.with_sales_defaults(gaps).select(
            "transaction_id", "product_id", "product_name", "discount_applied", "quantity"
        )
    )


def checked_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return q.split_lines(b.typed_lines(spark, sf), new_folder(spark, "checked-lines"))


def validate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return plain(checked_lines(spark, sf)[0])


def rejected_lines(spark: SparkSession, sf: str) -> DataFrame:
    return checked_lines(spark, sf)[1].withColumn("errors", F.concat_ws("; ", "errors"))


def positive_quantity(spark: SparkSession, sf: str) -> DataFrame:
    accepted = q.accepted_lines(b.typed_lines(spark, sf))
    return q.positive_quantity(accepted).select("transaction_id", "quantity")


def enforce_sales_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Sales with their columns in another order, checked and put in the fact's."""
    sales = priced_lines(spark, sf).select(*reversed(p.SALES_COLUMNS))
    return plain(q.enforce_schema(sales, SALES_SCHEMA))


def cart_totals(spark: SparkSession, sf: str) -> DataFrame:
    return plain(c.cart_totals(priced_lines(spark, sf)))


def cart_running_total(spark: SparkSession, sf: str) -> DataFrame:
    running = c.cart_running_total(priced_lines(spark, sf))
    return plain(running.select("cart_id", "transaction_id", "total_price_after_taxes", "running_total"))


def cart_what_if(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines are tried as candidates on the carts of all other lines."""
    returned = F.col("l_returnflag") == "R"
    what_if = c.cart_what_if(
        priced_lines(spark, sf).filter(~returned), b.sale_lines(spark, sf).filter(returned)
    )
    return plain(
        what_if.select(
            "cart_id",
            "transaction_id",
            "committed_total",
            F.col("total_price_after_taxes").alias("candidate_total"),
            "what_if_total",
        )
    )


def cart_delete_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cart totals once the returned lines are taken out."""
    deletions = b.order_lines(spark, sf).filter(F.col("l_returnflag") == "R")
    return plain(c.cart_totals(c.delete_lines(priced_lines(spark, sf), deletions)))


def cart_commit(spark: SparkSession, sf: str) -> DataFrame:
    return plain(c.saved_carts(b.cart_events(spark, sf)))


def debounce_searches(spark: SparkSession, sf: str) -> DataFrame:
    return plain(debounce(b.searches(b.cart_events(spark, sf)), DEBOUNCE_GAP))


def sales_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return plain(reports.newest_first(priced_lines(spark, sf).select(*p.SALES_COLUMNS)))


def preview_top20(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 20 sales."""
    return plain(reports.newest(priced_lines(spark, sf).select(*p.SALES_COLUMNS)))


def sold_substitutes(spark: SparkSession, sf: str) -> DataFrame:
    """For every search term: what the carts paid for name matches and for alternatives."""
    catalog = b.catalog(spark, sf)
    per_product = (
        p.enrich_lines(b.order_lines(spark, sf), catalog)
        .groupBy(F.col("product_id").alias("id"))
        .agg(F.sum("total_price_after_taxes").alias("paid"), F.count(F.lit(1)).alias("lines"))
    )
    # One row per spelling and substance, with its first product: terms never meet products.
    first = F.min(F.struct("product_name", "id")).alias("first")
    spelled = (
        catalog.select("id", "product_name", "substance_name")
        .join(per_product, "id", "left")
        .groupBy(F.lower("product_name").alias("_spelled"), "substance_name")
        .agg(first, F.sum("paid").alias("paid"), F.sum("lines").alias("lines"))
        .select("first.id", "first.product_name", "substance_name", "paid", "lines")
    )
    return plain(
        search_batch(spelled, b.search_terms(spark, sf))
        .filter(F.col("lines").isNotNull())
        .groupBy("term", "match_rank")
        .agg(F.sum("paid").alias("paid"), F.sum("lines").alias("lines"))
    )


QUERIES = {
    "price_lines": price_lines,
    "enrich_lines": enrich_lines,
    "unmatched_lines": unmatched_lines,
    "sales_defaults": sales_defaults,
    "enforce_sales_schema": enforce_sales_schema,
    "validate_lines": validate_lines,
    "rejected_lines": rejected_lines,
    "positive_quantity": positive_quantity,
    "cart_totals": cart_totals,
    "cart_running_total": cart_running_total,
    "cart_what_if": cart_what_if,
    "cart_delete_lines": cart_delete_lines,
    "cart_commit": cart_commit,
    "debounce_searches": debounce_searches,
    "sales_newest_first": sales_newest_first,
    "preview_top20": preview_top20,
    "sold_substitutes": sold_substitutes,
}

_TOTALS = """
SELECT cart_id, CAST(sum(total_price_after_taxes) AS DOUBLE) AS cart_total, count(*) AS line_count
FROM """

# Fields of typed lines: blank, unparsable, out of range.
CHECKED_SQL = (
    b.TYPED_SQL
    + r""",
fields AS (
  SELECT *,
    try_strptime(trim(sale_datetime), '%Y-%m-%d %H:%M:%S') AS sold_at,
    TRY_CAST(replace(trim(unit_price), ',', '.') AS DECIMAL(18,2)) AS price,
    TRY_CAST(replace(trim(taxes_price), ',', '.') AS DECIMAL(18,2)) AS tax,
    CAST(TRY_CAST(replace(trim(discount_applied), ',', '.') AS DECIMAL(18,8)) / 100 AS DECIMAL(18,10)) AS fraction,
    TRY_CAST(trim(quantity) AS INTEGER) AS pieces
  FROM typed_lines),
checked AS (
  SELECT *, concat_ws('; ',
    CASE WHEN regexp_full_match(product_name, '\s*') THEN 'product_name is required' END,
    CASE WHEN trim(quantity) = '' THEN 'quantity is required' END,
    CASE WHEN sold_at IS NULL THEN 'sale_datetime is not a valid value' END,
    CASE WHEN price IS NULL THEN 'unit_price is not a valid value' END,
    CASE WHEN tax IS NULL THEN 'taxes_price is not a valid value' END,
    CASE WHEN trim(discount_applied) <> '' AND fraction IS NULL THEN 'discount_applied is not a valid value' END,
    CASE WHEN trim(quantity) <> '' AND pieces IS NULL THEN 'quantity is not a valid value' END,
    CASE WHEN pieces < 0 OR pieces > 9999 THEN 'quantity is not between 0 and 9999' END) AS errors
  FROM fields)"""
)

ORACLE = {
    "price_lines": f"WITH {b.PRICED_SQL} {b.SALES_SELECT} priced",
    "enrich_lines": f"WITH {b.ENRICHED_SQL} {b.SALES_SELECT} enriched_priced",
    "unmatched_lines": f"""WITH {b.LINES_SQL}, {b.CATALOG_SQL}
SELECT transaction_id, product_id FROM sale_lines l
WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.id = l.product_id AND c.unit_price + c.taxes_price IS NOT NULL)""",
    "enforce_sales_schema": f"WITH {b.PRICED_SQL} {b.SALES_SELECT} priced",
    "sales_defaults": f"""WITH {b.LINES_SQL}
SELECT transaction_id,
       CASE WHEN l_returnflag = 'R' THEN '0' ELSE product_id END AS product_id,
       CASE WHEN l_returnflag = 'R' THEN '' ELSE product_name END AS product_name,
       CAST(CASE WHEN l_linestatus = 'O' THEN 0 ELSE discount_applied END AS DOUBLE) AS discount_applied,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 0 ELSE quantity END AS quantity
FROM sale_lines""",
    "validate_lines": f"""WITH {CHECKED_SQL}
SELECT cart_id, transaction_id, CAST(sold_at AS TIMESTAMP) AS sale_datetime, industry_name, product_id,
       {b.trimmed_sql("product_name")} AS product_name, CAST(price AS DOUBLE) AS unit_price,
       CAST(fraction AS DOUBLE) AS discount_applied, CAST(tax AS DOUBLE) AS taxes_price, pieces AS quantity
FROM checked WHERE errors = ''""",
    "rejected_lines": f"""WITH {CHECKED_SQL}
SELECT cart_id, transaction_id, sale_datetime, industry_name, product_id, product_name, unit_price,
       discount_applied, taxes_price, quantity, errors
FROM checked WHERE errors <> ''""",
    "positive_quantity": f"""WITH {CHECKED_SQL}
SELECT transaction_id, pieces AS quantity FROM checked WHERE errors = '' AND pieces > 0""",
    "cart_totals": f"WITH {b.PRICED_SQL} {_TOTALS} priced GROUP BY cart_id",
    "cart_running_total": f"""WITH {b.PRICED_SQL}
SELECT cart_id, transaction_id, CAST(total_price_after_taxes AS DOUBLE) AS total_price_after_taxes,
       CAST(sum(total_price_after_taxes) OVER (PARTITION BY cart_id ORDER BY line_seq, transaction_id,
            quantity, total_price_after_taxes ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total
FROM priced""",
    "cart_what_if": f"""WITH {b.PRICED_SQL}, committed AS (
  SELECT cart_id, sum(total_price_after_taxes) AS total FROM priced WHERE l_returnflag <> 'R' GROUP BY cart_id)
SELECT p.cart_id, p.transaction_id, CAST(coalesce(k.total, 0) AS DOUBLE) AS committed_total,
       CAST(p.total_price_after_taxes AS DOUBLE) AS candidate_total,
       CAST(coalesce(k.total, 0) + p.total_price_after_taxes AS DOUBLE) AS what_if_total
FROM priced p LEFT JOIN committed k ON k.cart_id = p.cart_id WHERE p.l_returnflag = 'R'""",
    "cart_delete_lines": f"""WITH {b.PRICED_SQL} {_TOTALS} priced p
WHERE NOT EXISTS (SELECT 1 FROM priced d WHERE d.l_returnflag = 'R'
                  AND d.cart_id = p.cart_id AND d.transaction_id = p.transaction_id)
GROUP BY cart_id""",
    "cart_commit": f"""WITH {b.SAVED_CARTS_SQL}
SELECT cart, cart_seq, product, quantity, save_event_id, saved_at FROM saved_carts""",
    "debounce_searches": """
SELECT user_id, ts, event_id, text FROM (
  SELECT user_id, ts, event_id, props AS text,
         lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts
  FROM events WHERE event_type = 'view')
WHERE next_ts IS NULL OR next_ts >= ts + INTERVAL 600 SECOND""",
    "sales_newest_first": f"WITH {b.PRICED_SQL} {b.SALES_SELECT} priced ORDER BY sale_datetime DESC, transaction_id",
    "preview_top20": f"""WITH {b.PRICED_SQL} {b.SALES_SELECT} priced
ORDER BY sale_datetime DESC, transaction_id, quantity, priced.total_price_after_taxes, cart_id, industry_name,
         product_id, product_name, priced.unit_price, priced.discount_applied, priced.liquid_price,
         priced.taxes_price, priced.liquid_price_after_taxes, priced.total_price LIMIT 20""",
    "sold_substitutes": f"""WITH {b.ENRICHED_SQL}, {b.TERMS_SQL}, {PICK_SQL},
found AS (
  SELECT p.term, c.id, CASE WHEN contains(lower(c.product_name), p.term) THEN 0 ELSE 1 END AS match_rank
  FROM picked p JOIN catalog c
    ON contains(lower(c.product_name), p.term) OR contains(lower(c.substance_name), lower(p.substance_name))),
sold AS (
  SELECT product_id, sum(total_price_after_taxes) AS paid, count(*) AS lines FROM enriched_priced GROUP BY product_id)
SELECT term, match_rank, CAST(sum(paid) AS DOUBLE) AS paid, CAST(sum(lines) AS BIGINT) AS lines
FROM found JOIN sold ON product_id = id GROUP BY term, match_rank""",
}
