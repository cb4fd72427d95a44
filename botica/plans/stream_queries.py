"""Streams over the stored tables, run until all input is used, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botica.operators.carts import CART_ACTIONS
from botica.operators.pricing import SALES_COLUMNS
from botica.plans import bindings as b
from botica.plans import sales_queries
from botica.plans.bindings import plain
from botica.plans.sales_queries import DEBOUNCE_GAP
from botica.plans.storage_queries import FIRST_SQL
from botica.sinks.files import data_files
from botica.sinks.snapshots import publish_version, read_version
from botica.sinks.tables import read_sales
from botica.sources.tables import read_table
from botica.streaming import carts, sales, searches
from botica.workspace import new_folder


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the parquet tables as a stream."""
    schema = b.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _erp_stream(spark: SparkSession, sf: str) -> tuple[str, str]:
    """The folders of stored and of rejected sales, from files that arrive in two halves."""
    landing = b.erp_landing(spark, sf)
    half = max(1, -(-len(data_files(spark, landing)) // 2))
    out, rejected, checkpoint = (new_folder(spark, n) for n in ("sales", "rejected", "checkpoint"))
    sales.stream_erp_sales(
        spark, landing, b.catalog(spark, sf), out, rejected, checkpoint, files_per_batch=half
    ).awaitTermination()
    return out, rejected


def stream_append_sales(spark: SparkSession, sf: str) -> DataFrame:
    return plain(read_sales(spark, _erp_stream(spark, sf)[0]).select(*SALES_COLUMNS))


def stream_rejected_sales(spark: SparkSession, sf: str) -> DataFrame:
    rejected = read_table(spark, _erp_stream(spark, sf)[1])
    return rejected.select("transaction_id", "customer_id", F.concat_ws("; ", "errors").alias("errors"))


def _enriched(spark: SparkSession, sf: str) -> tuple[str, str]:
    lines = b.shipped_lines(table_stream(spark, sf, "lineitem"))
    out, unmatched, checkpoint = (new_folder(spark, n) for n in ("enriched", "unmatched", "checkpoint"))
    sales.stream_enriched_lines(lines, b.catalog(spark, sf), out, unmatched, checkpoint).awaitTermination()
    return out, unmatched


def stream_enrich_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as they are shipped; the shipping time is the sale's time."""
    return plain(read_table(spark, _enriched(spark, sf)[0]).select(*SALES_COLUMNS))


def stream_unmatched_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The shipped lines that the catalog cannot price."""
    return read_table(spark, _enriched(spark, sf)[1]).select("transaction_id", "product_id", "quantity")


def stream_price_change(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of even orders come first; then prices rise by their taxes, and the rest comes."""
    dimension, landing, out, unmatched, checkpoint = (
        new_folder(spark, n) for n in ("dimension", "lines", "enriched", "unmatched", "checkpoint")
    )
    lines = b.table(spark, sf, "lineitem")
    publish_version(b.dimension(spark, sf), dimension)
    for half in (0, 1):
        if half:
            risen = read_version(spark, dimension).withColumn("unit_price", F.col("unit_price_after_taxes"))
            publish_version(risen, dimension)
        lines.filter(F.col("l_orderkey") % 2 == half).write.mode("append").parquet(landing)
        arrived = b.shipped_lines(spark.readStream.schema(lines.schema).parquet(landing))
        sales.stream_lines_at_current_prices(arrived, dimension, out, unmatched, checkpoint).awaitTermination()
    return plain(read_table(spark, out).select(*SALES_COLUMNS))


# --- events, delivered in four parts by time; every 97th comes with the last part ---------
# Every 89th of the earlier parts is delivered again with the last one.

PARTS = 4


def _delivered(spark: SparkSession, sf: str, late: bool, run) -> None:
    """Writes a part of the events, runs the stream on what is new, and so on."""
    events = b.table(spark, sf, "events")
    first, last = (F.unix_micros(f("ts").cast("timestamp")) for f in (F.min, F.max))
    low, high = events.agg(first, last).first()
    width = (high - low) // PARTS + 1
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) / width)
    if late:
        part = F.when(F.col("event_id") % 97 == 0, PARTS - 1).otherwise(part)
    landing = new_folder(spark, "events")
    for k in range(PARTS):
        again = (part < k) & (F.col("event_id") % 89 == 0) if late and k == PARTS - 1 else F.lit(False)
        events.filter((part == k) | again).write.mode("append").parquet(landing)
        run(b.event_columns(spark.readStream.schema(events.schema).parquet(landing)))


def _cart_state(spark: SparkSession, sf: str, late: bool) -> str:
    state, checkpoint = new_folder(spark, "carts"), new_folder(spark, "checkpoint")

    def run(events: DataFrame) -> None:
        carts.stream_saved_carts(events, state, checkpoint).awaitTermination()

    _delivered(spark, sf, late, run)
    return state


def stream_cart_state(spark: SparkSession, sf: str) -> DataFrame:
    return plain(carts.live_carts(spark, _cart_state(spark, sf, False)))


def stream_late_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events that came when their time had been settled."""
    late = carts.late_events(spark, _cart_state(spark, sf, True))
    return plain(late.select("event_id", "cart", "ts", "action"))


def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's last search of each burst, closed bursts and open ones."""
    state, checkpoint = new_folder(spark, "searches"), new_folder(spark, "checkpoint")

    def run(events: DataFrame) -> None:
        searches.stream_debounced(b.searches(events), state, checkpoint, DEBOUNCE_GAP).awaitTermination()

    _delivered(spark, sf, False, run)
    return plain(searches.live_searches(spark, state, DEBOUNCE_GAP))


QUERIES = {
    "stream_append_sales": stream_append_sales,
    "stream_rejected_sales": stream_rejected_sales,
    "stream_enrich_lines": stream_enrich_lines,
    "stream_unmatched_lines": stream_unmatched_lines,
    "stream_price_change": stream_price_change,
    "stream_cart_state": stream_cart_state,
    "stream_late_events": stream_late_events,
    "stream_debounce": stream_debounce,
}


_ERP_FIRST_SQL = FIRST_SQL.replace("FROM priced)", "FROM erp_sales)")
_VERSIONS_SQL = """versions AS (
  SELECT *, 0 AS version FROM catalog
  UNION ALL
  SELECT * REPLACE (unit_price_after_taxes AS unit_price,
                    CAST(unit_price_after_taxes - unit_price_after_taxes AS DECIMAL(18,2)) AS taxes_price),
         1 AS version FROM catalog),
"""
_PRICE_CHANGE_SQL = b.SHIPPED_SQL.replace("shipped AS (", _VERSIONS_SQL + "shipped AS (", 1).replace(
    "JOIN catalog c\n    ON", "JOIN versions c\n    ON c.version = l_orderkey % 2 AND"
)
_ACTIONS = ", ".join(f"'{a}'" for a in CART_ACTIONS)

ORACLE = {
    "stream_append_sales": f"WITH {b.ERP_SALES_SQL}, {_ERP_FIRST_SQL} {b.SALES_SELECT} first_sales",
    "stream_rejected_sales": f"WITH {b.ERP_REJECTED_SQL}",
    "stream_enrich_lines": f"WITH {b.SHIPPED_SQL} {b.SALES_SELECT} shipped_priced",
    "stream_price_change": f"WITH {_PRICE_CHANGE_SQL} {b.SALES_SELECT} shipped_priced",
    "stream_unmatched_lines": f"""WITH {b.CATALOG_SQL}
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id,
       CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS INTEGER) AS quantity
FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM catalog c
                  WHERE c.id = CAST(l_partkey AS VARCHAR) AND c.unit_price + c.taxes_price IS NOT NULL)""",
    "stream_cart_state": f"""WITH {b.SAVED_CARTS_SQL}
SELECT cart, cart_seq, product, quantity, save_event_id, saved_at FROM saved_carts""",
    "stream_late_events": f"""WITH {b.SAVED_CARTS_SQL},
span AS (
  SELECT epoch_us(min(ts)) AS low, (epoch_us(max(ts)) - epoch_us(min(ts))) // {PARTS} + 1 AS width FROM events),
parts AS (
  SELECT e.*, CASE WHEN event_id % 97 = 0 THEN {PARTS - 1} ELSE (epoch_us(ts) - low) // width END AS part
  FROM cart_events e CROSS JOIN span)
SELECT event_id, cart, ts, action FROM parts
WHERE part = {PARTS - 1}
  AND ts <= (SELECT max(ts) FROM parts WHERE part < {PARTS - 1} AND action IN ({_ACTIONS})) - INTERVAL 1 HOUR""",
    "stream_debounce": sales_queries.ORACLE["debounce_searches"],
}
