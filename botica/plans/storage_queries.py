"""Files and tables: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botica.functions.timing import TIMESTAMP_FORMAT
from botica.operators.catalog import catalog_view
from botica.operators.pricing import SALES_COLUMNS
from botica.operators.quality import accepted, split_corrupt
from botica.plans import bindings as b
from botica.plans.bindings import plain
from botica.plans.catalog_queries import CATALOG_SELECT, DIM_SELECT, dim_select
from botica.operators.reports import PREVIEW_ROWS
from botica.plans import sales_queries
from botica.plans.sales_queries import priced_lines
from botica.schemas import CORRUPT_COLUMN, ERP_SCHEMA, PRICE_LIST_HEADERS, SALES_SCHEMA
from botica.sinks import tables as sinks
from botica.sinks.refresh import refresh_if_stale
from botica.sinks.snapshots import publish_version, read_version
from botica.sources import files, tables
from botica.workspace import new_folder


def scan_csv_typed(spark: SparkSession, sf: str) -> DataFrame:
    path = b.write_csv(priced_lines(spark, sf).select(*SALES_COLUMNS), new_folder(spark, "sales-csv"))
    return plain(files.read_typed_csv(spark, path, SALES_SCHEMA))


def scan_csv_semicolon(spark: SparkSession, sf: str) -> DataFrame:
    path = b.write_csv(b.price_list(spark, sf), new_folder(spark, "price-list"), ";")
    return files.read_semicolon_csv(spark, path)


def erp_to_sales(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.read_erp_files(spark, [b.erp_landing(spark, sf)])
    return plain(files.erp_to_sales(accepted(files.check_erp(rows)), b.catalog(spark, sf)))


def erp_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """ERP rows as text; where the customer is empty one comma is missing."""
    extract = b.erp_extract(spark, sf)
    fields = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in ERP_SCHEMA.fieldNames()}
    fields["sale_datetime"] = F.date_format("sale_datetime", TIMESTAMP_FORMAT)
    complete = F.concat_ws(",", *fields.values())
    short = F.concat_ws(",", *[v for name, v in fields.items() if name != "is_prescription_item"])
    return extract.select(F.when(F.col("customer_id").isNull(), short).otherwise(complete).alias("value"))


def csv_corrupt_split(spark: SparkSession, sf: str) -> DataFrame:
    """Well-formed rows with their total, malformed ones with their whole line."""
    path = new_folder(spark, "erp-ragged")
    erp_text_lines(spark, sf).write.text(path)
    parsed = files.read_checked_csv(spark, path, ERP_SCHEMA, header=False)
    good, bad = split_corrupt(parsed, CORRUPT_COLUMN, new_folder(spark, "erp-parsed"))
    return good.select(
        "transaction_id",
        F.lit(None).cast("string").alias("malformed_line"),
        F.col("total_price").cast("double").alias("total_price"),
    ).unionByName(
        bad.select(
            "transaction_id",
            F.col(CORRUPT_COLUMN).alias("malformed_line"),
            F.lit(None).cast("double").alias("total_price"),
        )
    )


def scan_dim_product(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "dim-product")
    sinks.overwrite_table(b.dimension(spark, sf), path)
    return plain(catalog_view(tables.read_table(spark, path)))


def range_source(spark: SparkSession, sf: str) -> DataFrame:
    """One number per possible order key, written to a new table and read back."""
    high = b.table(spark, sf, "orders").agg(F.max("o_orderkey").alias("high")).first()["high"]
    path = new_folder(spark, "range")
    sinks.write_new(tables.number_range(spark, 0, high + 1), path)
    return tables.read_table(spark, path)


def append_sales_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "daily-sales")
    sales = priced_lines(spark, sf)
    for batch in (F.col("l_linestatus") == "O", F.col("l_linestatus") != "O"):
        sinks.append_sales(sales.filter(batch).select(*SALES_COLUMNS), path)
    return plain(sinks.read_sales(spark, path).select(*SALES_COLUMNS))


def newest_stored_sales(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 20 sales of the stored fact, of which only the last periods are read."""
    path = new_folder(spark, "daily-sales")
    sinks.append_sales(priced_lines(spark, sf).select(*SALES_COLUMNS), path)
    return plain(sinks.newest_sales(spark, path, PREVIEW_ROWS).select(*SALES_COLUMNS))


def append_sales_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """All sales are delivered; then some again with another month; none is stored twice."""
    path = new_folder(spark, "daily-sales")
    sales = priced_lines(spark, sf).select(*SALES_COLUMNS)
    sinks.append_new_sales(sales, path)
    corrected = F.col("sale_datetime") + F.expr("interval 40 days")
    sinks.append_new_sales(
        sales.filter(F.col("quantity") % 5 == 0).withColumn("sale_datetime", corrected), path
    )
    return plain(sinks.read_sales(spark, path).select(*SALES_COLUMNS))


def refresh_dimension_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension refreshed from landed lists: products without a code, and torn lines, stay out."""
    landed, path = new_folder(spark, "landed"), new_folder(spark, "dim-product")
    listed = b.price_list(spark, sf)
    code = F.col("`CÓDIGO GGREM`")
    blank = F.when(code.cast("long") % 29 == 0, " \t").otherwise(code)
    b.write_csv(listed.withColumn("CÓDIGO GGREM", blank), landed, ";")
    listed.filter(code.cast("long") % 7 == 0).select(F.concat(F.lit("torn;"), code).alias("value")).write.mode(
        "append"
    ).text(landed)
    assert refresh_if_stale(spark, landed, path)
    return tables.read_table(spark, path)


def overwrite_dim_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension is replaced by a version computed from itself."""
    path = new_folder(spark, "dim-product")
    sinks.overwrite_table(b.dimension(spark, sf), path)
    stored = tables.read_table(spark, path)
    sinks.overwrite_table(stored.withColumn("cap", F.lit("Sim")), path)
    return tables.read_table(spark, path)


def dim_versions_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Both versions of a dimension that is replaced while a reader holds the first."""
    path = new_folder(spark, "dim-versions")
    publish_version(b.dimension(spark, sf), path)
    held = read_version(spark, path)
    publish_version(held.withColumn("cap", F.lit("Sim")), path)
    numbered = [df.withColumn("version", F.lit(n)) for n, df in enumerate((held, read_version(spark, path)))]
    return numbered[0].unionByName(numbered[1])


def raw_names_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "raw-names")
    sinks.overwrite_raw_names(b.price_list(spark, sf), path)
    return tables.read_table(spark, path)


QUERIES = {
    "scan_csv_typed": scan_csv_typed,
    "scan_csv_semicolon": scan_csv_semicolon,
    "erp_to_sales": erp_to_sales,
    "csv_corrupt_split": csv_corrupt_split,
    "scan_dim_product": scan_dim_product,
    "range_source": range_source,
    "append_sales_roundtrip": append_sales_roundtrip,
    "newest_stored_sales": newest_stored_sales,
    "append_sales_idempotent": append_sales_idempotent,
    "refresh_dimension_roundtrip": refresh_dimension_roundtrip,
    "overwrite_dim_roundtrip": overwrite_dim_roundtrip,
    "dim_versions_roundtrip": dim_versions_roundtrip,
    "raw_names_roundtrip": raw_names_roundtrip,
}

_RAW_SELECT = ", ".join(f'{c} AS "{header}"' for c, header in PRICE_LIST_HEADERS.items())

_ERP_TEXT = {
    f: f"coalesce(CAST({f} AS VARCHAR), '')" for f in ERP_SCHEMA.fieldNames()
} | {"sale_datetime": "strftime(sale_datetime, '%Y-%m-%d %H:%M:%S')"}
_SHORT_LINE = " || ',' || ".join(v for f, v in _ERP_TEXT.items() if f != "is_prescription_item")

# One row per transaction: the smallest by quantity, total, time and product.
FIRST_SQL = """
first_sales AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id
              ORDER BY quantity, total_price_after_taxes, sale_datetime, product_id) AS place FROM priced)
  WHERE place = 1)"""

ORACLE = {
    "scan_csv_typed": f"WITH {b.PRICED_SQL} {b.SALES_SELECT} priced",
    "scan_csv_semicolon": f"WITH {b.PRICE_LIST_SQL} SELECT {_RAW_SELECT} FROM price_list",
    "erp_to_sales": f"WITH {b.ERP_SALES_SQL} {b.SALES_SELECT} erp_sales",
    "csv_corrupt_split": f"""WITH {b.ERP_SQL}
SELECT transaction_id, CASE WHEN customer_id IS NULL THEN {_SHORT_LINE} END AS malformed_line,
       CAST(CASE WHEN customer_id IS NOT NULL THEN total_price END AS DOUBLE) AS total_price
FROM erp""",
    "scan_dim_product": f"WITH {b.CATALOG_SQL} {CATALOG_SELECT} catalog",
    "range_source": "SELECT unnest(range(0, (SELECT max(o_orderkey) + 1 FROM orders))) AS id",
    "append_sales_roundtrip": f"WITH {b.PRICED_SQL} {b.SALES_SELECT} priced",
    "newest_stored_sales": sales_queries.ORACLE["preview_top20"],
    "append_sales_idempotent": f"WITH {b.PRICED_SQL}, {FIRST_SQL} {b.SALES_SELECT} first_sales",
    "refresh_dimension_roundtrip": f"""WITH {b.PRICE_LIST_SQL},
usable AS (SELECT * FROM price_list WHERE CAST(ggrem_code AS BIGINT) % 29 <> 0)
{dim_select("usable")}""",
    "overwrite_dim_roundtrip": f"WITH {b.PRICE_LIST_SQL} {DIM_SELECT} (SELECT * REPLACE ('Sim' AS cap) FROM price_list)",
    "dim_versions_roundtrip": f"""WITH {b.PRICE_LIST_SQL},
kept AS (SELECT *, 0 AS version FROM price_list
         UNION ALL SELECT * REPLACE ('Sim' AS cap), 1 AS version FROM price_list)
{DIM_SELECT.replace("stripe", "stripe, version")} kept""",
    "raw_names_roundtrip": f"WITH {b.PRICE_LIST_SQL} SELECT {_RAW_SELECT} FROM price_list",
}
