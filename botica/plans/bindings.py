"""The logical tables of the library, derived from the star schema's parquet files.

Each table has a Spark form (a function) and a SQL form (a constant, to be used
after ``WITH``). Dirt such as blank or unparsable fields is written into rows
by arithmetic on their keys, so that both forms hold the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botica.functions.timing import TIMESTAMP_FORMAT
from botica.operators.carts import DELETE, SAVE, SEARCH, SET_QUANTITY
from botica.operators.catalog import catalog_view, dim_product
from botica.schemas import ERP_SCHEMA, PRICE_LIST_HEADERS
from botica.sinks.files import file_system
from botica.workspace import new_folder

# Sequence numbers: line number first, part number second.
LINE_NUMBER_WEIGHT = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def comma_text(amount: Column) -> Column:
    return F.translate(amount.cast("decimal(18,2)").cast("string"), ".", ",")


def trimmed_sql(column: str) -> str:
    """SQL form of ``functions.text.trimmed`` for the white space that the rows hold."""
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def divisible(column: str, by: int) -> Column:
    return F.col(column) % by == 0


# --- price list, dimension, catalog ---------------------------------------------------


def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price list under its own headers, all text."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    after = F.concat(
        comma_text(F.round(price * F.lit("1.12").cast("decimal(3,2)"), 2)),
        F.when(divisible("p_partkey", 7), "*").otherwise(""),
    )
    no_value = F.lit("    -     ")
    values = {
        "industry_name": F.col("p_brand"),
        "industry_cnpj": F.concat(F.lit("CNPJ "), F.col("p_brand")),
        "ggrem_code": key,
        "registro": F.concat(F.lit("R"), key),
        "ean1": F.concat(F.lit("789"), F.lpad(key, 10, "0")),
        "ean2": no_value,
        "ean3": F.when(divisible("p_partkey", 5), no_value).otherwise(F.concat(F.lit("790"), key)),
        "substance_name": F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)),
        "product_name": F.col("p_name"),
        "product_presentation": F.when(
            ~divisible("p_partkey", 101), F.concat("p_type", F.lit(" X "), F.col("p_size"))
        ),
        "terapy_class": F.concat("p_brand", F.lit(";"), "p_type"),
        "product_type": F.col("p_type"),
        "price_regime": F.lit("Regulado"),
        "unit_price": comma_text(price),
        "unit_price_after_taxes": F.when(divisible("p_partkey", 13), no_value).otherwise(after),
        "hospital_restriction": F.when(divisible("p_partkey", 3), "Sim").otherwise("Não"),
        "cap": F.lit("Não"),
        "confaz87": F.lit("Não"),
        "icms0": F.lit("Não"),
        "appeal_analysis": F.lit(None).cast("string"),
        "credit_concession": F.lit("Negativa"),
        "stripe": F.lit("- (*) "),
    }
    return part.select(*[values[c].alias(h) for c, h in PRICE_LIST_HEADERS.items()])


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension keyed by the part number."""
    return dim_product(price_list(spark, sf_dir), key=F.col("ggrem_code"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_view(dimension(spark, sf_dir))


PRICE_LIST_SQL = """
price_list AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id,
         p_brand AS industry_name,
         'CNPJ ' || p_brand AS industry_cnpj,
         CAST(p_partkey AS VARCHAR) AS ggrem_code,
         'R' || p_partkey AS registro,
         '789' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS ean1,
         '    -     ' AS ean2,
         CASE WHEN p_partkey % 5 = 0 THEN '    -     ' ELSE '790' || p_partkey END AS ean3,
         split_part(p_name, ' ', 2) AS substance_name,
         p_name AS product_name,
         CASE WHEN p_partkey % 101 <> 0 THEN p_type || ' X ' || p_size END AS product_presentation,
         p_brand || ';' || p_type AS terapy_class,
         p_type AS product_type,
         'Regulado' AS price_regime,
         replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS unit_price,
         CASE WHEN p_partkey % 13 = 0 THEN '    -     '
              ELSE replace(CAST(CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(1.12 AS DECIMAL(3,2)), 2)
                           AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
                   || CASE WHEN p_partkey % 7 = 0 THEN '*' ELSE '' END
         END AS unit_price_after_taxes,
         CASE WHEN p_partkey % 3 = 0 THEN 'Sim' ELSE 'Não' END AS hospital_restriction,
         'Não' AS cap, 'Não' AS confaz87, 'Não' AS icms0,
         CAST(NULL AS VARCHAR) AS appeal_analysis,
         'Negativa' AS credit_concession,
         '- (*) ' AS stripe
  FROM part)"""


def _price_sql(column: str) -> str:
    return (
        f"TRY_CAST(replace(nullif(regexp_extract({column}, "
        r"'^\s*([0-9]+([.,][0-9]+)?)\s*\*?\s*$', 1), ''), ',', '.') AS DECIMAL(18,2))"
    )


CATALOG_SQL = f"""{PRICE_LIST_SQL},
catalog AS (
  SELECT *, CAST(unit_price_after_taxes - unit_price AS DECIMAL(18,2)) AS taxes_price
  FROM (
    SELECT id, substance_name, industry_name,
           nullif(nullif(trim(ean1), ''), '-') AS ean1,
           nullif(nullif(trim(ean2), ''), '-') AS ean2,
           nullif(nullif(trim(ean3), ''), '-') AS ean3,
           product_name || ' ' || product_presentation AS product_name,
           product_presentation,
           {_price_sql("unit_price")} AS unit_price,
           {_price_sql("unit_price_after_taxes")} AS unit_price_after_taxes,
           rtrim(unit_price_after_taxes) LIKE '%*' AS price_flag
    FROM price_list)
  WHERE product_name IS NOT NULL)"""


# --- search terms ---------------------------------------------------------------------


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, substances in capitals and two-letter beginnings, with terms that find nothing."""
    part = table(spark, sf_dir, "part")
    words = F.explode(
        F.array(
            F.col("p_name"),
            F.upper(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))),
            F.substring("p_name", 1, 2),
            F.concat(F.lit("zzz"), F.col("p_size")),
            F.lit(" "),
            F.lit("gizmo eco"),
            F.lit("x"),
        )
    )
    return part.select(words.alias("term"))


TERMS_SQL = """
terms AS (
  SELECT DISTINCT lower(term) AS term
  FROM (SELECT unnest([p_name, upper(split_part(p_name, ' ', 2)), substr(p_name, 1, 2),
                       'zzz' || p_size, ' ', 'gizmo eco', 'x']) AS term FROM part)
  WHERE trim(term) <> '')"""


# --- sale lines -----------------------------------------------------------------------


def transaction_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _at_their_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line table with its orders' times, as numbers: texts are made when all joins are done."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = line_table(spark, sf_dir)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _line_columns() -> list[Column]:
    return [
        F.col("l_orderkey").cast("string").alias("cart_id"),
        transaction_key().alias("transaction_id"),
        (F.col("l_linenumber") * F.lit(LINE_NUMBER_WEIGHT) + F.col("l_partkey")).alias("line_seq"),
        F.col("o_orderdate").cast("timestamp").alias("sale_datetime"),
    ]


def _sold_columns() -> list[Column]:
    return [
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_discount").cast("decimal(9,4)").alias("discount_applied"),
    ]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order's time, before the catalog is looked up."""
    return _at_their_time(spark, sf_dir).select(
        *_line_columns(),
        "l_partkey",
        *_sold_columns(),
        F.col("l_tax").cast("decimal(9,4)").alias("_tax"),
        "l_returnflag",
        "l_linestatus",
    )


def sale_lines(spark: SparkSession, sf_dir: str, dealt: int | None = None) -> DataFrame:
    """Lines with product, price and tax, ready for pricing; ``dealt`` by order to so many tasks."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    tax = F.round(price * F.col("l_tax").cast("decimal(9,4)"), 2).cast("decimal(18,2)")
    bought = F.col("l_partkey") == F.col("p_partkey")
    if dealt:
        # Products come first, so that the join with the orders leaves the lines as they are dealt.
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartition(dealt, "o_orderkey")
        lines = line_table(spark, sf_dir).join(part, bought).repartition(dealt, "l_orderkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    else:
        lines = _at_their_time(spark, sf_dir).join(part, bought)
    return lines.select(
        *_line_columns(),
        *_sold_columns(),
        "l_returnflag",
        "l_linestatus",
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("industry_name"),
        price.alias("unit_price"),
        tax.alias("taxes_price"),
    )


def shipped_lines(lineitem: DataFrame) -> DataFrame:
    """Bare lines from the line table alone, whether batch or stream."""
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("cart_id"),
        transaction_key().alias("transaction_id"),
        F.col("l_shipdate").cast("timestamp").alias("sale_datetime"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_discount").cast("decimal(9,4)").alias("discount_applied"),
    )


LINES_SQL = """
sale_lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS cart_id,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id,
         CAST(l_linenumber AS BIGINT) * 1099511627776 + l_partkey AS line_seq,
         o_orderdate AS sale_datetime,
         p_brand AS industry_name,
         CAST(l_partkey AS VARCHAR) AS product_id,
         p_name AS product_name,
         CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
         CAST(l_discount AS DECIMAL(9,4)) AS discount_applied,
         CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(9,4)), 2) AS DECIMAL(18,2)) AS taxes_price,
         CAST(l_quantity AS INTEGER) AS quantity,
         l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def priced_sql(source: str, name: str) -> str:
    """SQL form of pricing the lines of ``source``."""
    return f"""
{name} AS (
  SELECT *, CAST(quantity * liquid_price AS DECIMAL(18,2)) AS total_price,
         CAST(quantity * liquid_price_after_taxes AS DECIMAL(18,2)) AS total_price_after_taxes
  FROM (
    SELECT *, CAST(liquid_price + taxes_price AS DECIMAL(18,2)) AS liquid_price_after_taxes
    FROM (
      SELECT * REPLACE (CASE WHEN discount_applied IS NOT NULL THEN
                          greatest(CAST(0 AS DECIMAL(9,4)), least(CAST(1 AS DECIMAL(9,4)), discount_applied)) END
                        AS discount_applied),
             CAST(round(unit_price * (1 - greatest(CAST(0 AS DECIMAL(9,4)),
                  least(CAST(1 AS DECIMAL(9,4)), coalesce(discount_applied, CAST(0 AS DECIMAL(9,4)))))), 2)
                  AS DECIMAL(18,2)) AS liquid_price
      FROM {source})))"""


PRICED_SQL = LINES_SQL + "," + priced_sql("sale_lines", "priced")

# SQL form of looking the catalog up for bare order lines.
ENRICHED_SQL = (
    LINES_SQL
    + ","
    + CATALOG_SQL
    + """,
enriched AS (
  SELECT l.cart_id, l.transaction_id, l.line_seq, l.sale_datetime, c.industry_name, l.product_id,
         c.product_name, c.unit_price, l.discount_applied,
         c.taxes_price, l.quantity
  FROM sale_lines l JOIN catalog c ON l.product_id = c.id AND c.unit_price + c.taxes_price IS NOT NULL),"""
    + priced_sql("enriched", "enriched_priced")
)


SHIPPED_SQL = (
    CATALOG_SQL
    + """,
shipped AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS cart_id,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id,
         l_shipdate AS sale_datetime, c.industry_name, c.id AS product_id, c.product_name, c.unit_price,
         CAST(l_discount AS DECIMAL(9,4)) AS discount_applied,
         c.taxes_price, CAST(l_quantity AS INTEGER) AS quantity
  FROM lineitem JOIN catalog c
    ON c.id = CAST(l_partkey AS VARCHAR) AND c.unit_price + c.taxes_price IS NOT NULL),"""
    + priced_sql("shipped", "shipped_priced")
)


# --- lines typed in by hand -----------------------------------------------------------


def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale line as the text somebody typed, with the usual mistakes."""
    lines = line_table(spark, sf_dir).withColumn(
        "k", F.col("l_orderkey") * 8 + F.col("l_linenumber")
    )
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    whole = F.col("l_quantity").cast("int").cast("string")
    percent = (F.col("l_discount").cast("decimal(9,4)") * 100).cast("int").cast("string")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    tax = F.round(price * F.col("l_tax").cast("decimal(9,4)"), 2)
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("cart_id"),
            transaction_key().alias("transaction_id"),
            F.when(divisible("k", 31), "2024-13-45 99:00:00")
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .alias("sale_datetime"),
            F.col("p_brand").alias("industry_name"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.when(divisible("k", 37), " \t ")
            .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\t")))
            .alias("product_name"),
            F.when(divisible("k", 41), "x1").otherwise(comma_text(price)).alias("unit_price"),
            F.when(divisible("k", 43), "")
            .when(divisible("k", 47), "n/a")
            .when(divisible("k", 53), "150")
            .when(divisible("k", 59), "-5")
            .otherwise(percent)
            .alias("discount_applied"),
            comma_text(tax).alias("taxes_price"),
            F.when(divisible("k", 17), "")
            .when(divisible("k", 19), "abc")
            .when(divisible("k", 23), "-1")
            .when(divisible("k", 29), "10000")
            .when(divisible("k", 5), F.concat(F.lit(" "), whole, F.lit(" ")))
            .otherwise(whole)
            .alias("quantity"),
        )
    )


TYPED_SQL = """
typed_lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS cart_id,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id,
         CASE WHEN k % 31 = 0 THEN '2024-13-45 99:00:00'
              ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS sale_datetime,
         p_brand AS industry_name,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CASE WHEN k % 37 = 0 THEN ' ' || chr(9) || ' ' ELSE ' ' || p_name || chr(9) END AS product_name,
         CASE WHEN k % 41 = 0 THEN 'x1'
              ELSE replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') END AS unit_price,
         CASE WHEN k % 43 = 0 THEN '' WHEN k % 47 = 0 THEN 'n/a' WHEN k % 53 = 0 THEN '150'
              WHEN k % 59 = 0 THEN '-5'
              ELSE CAST(CAST(CAST(l_discount AS DECIMAL(9,4)) * 100 AS INTEGER) AS VARCHAR) END AS discount_applied,
         replace(CAST(CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(9,4)), 2)
                 AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS taxes_price,
         CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN 'abc' WHEN k % 23 = 0 THEN '-1'
              WHEN k % 29 = 0 THEN '10000'
              WHEN k % 5 = 0 THEN ' ' || CAST(l_quantity AS INTEGER) || ' '
              ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS quantity
  FROM (SELECT *, l_orderkey * 8 + l_linenumber AS k FROM lineitem)
       JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


# --- ERP extract ----------------------------------------------------------------------


def erp_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale line as a row of the ERP extract; the discount is an amount."""
    return sale_lines(spark, sf_dir).select(*_erp_columns())


def _erp_columns() -> list[Column]:
    gross = F.col("unit_price") * F.col("quantity")
    number = F.col("cart_id").cast("long")
    # Some discounts are a dime on the whole line, however large it is.
    amount = F.when(number % 11 == 0, F.lit("0.10").cast("decimal(18,2)")).otherwise(
        F.round(gross * F.col("discount_applied"), 2).cast("decimal(18,2)")
    )
    return [
        *map(F.col, ("transaction_id", "sale_datetime", "product_id", "product_name", "quantity", "unit_price")),
        (gross - amount).cast("decimal(18,2)").alias("total_price"),
        F.when(number % 3 == 0, "Cash").otherwise("Credit Card").alias("payment_method"),
        F.concat(F.lit("EMP"), number % 10).alias("employee_id"),
        F.when(number % 4 > 0, F.concat(F.lit("CUST"), number % 100)).alias("customer_id"),
        F.lit(None).cast("string").alias("prescription_id"),
        F.when(number % 4 > 0, number % 4 == 1).alias("is_prescription_item"),
        amount.alias("discount_applied"),
        (number % 50).cast("int").alias("loyalty_points_earned"),
        F.concat(F.lit("LOC"), number % 7).alias("store_location_id"),
    ]


ERP_SQL = (
    LINES_SQL
    + """,
erp AS (
  SELECT transaction_id, sale_datetime, product_id, product_name, quantity, unit_price,
         CAST(unit_price * quantity - amount AS DECIMAL(18,2)) AS total_price,
         CASE WHEN number % 3 = 0 THEN 'Cash' ELSE 'Credit Card' END AS payment_method,
         'EMP' || (number % 10) AS employee_id,
         CASE WHEN number % 4 > 0 THEN 'CUST' || (number % 100) END AS customer_id,
         CAST(NULL AS VARCHAR) AS prescription_id,
         CASE WHEN number % 4 > 0 THEN number % 4 = 1 END AS is_prescription_item,
         amount AS discount_applied,
         CAST(number % 50 AS INTEGER) AS loyalty_points_earned,
         'LOC' || (number % 7) AS store_location_id, number
  FROM (SELECT *, CAST(cart_id AS BIGINT) AS number,
               CASE WHEN CAST(cart_id AS BIGINT) % 11 = 0 THEN CAST(0.10 AS DECIMAL(18,2))
                    ELSE CAST(round(unit_price * quantity * discount_applied, 2) AS DECIMAL(18,2)) END AS amount
        FROM sale_lines))"""
)

# Files of each layout: so many at least, and one for so many bytes of the line table.
LANDED_FILES, LANDED_BYTES = 8, 16 << 20
_ODD_NAMES = ("till 7 [north]", "100%41#b", "{a,b} *?")


def landed_files(spark: SparkSession, sf_dir: str) -> int:
    fs, path = file_system(spark, f"{sf_dir}/lineitem.parquet")
    return max(LANDED_FILES, -(-fs.getContentSummary(path).getLength() // LANDED_BYTES))


def erp_landing(spark: SparkSession, sf_dir: str) -> str:
    """The extract as landed files with headers of three orders, and fields left blank.

    One third has its columns reversed, one third an unknown column in front. The names of
    their folders hold blanks and signs that mean something in patterns and addresses.
    """
    # Every till delivers files of its own; all lines of an order come in one file.
    own = F.col("cart_id").cast("long")
    extract = sale_lines(spark, sf_dir, landed_files(spark, sf_dir)).select(*_erp_columns(), own.alias("own"))
    number, own = F.col("store_location_id"), F.col("own")
    texts = {f: F.col(f).cast("string") for f in ERP_SCHEMA.fieldNames()}
    texts["sale_datetime"] = F.date_format("sale_datetime", TIMESTAMP_FORMAT)
    texts["quantity"] = F.when(own % 17 != 0, texts["quantity"])
    texts["product_name"] = F.when(own % 19 == 0, " \t").otherwise(texts["product_name"])
    folder = new_folder(spark, "erp-landing")
    layouts = [texts, reversed(texts), ["note", *texts]]
    for part, names in enumerate(layouts):
        # Spark takes the filter down to the line table: each layout deals its own rows only.
        rows = extract.filter(own % 3 == part).select(*[c.alias(f) for f, c in texts.items()]).withColumn("note", number)
        write_csv(rows.select(*names), f"{folder}/{_ODD_NAMES[part]}", compression="gzip")
    return folder


def write_csv(df: DataFrame, path: str, delimiter: str = ",", compression: str = "none") -> str:
    """A CSV folder with headers; blanks around values are part of the value."""
    (
        df.write.option("header", True)
        .option("compression", compression)
        .option("delimiter", delimiter)
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


# SQL form of mapping ERP rows to sales. Amounts are whole cents; the fraction is rounded
# at its tenth decimal, and both totals follow from the stated amounts.
ERP_SALES_SQL = (
    ERP_SQL
    + ","
    + CATALOG_SQL
    + """,
erp_lines AS (
  SELECT e.transaction_id AS cart_id, e.transaction_id, e.sale_datetime,
         coalesce(c.industry_name, 'UNKNOWN') AS industry_name, e.product_id, e.product_name, e.unit_price,
         CAST((CAST(e.discount_applied * 100 AS HUGEINT) * 20000000000
               + CAST(e.unit_price * e.quantity * 100 AS HUGEINT))
              // (2 * CAST(e.unit_price * e.quantity * 100 AS HUGEINT)) AS DECIMAL(18,0))
           * CAST(0.0000000001 AS DECIMAL(10,10)) AS fraction,
         coalesce(c.taxes_price, CAST(0 AS DECIMAL(18,2))) AS taxes_price, e.quantity, e.total_price
  FROM erp e LEFT JOIN catalog c ON e.product_id = c.id
  WHERE e.number % 17 <> 0 AND e.number % 19 <> 0),
erp_sales AS (
  SELECT *, CAST(liquid_price + taxes_price AS DECIMAL(18,2)) AS liquid_price_after_taxes,
         CAST(total_price + quantity * taxes_price AS DECIMAL(18,2)) AS total_price_after_taxes
  FROM (SELECT * EXCLUDE (fraction), CAST(fraction AS DOUBLE) AS discount_applied,
               CAST(round(unit_price * (1 - CAST(fraction AS DECIMAL(12,10))), 2) AS DECIMAL(18,2)) AS liquid_price
        FROM erp_lines))"""
)

ERP_REJECTED_SQL = (
    ERP_SQL
    + """
SELECT transaction_id, customer_id,
       concat_ws('; ', CASE WHEN number % 19 = 0 THEN 'product_name is required' END,
                 CASE WHEN number % 17 = 0 THEN 'quantity is required' END) AS errors
FROM erp WHERE number % 17 = 0 OR number % 19 = 0"""
)


# --- cart events ----------------------------------------------------------------------


def event_columns(events: DataFrame) -> DataFrame:
    """Cart events read from the event table, whether batch or stream."""
    kind = F.col("event_type")
    action = (
        F.when(kind.isin("signup", "click"), SET_QUANTITY)
        .when(kind == "error", DELETE)
        .when(kind == "purchase", SAVE)
        .when(kind == "view", SEARCH)
    )
    return events.select(
        "event_id",
        F.col("user_id").alias("cart"),
        F.col("ts").cast("timestamp").alias("ts"),
        action.alias("action"),
        (F.col("event_id") % 5).alias("product"),
        (F.floor("value").cast("int") % 10).alias("quantity"),
        F.col("props").alias("text"),
    )


def cart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(table(spark, sf_dir, "events"))


def searches(events: DataFrame) -> DataFrame:
    return events.filter(F.col("action") == SEARCH).select(
        F.col("cart").alias("user_id"), "ts", "event_id", "text"
    )


SAVED_CARTS_SQL = """
cart_events AS (
  SELECT event_id, user_id AS cart, ts, event_id % 5 AS product,
         CAST(CAST(floor(value) AS INTEGER) % 10 AS INTEGER) AS quantity,
         CASE WHEN event_type IN ('signup', 'click') THEN 'set_qty' WHEN event_type = 'error' THEN 'delete'
              WHEN event_type = 'purchase' THEN 'save' END AS action
  FROM events WHERE event_type <> 'view'),
numbered AS (
  SELECT *, coalesce(sum(CASE WHEN action = 'save' THEN 1 ELSE 0 END) OVER
              (PARTITION BY cart ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cart_seq
  FROM cart_events),
last_actions AS (
  SELECT cart, cart_seq, product, action, quantity,
         row_number() OVER (PARTITION BY cart, cart_seq, product ORDER BY ts DESC, event_id DESC) AS back
  FROM numbered WHERE action <> 'save'),
saved_carts AS (
  SELECT l.cart, CAST(l.cart_seq AS BIGINT) AS cart_seq, l.product, l.quantity,
         s.event_id AS save_event_id, s.ts AS saved_at
  FROM last_actions l JOIN numbered s ON s.cart = l.cart AND s.cart_seq = l.cart_seq AND s.action = 'save'
  WHERE l.back = 1 AND l.action = 'set_qty' AND l.quantity > 0)"""


# --- output ---------------------------------------------------------------------------


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times without a zone, the types the SQL twins return."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        out.append(column.alias(name))
    return df.select(*out)


SALES_SELECT = """
SELECT cart_id, transaction_id, sale_datetime, industry_name, product_id, product_name,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(discount_applied AS DOUBLE) AS discount_applied,
       CAST(liquid_price AS DOUBLE) AS liquid_price, CAST(taxes_price AS DOUBLE) AS taxes_price,
       CAST(liquid_price_after_taxes AS DOUBLE) AS liquid_price_after_taxes, quantity,
       CAST(total_price AS DOUBLE) AS total_price,
       CAST(total_price_after_taxes AS DOUBLE) AS total_price_after_taxes
FROM """
