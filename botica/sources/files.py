"""Delimited files: price lists and ERP extracts."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from botica.functions.money import clamp_fraction, line_total, to_fraction
from botica.functions.numbers import decimal_of, int_of
from botica.functions.timing import TIMESTAMP_FORMAT, timestamp_of
from botica.operators.pricing import SALES_COLUMNS, price_lines
from botica.operators.quality import check_fields
from botica.schemas import CORRUPT_COLUMN, ERP_SCHEMA, MONEY
from botica.sources.tables import as_pattern
from botica.workspace import new_folder

# Fixed value: stands in where the catalog does not know the product.
UNKNOWN_INDUSTRY = "UNKNOWN"


def with_corrupt_column(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(CORRUPT_COLUMN, StringType())])


def read_typed_csv(
    spark: SparkSession, path: str, schema: StructType, header: bool = True
) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .csv(path)
    )


def read_semicolon_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, named by the header."""
    return spark.read.option("delimiter", ";").option("header", True).csv(path)


def read_checked_semicolon_csv(spark: SparkSession, path: str) -> DataFrame:
    """As above; lines that do not fit the header are kept whole in ``_corrupt_record``."""
    names = read_semicolon_csv(spark, path).schema
    return (
        spark.read.schema(with_corrupt_column(names))
        .option("delimiter", ";")
        .option("header", True)
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .option("columnPruning", False)
        .csv(path)
    )


def read_checked_csv(
    spark: SparkSession, path: str | list[str], schema: StructType, header: bool = True
) -> DataFrame:
    """Typed rows; lines that do not fit the schema are kept whole in ``_corrupt_record``.

    Column pruning is off: a line's field count is only checked when all fields are read.
    """
    return (
        spark.read.schema(with_corrupt_column(schema))
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .option("columnPruning", False)
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .csv(path)
    )


# Columns without which an extract cannot become sales.
ERP_REQUIRED = (
    "transaction_id", "sale_datetime", "product_id", "product_name", "quantity", "unit_price",
    "total_price", "discount_applied",
)
PROBLEM_COLUMN, FILE_COLUMN = "_problem", "_file"
ERP_NAMES = ERP_SCHEMA.fieldNames()


# What Spark says when a file is not there, or cannot be read to its end.
_UNREADABLE = ("FAILED_READ_FILE", "PATH_NOT_FOUND")
_NOT_READ = "the file cannot be read"


def _store_lines(spark: SparkSession, paths: Sequence[str], folder: str) -> None:
    """The lines that are not blank: text, the file as Spark names it, and place."""
    lines = spark.read.option("recursiveFileLookup", True).text(list(paths))
    lines.filter(F.col("value").rlike(r"[^\x00-\x20]")).select(
        "value",
        F.col("_metadata.file_path").alias(FILE_COLUMN),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    ).write.option("compression", "zstd").parquet(folder)


def _stored_lines(spark: SparkSession, files: Sequence[str]) -> tuple[list[str], list[str]]:
    """Folders of the lines of all files, and the files that cannot be read.

    Only where a read fails are the files halved, to tell which of them it is.
    """
    folder = new_folder(spark, "erp-lines")
    try:
        _store_lines(spark, [as_pattern(f) for f in files], folder)
    except (PySparkException, Py4JJavaError) as error:
        if not any(name in str(error) for name in _UNREADABLE):
            raise
        if len(files) == 1:
            return [], list(files)
        parts = [_stored_lines(spark, half) for half in (files[: len(files) // 2], files[len(files) // 2 :])]
        return [f for folders, _ in parts for f in folders], [f for _, lost in parts for f in lost]
    return [folder], []


def _names(header: str) -> list[str]:
    return [trim_name(name) for name in next(csv.reader([header]), [])]


def _lacking(names: list[str]) -> list[str]:
    return [c for c in ERP_REQUIRED if names.count(c) != 1]


def _places(header: str) -> tuple[Column, Column]:
    """How many fields the lines under a header have, and at which of them the needed ones lie.

    Both are NULL where the header lacks a required column.
    """
    names = _names(header)
    if _lacking(names):
        return F.lit(None).cast("int"), F.lit(None).cast("array<int>")
    wanted = {n: k for k, n in enumerate(names) if n in ERP_NAMES}
    return F.lit(len(names)), F.array(*[F.lit(wanted.get(c)).cast("int") for c in ERP_NAMES])


def _read_line(header: str) -> Column:
    """A line's needed fields, its corrupt text and problem, by one file header."""
    names = _names(header)
    missing = _lacking(names)
    nothing = F.lit(None).cast("string")

    def row(fields: list[Column], torn: Column, problem: Column) -> Column:
        return F.struct(
            F.struct(*[f.alias(c) for f, c in zip(fields, ERP_NAMES, strict=True)]).alias("fields"),
            torn.alias("torn"),
            problem.alias("problem"),
        )

    if missing:
        reason = F.lit(f"the header must have each of these once: {', '.join(missing)}")
        return row([nothing] * len(ERP_NAMES), F.col("value"), reason)
    wanted = {n: k for k, n in enumerate(names) if n in ERP_NAMES}
    layout = ", ".join(f"{c} string" for c in [*(f"_{k}" for k in range(len(names))), CORRUPT_COLUMN])

    def named(read: Column) -> Column:
        torn = read[CORRUPT_COLUMN]
        found = [read[f"_{wanted[c]}"] if c in wanted else nothing for c in ERP_NAMES]
        return row(found, torn, F.when(torn.isNotNull(), "the line does not fit its header"))

    # As the element of an array a line is parsed once, not once for each field that is taken from it.
    read = F.from_csv("value", layout, {"columnNameOfCorruptRecord": CORRUPT_COLUMN})
    return F.transform(F.array(read), named)[0]


def _parsed(lines: DataFrame, known: Sequence[str]) -> DataFrame:
    """The fields of lines that have the number of their header, ``_kind``, with its ``_count`` and ``_places``.

    A line without a quote that has as many fields as its header is cut at its commas, which
    gives what the CSV parser gives and is much faster; the parser reads the others.
    """
    cut = F.when(~F.contains("value", F.lit('"')), F.split("value", ","))
    rows = lines.select(FILE_COLUMN, "value", "_kind", "_count", "_places", cut.alias("_cut"))
    read = F.lit(None)
    for kind, header in enumerate(known):
        read = F.when(F.col("_kind") == kind, _read_line(header)).otherwise(read)
    fits = F.size("_cut") == F.col("_count")
    rows = rows.select(FILE_COLUMN, "_cut", "_places", fits.alias("_fits"), F.when(~F.coalesce(fits, F.lit(False)), read).alias("_read"))
    fields = [
        F.when(F.col("_fits"), F.nullif(F.get("_cut", F.col("_places")[k]), F.lit(""))).otherwise(F.col(f"_read.fields.{c}")).alias(c)
        for k, c in enumerate(ERP_NAMES)
    ]
    return rows.select(
        *fields,
        F.col("_read.torn").alias(CORRUPT_COLUMN),
        F.col("_read.problem").alias(PROBLEM_COLUMN),
        FILE_COLUMN,
    )


def read_erp_files(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """ERP extracts as text, each column found by the name in its file's own header.

    ``files`` are files or folders, by their plain names: no character of theirs is a
    pattern. Columns may come in any order, and others may lie between them; a column
    that is not needed and missing is NULL. A line that does not fit its header, and every
    line of a file whose header lacks or repeats a required column, has its whole text in
    ``_corrupt_record`` and the reason in ``_problem``; a file that cannot be read is one
    row with a problem. ``_file`` is where a row came from. Blank lines are no rows.

    The files are read once, as lines; a header is the first line of its file, found on the
    stored lines. The driver holds the distinct headers, not the names of files.
    """
    folders, lost = _stored_lines(spark, files)
    names = [*ERP_NAMES, CORRUPT_COLUMN, PROBLEM_COLUMN, FILE_COLUMN]
    schema = ", ".join(f"{c} string" for c in names)
    gone = spark.createDataFrame([(*[None] * (len(names) - 2), _NOT_READ, f) for f in lost], schema)
    if not folders:
        return gone
    lines = spark.read.parquet(*folders)
    # Places of the lines of one file ascend; those of different folders are never compared.
    first = lines.filter("_start = 0").groupBy(FILE_COLUMN).agg(F.min(F.struct("_place", "value")).alias("_first"))
    headers = first.select(FILE_COLUMN, "_first._place", F.col("_first.value").alias("_header"))
    folder = new_folder(spark, "erp-headers")
    headers.write.parquet(folder)
    headers = spark.read.parquet(folder)
    known = [row["_header"] for row in headers.select("_header").distinct().collect()]
    if not known:
        return gone
    kind, count, places = (F.lit(None).cast(t) for t in ("int", "int", "array<int>"))
    for k, header in enumerate(known):
        its = F.col("_header") == header
        kind, count, places = (
            F.when(its, value).otherwise(rest)
            for value, rest in zip((F.lit(k), *_places(header)), (kind, count, places), strict=True)
        )
    # Worked out for each file, not for each line.
    headers = headers.select(
        FILE_COLUMN, F.col("_place").alias("_at"), kind.alias("_kind"), count.alias("_count"), places.alias("_places")
    )
    rows = _parsed(lines.join(headers, FILE_COLUMN).filter("_place != _at"), known)
    return rows.unionByName(gone) if lost else rows


def trim_name(name: str) -> str:
    return name.lstrip("\ufeff").strip()


def check_erp(rows: DataFrame) -> DataFrame:
    """``quality.check_fields`` of rows read by ``read_erp_files``."""
    amounts = ("unit_price", "total_price", "discount_applied")
    parsers = {"sale_datetime": timestamp_of, "quantity": int_of}
    parsers |= {f: lambda t: decimal_of(t, 2) for f in amounts}
    return check_fields(
        rows,
        ("transaction_id", "product_id", "product_name", "sale_datetime", "quantity", "unit_price"),
        ("transaction_id", "product_id", "product_name"),
        parsers,
        F.col(PROBLEM_COLUMN),
    )


def erp_lines(extract: DataFrame, catalog: DataFrame) -> DataFrame:
    """ERP rows with industry and tax from the catalog, the columns that ``price_erp_lines`` needs.

    A product that the catalog does not have keeps its row.
    """
    known = catalog.select(
        F.col("id").alias("product_id"), F.col("industry_name"), F.col("taxes_price")
    )
    return (
        extract.select(*ERP_REQUIRED)
        .join(known, "product_id", "left")
        .withColumn("industry_name", F.coalesce("industry_name", F.lit(UNKNOWN_INDUSTRY)))
        .withColumn("taxes_price", F.coalesce("taxes_price", F.lit(0).cast(MONEY)))
    )


def price_erp_lines(lines: DataFrame) -> DataFrame:
    """Sales of lines made by ``erp_lines``, each from its own row alone.

    The extract states the discount of the whole line as an amount, and its total. Both
    totals of a sale follow from those, the second by adding the taxes; the fact's
    fraction and unit amounts are derived.
    """
    gross = F.col("unit_price") * F.col("quantity")
    fraction = F.when(gross > 0, to_fraction(F.col("discount_applied"), gross))
    stated = F.coalesce("total_price", gross - F.coalesce("discount_applied", F.lit(0).cast(MONEY))).cast(MONEY)
    taxes = line_total(F.col("quantity"), F.col("taxes_price"))
    others = [c for c in lines.columns if c not in ("total_price", "discount_applied")]
    sales = lines.select(
        F.col("transaction_id").alias("cart_id"),
        *others,
        clamp_fraction(fraction).alias("discount_applied"),
        stated.alias("_stated_total"),
    )
    return (
        price_lines(sales)
        .withColumn("total_price", F.col("_stated_total"))
        .withColumn("total_price_after_taxes", (F.col("_stated_total") + taxes).cast(MONEY))
        .select(*SALES_COLUMNS)
    )


def erp_to_sales(extract: DataFrame, catalog: DataFrame) -> DataFrame:
    """ERP rows as sales, matched by column name and completed from the catalog."""
    return price_erp_lines(erp_lines(extract, catalog))
