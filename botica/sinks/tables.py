from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from botica.operators.quality import enforce_schema
from botica.operators.reports import newest
from botica.schemas import SALES_SCHEMA
# Some of these are used by others from here.
from botica.sinks.files import (  # noqa: F401
    create_file,
    data_files,
    drop_folder,
    file_system,
    names_in,
    newest_file,
    numbered_folders,
)
from botica.sinks.files import rename as _rename
from botica.sinks.keys import ids_near
from botica.sources.tables import DEFAULT_FORMAT, as_pattern, read_table, table_exists

# Partition column of the sales fact: the first day of the sale's period. A period
# should fill at least some files: "day" suits large daily volumes.
SALES_PARTITION = "sale_period"
DEFAULT_PERIOD = "month"
# Notes the period in the name of an empty file of the fact's folder.
_PERIOD_MARK = "_period-"
# Fixed value: where Spark puts rows whose partition column is NULL.
_NO_PERIOD = "__HIVE_DEFAULT_PARTITION__"


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def write_new(df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT) -> None:
    """Fails if the target exists."""
    df.write.format(fmt).mode("errorifexists").save(path)


def overwrite_table(
    df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT, options: dict[str, str] | None = None
) -> None:
    """Replaces a table; the plan may read the table it replaces.

    Plain files are written next to the target and renamed into place once
    complete, so no reader sees a half-written table; if that fails, the former table
    comes back. What a broken run left behind is removed. Delta does all that by itself.
    """
    writer = df.write.format(fmt).options(**(options or {}))
    if fmt == "delta":
        writer.mode("overwrite").save(path)
        return
    spark = df.sparkSession
    _tidy(spark, path)
    mark = uuid.uuid4().hex
    staged, former = f"{path}__new_{mark}", f"{path}__old_{mark}"
    try:
        writer.mode("errorifexists").save(staged)
    except Exception:
        drop_folder(spark, staged)
        raise
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        _rename(spark, staged, path)
        return
    _rename(spark, path, former)
    try:
        _rename(spark, staged, path)
    except Exception:
        _rename(spark, former, path)
        drop_folder(spark, staged)
        raise
    drop_folder(spark, former)


def _tidy(spark: SparkSession, path: str) -> None:
    """Removes what a run that broke off left beside a table, or brings the table back."""
    fs, target = file_system(spark, path)
    parent, name = str(target.getParent()), target.getName()
    for left in names_in(spark, parent):
        if left.startswith(f"{name}__old_") and not fs.exists(target):
            _rename(spark, f"{parent}/{left}", path)
        elif left.startswith((f"{name}__new_", f"{name}__old_")):
            drop_folder(spark, f"{parent}/{left}")


def overwrite_raw_names(df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT) -> None:
    """Overwrites a table whose column names hold blanks and punctuation."""
    options = {"delta.columnMapping.mode": "name"} if fmt == "delta" else None
    overwrite_table(df, path, fmt, options)


def _with_period(sales: DataFrame, period: str) -> DataFrame:
    return sales.withColumn(SALES_PARTITION, F.date_trunc(period, "sale_datetime").cast("date"))


def _refuse_other_period(spark: SparkSession, path: str, period: str) -> None:
    noted = [n.removeprefix(_PERIOD_MARK) for n in names_in(spark, path) if n.startswith(_PERIOD_MARK)]
    if noted and noted != [period]:
        raise ValueError(f"{path} is partitioned by {noted[0]}, not by {period}")


class LostRows(RuntimeError):
    """What a table holds after a write is not what was written."""


def _digest() -> list[Column]:
    """Rows, both totals and a sum over keys, whatever the order of the rows."""
    key = F.xxhash64("transaction_id", "product_id", "quantity").cast("decimal(38,0)")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum("total_price").alias("total_price"),
        F.sum("total_price_after_taxes").alias("total_price_after_taxes"),
        F.sum(key).alias("keys"),
    ]


def append_sales(
    sales: DataFrame,
    path: str,
    fmt: str = DEFAULT_FORMAT,
    period: str = DEFAULT_PERIOD,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Appends to the sales fact, which is partitioned by the period of the sale.

    Rebalancing gathers a period's rows into few files, while Spark splits a period
    that is too large for one task. The period is noted in the table's folder; another
    one is refused. The rows, totals and keys that go out are counted while they are
    written and compared with those of the files that are new after it, so that the batch
    is worked out once; a difference raises ``LostRows``. The names of the fact's files
    are listed for it, as every reader of plain files does. ``finish`` makes sales of rows
    that have at least a ``sale_datetime``, each of its own row alone; it is done after the
    rows are gathered, so that what it derives is not exchanged.
    """
    spark = sales.sparkSession
    _refuse_other_period(spark, path, period)
    if finish:
        gathered = finish(_with_period(sales, period).hint("rebalance", SALES_PARTITION))
        checked = _with_period(enforce_schema(gathered, SALES_SCHEMA), period)
    else:
        checked = _with_period(enforce_schema(sales, SALES_SCHEMA), period).hint("rebalance", SALES_PARTITION)
    before = data_files(spark, path)
    sent = Observation("sales sent")
    (
        checked.observe(sent, *_digest())
        .write.format(fmt)
        .option("compression", "zstd")
        .mode("append")
        .partitionBy(SALES_PARTITION)
        .save(path)
    )
    create_file(spark, f"{path}/{_PERIOD_MARK}{period}")
    if fmt != "delta":
        check_written(spark, path, data_files(spark, path) - before, sent.get, fmt)


def check_written(
    spark: SparkSession, path: str, names: set[str], sent: dict[str, object], fmt: str = DEFAULT_FORMAT
) -> None:
    """Raises ``LostRows`` where the named files of a table do not hold what was sent."""
    files = [as_pattern(f"{path}/{name}") for name in sorted(names)]
    stored = spark.read.format(fmt).schema(SALES_SCHEMA).load(files) if files else spark.createDataFrame([], SALES_SCHEMA)
    found = stored.agg(*_digest()).first().asDict()
    if found != sent:
        raise LostRows(f"{path}: sent {sent}, found {found}")


def read_sales(spark: SparkSession, path: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    return read_table(spark, path, fmt)


def newest_sales(
    spark: SparkSession, path: str, rows: int, fmt: str = DEFAULT_FORMAT
) -> DataFrame:
    """The fact's newest rows, reading only the periods that can hold them.

    Periods are counted from the newest down, twice as many each time, until they hold
    enough rows; counting reads no column. Rows without a time lie in a period of their
    own, which comes last.
    """
    sales = read_sales(spark, path, fmt)
    found = (n.removeprefix(f"{SALES_PARTITION}=") for n in names_in(spark, path) if n.startswith(f"{SALES_PARTITION}="))
    periods = sorted((p for p in found if p != _NO_PERIOD), reverse=True)
    taken = 1
    while True:
        wanted = [F.lit(p).cast("date") for p in periods[:taken]]
        recent = sales.filter(F.col(SALES_PARTITION).isin(*wanted)) if wanted else sales
        if taken >= len(periods):
            # All dated periods: those without a time may be needed too.
            return newest(sales.drop(SALES_PARTITION), rows)
        if recent.limit(rows).count() >= rows:
            return newest(recent.drop(SALES_PARTITION), rows)
        taken *= 2


def first_per_transaction(sales: DataFrame) -> DataFrame:
    """One row per transaction: the one with the smallest quantity, then total.

    Spark cuts each task's rows to one per transaction before the shuffle.
    """
    first = ["quantity", "total_price_after_taxes", "sale_datetime", "product_id"]
    rest = [c for c in sales.columns if c not in ("transaction_id", *first)]
    order = Window.partitionBy("transaction_id").orderBy(*first, *rest)
    return (
        sales.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def _known_ids(sales: DataFrame, path: str, fmt: str) -> DataFrame | None:
    """The fact's ids among which are all that the batch has; None where there is no fact."""
    spark = sales.sparkSession
    if not table_exists(spark, path, fmt):
        return None
    if fmt == "parquet":
        return ids_near(sales, path, "transaction_id")
    return read_sales(spark, path, fmt).select("transaction_id")


def _without_known(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    return batch if known is None else batch.join(known, "transaction_id", "left_anti")


def new_sales(sales: DataFrame, path: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    """The batch's transactions that the sales fact does not have yet.

    A transaction is known by its id alone, whatever time it is delivered with. Of a fact
    in Parquet files only the ids in the batch's buckets are read, from an index
    kept with it (``sinks/keys.py``); of another format, all ids.
    """
    return _without_known(first_per_transaction(sales), _known_ids(sales, path, fmt))


def _all_new(sales: DataFrame, known: DataFrame | None) -> bool:
    """Whether no id comes twice in a batch, or is known; False also where two ids share a hash.

    Of a row nothing but the hash of its id is exchanged.
    """
    number = F.xxhash64("transaction_id").alias("number")
    ids = sales.select(number, F.lit(False).alias("seen"))
    if known is not None:
        ids = ids.unionByName(known.select(number, F.lit(True).alias("seen")))
    # Dealt first: sums of numbers that hardly repeat would only fill memory before the exchange.
    ids = ids.repartition("number").groupBy("number")
    counted = ids.agg(F.count_if(~F.col("seen")).alias("sent"), F.bool_or("seen").alias("seen"))
    return counted.filter((F.col("sent") > 1) | ((F.col("sent") > 0) & F.col("seen"))).count() == 0


def _adopt(spark: SparkSession, staged: str, path: str, period: str) -> None:
    """Moves the files of a staged batch into the fact."""
    create_file(spark, f"{path}/{_PERIOD_MARK}{period}")
    for name in sorted(data_files(spark, staged)):
        fs, target = file_system(spark, f"{path}/{name}")
        fs.mkdirs(target.getParent())
        _rename(spark, f"{staged}/{name}", f"{path}/{name}")


def append_new_sales(
    sales: DataFrame,
    path: str,
    fmt: str = DEFAULT_FORMAT,
    period: str = DEFAULT_PERIOD,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Appends each transaction once, however often it is delivered.

    Plain files are first written next to the fact, by period, and their ids looked through.
    Where none repeats and none is known the files move into the fact as they are, so that
    the rows were exchanged once. Otherwise the rows that the batch has more than once or
    that the fact has are left out, and the others exchanged by their ids and appended. A run
    that breaks off while files move leaves a part of the batch, which the next delivery
    knows; what it left next to the fact goes with the next append. ``finish`` is that of
    ``append_sales``.
    """
    columns = SALES_SCHEMA.fieldNames()
    if fmt != "parquet":
        sales = finish(sales) if finish else sales
        append_sales(new_sales(sales, path, fmt).select(*columns), path, fmt, period)
        return
    spark = sales.sparkSession
    _refuse_other_period(spark, path, period)
    _, target = file_system(spark, path)
    parent, mark = target.getParent().toString(), f"{target.getName()}__batch_"
    for left in names_in(spark, parent):
        if left.startswith(mark):
            drop_folder(spark, f"{parent}/{left}")
    staged = f"{path}__batch_{uuid.uuid4().hex}"
    try:
        append_sales(sales if finish else sales.select(*columns), staged, fmt, period, finish)
        batch = spark.read.schema(SALES_SCHEMA).parquet(staged).select(*columns)
        known = _known_ids(batch, path, fmt)
        if _all_new(batch, known):
            _adopt(spark, staged, path, period)
        elif known is None or _without_known(batch.select("transaction_id"), known).count():
            append_sales(_without_known(first_per_transaction(batch), known).select(*columns), path, fmt, period)
    finally:
        drop_folder(spark, staged)
