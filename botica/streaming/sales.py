from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from botica.operators.catalog import catalog_view
from botica.operators.pricing import enrich_lines, unmatched_lines
from botica.operators.quality import accepted, rejected
from botica.schemas import FILE_SCHEMA
from botica.sinks.snapshots import read_version, record_version
from botica.sinks.tables import append_new_sales
from botica.sources.files import check_erp, erp_lines, price_erp_lines, read_erp_files
from botica.sources.tables import DEFAULT_FORMAT
from botica.streaming.staging import staged_batches
from botica.workspace import scratch

# Which version of the dimension each batch was priced with; readers of the table pass over it.
VERSIONS_FOLDER = "_versions"


def stream_erp_sales(
    spark: SparkSession,
    landing: str,
    catalog: DataFrame,
    sales_path: str,
    rejected_path: str,
    checkpoint: str,
    fmt: str = DEFAULT_FORMAT,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Appends the extracts that arrived in a folder to the sales fact, each transaction once.

    The stream tells which files are new; they are read once, by their own headers and
    whatever their names. Rows that break a rule, and lines or files that cannot be read or
    mapped, go to the rejected table with their errors, so that no file stops the stream. A batch that is delivered again adds
    nothing: its transactions are known, and its rejected rows replace themselves.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            files = [row["path"] for row in batch.select("path").distinct().collect()]
            if not files:
                return
            # The lines are stored once, by the reader; they are checked again for each of the two tables.
            checked = check_erp(read_erp_files(spark, files))
            bad = rejected(checked)
            bad.write.format(fmt).mode("overwrite").save(f"{rejected_path}/batch_id={batch_id}")
            append_new_sales(erp_lines(accepted(checked), catalog), sales_path, fmt, finish=price_erp_lines)

    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
        .select("path")
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_enriched_lines(
    lines: DataFrame,
    catalog: DataFrame,
    path: str,
    unmatched_path: str,
    checkpoint: str,
    fmt: str = DEFAULT_FORMAT,
) -> StreamingQuery:
    """Prices a stream of lines against the stored catalog and stores them by batch.

    Lines that the catalog cannot price go to a table of their own.
    """

    return _enriched(lines, lambda batch_id: catalog, path, unmatched_path, checkpoint, fmt)


def stream_lines_at_current_prices(
    lines: DataFrame,
    dimension_path: str,
    path: str,
    unmatched_path: str,
    checkpoint: str,
    fmt: str = DEFAULT_FORMAT,
) -> StreamingQuery:
    """As above, each batch at the prices of the dimension's version that is current when it comes.

    The dimension is one of ``sinks/snapshots.py``. A batch notes its version beside its
    output before it is priced, so that a batch that is delivered again costs the same; one
    whose version is gone meanwhile raises ``LookupError`` instead of taking other prices.
    """
    spark = lines.sparkSession

    def catalog(batch_id: int) -> DataFrame:
        number = record_version(spark, dimension_path, f"{path}/{VERSIONS_FOLDER}", str(batch_id))
        return catalog_view(read_version(spark, dimension_path, number, fmt))

    return _enriched(lines, catalog, path, unmatched_path, checkpoint, fmt)


def _enriched(
    lines: DataFrame,
    catalog: Callable[[int], DataFrame],
    path: str,
    unmatched_path: str,
    checkpoint: str,
    fmt: str,
) -> StreamingQuery:
    def enrich(batch: DataFrame, batch_id: int) -> None:
        own, products = f"batch_id={batch_id}", catalog(batch_id)
        enrich_lines(batch, products).write.format(fmt).mode("overwrite").save(f"{path}/{own}")
        unmatched_lines(batch, products).write.format(fmt).mode("overwrite").save(f"{unmatched_path}/{own}")

    return (
        lines.writeStream.foreachBatch(staged_batches(lines.sparkSession, enrich, fmt))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
