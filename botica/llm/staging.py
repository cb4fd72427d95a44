"""Written intermediate tables whose rows have numbers that survive a lost executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from botica.workspace import new_folder

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Gives this package to the Python workers, which may run in any folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def widened(df: DataFrame, ddl: str) -> StructType:
    """The frame's schema and further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: cut from its lineage and read only."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, label: str, row: str = "row") -> DataFrame:
    """The frame as a written table with a unique long for each row.

    The number joins the written file's number and the row's place in the file, so
    that it stays the same however often, and wherever, the rows are read again.
    """
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-", 1).cast("long")
    number = F.shiftleft(file, 40) + F.col("_metadata.row_index")
    stored = written(df, label)
    return stored.select("*", number.alias(row))


def as_read(df: DataFrame) -> DataFrame | None:
    """``place`` (file and number in it) and ``document`` of each row of files read as they are.

    Such rows are told apart without a copy of them, however often they are read again.
    None for any other frame, in which a row of a file may stand several times; a read
    that names one file twice is not for this.
    """
    if not df._jdf.queryExecution().analyzed().children().isEmpty() or "_metadata" in df.columns:
        return None
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        return df.select(place.alias("place"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("document"))
    except AnalysisException:
        # Rows in memory, or files whose rows Spark does not number.
        return None


def beside(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text, as one that no name can clash with: ``rest``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return F.struct(F.lit(True).alias("_"), *(c.alias(f"c{k}") for k, c in enumerate(others))).alias("rest")


def restored(df: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` from ``text`` and ``rest``."""
    others = iter(range(len(docs.columns)))
    return df.select(
        *(F.col("text").alias(c) if c == text_col else F.col(f"rest.c{next(others)}").alias(c) for c in docs.columns)
    )


# Written files whose row counts are sent to every task; beyond it they are joined.
FEW_FILES = 100_000


def dense(df: DataFrame, row: str, number: str) -> DataFrame:
    """Adds ``number``: 0, 1, 2, ... in the order of ``row``, made by ``numbered``.

    Only the row counts of the written files meet in one place.
    """
    from pyspark.sql import Window

    file = F.shiftright(row, 40)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(df.groupBy(file.alias("file_no")).agg(F.count("*").alias("file_rows")), "file-rows")
    start = F.coalesce(F.sum("file_rows").over(before), F.lit(0)).alias("file_start")
    starts = counts.select("file_no", start)
    if counts.count() <= FEW_FILES:
        starts = F.broadcast(starts)
    place = F.col(row).bitwiseAND(F.lit((1 << 40) - 1))
    return (
        df.withColumn("file_no", file)
        .join(starts, "file_no")
        .withColumn(number, F.col("file_start") + place)
        .drop("file_no", "file_start")
    )
