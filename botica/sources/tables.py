from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DEFAULT_FORMAT = "parquet"


def read_table(
    spark: SparkSession, path: str, fmt: str = DEFAULT_FORMAT, schema: StructType | None = None
) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def table_exists(spark: SparkSession, path: str, fmt: str = DEFAULT_FORMAT) -> bool:
    """Whether the folder holds a file, below any subfolder; hidden ones don't count."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return False
    found = files.listFiles(target, True)
    while found.hasNext():
        if not found.next().getPath().getName().startswith(("_", ".")):
            return True
    return False


def rows_to_table(spark: SparkSession, rows: Iterable, schema: StructType) -> DataFrame:
    """A few rows typed in by hand; every value is verified against the schema."""
    return spark.createDataFrame(rows, schema, verifySchema=True)


def number_range(spark: SparkSession, low: int, high: int) -> DataFrame:
    return spark.range(low, high)


def as_pattern(path: str) -> str:
    """A path that stands for itself where readers take patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)
