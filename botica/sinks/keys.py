"""The ids of a table, kept by bucket beside it, so that a batch reads those of its own buckets.

The index follows from the table's files alone: each use first adds the ids of the files
that came since the last one. So a writer that breaks off anywhere leaves nothing to
repair, and no append has to write two places at once. Files are named as covered only
after their ids are stored; ids that are stored twice do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botica.sinks.files import create_file, data_files, drop_folder, names_in, numbered_folders
from botica.sources.tables import as_pattern

# A folder that Spark's readers of the table pass over.
INDEX_FOLDER = "_ids"
BUCKET = "id_bucket"
# Buckets of a new index; each index keeps the number that it was made with.
DEFAULT_BUCKETS = 256
# Additions after which an index is made anew, in few files: its cost is spread over them.
MOST_ADDITIONS = 64
_BUCKETS_MARK = "_buckets-"


def id_bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _index_folder(path: str, generation: int) -> str:
    return f"{path}/{INDEX_FOLDER}/{generation}"


def _buckets(spark: SparkSession, folder: str) -> int:
    marks = [n for n in names_in(spark, folder) if n.startswith(_BUCKETS_MARK)]
    return int(marks[0].removeprefix(_BUCKETS_MARK))


def _covered(spark: SparkSession, folder: str) -> set[str]:
    """The names of the files whose ids an index has; as many as a reader of the table lists."""
    return {row["value"] for row in spark.read.text(f"{folder}/covered/*").collect()}


def _add(spark: SparkSession, folder: str, ids: DataFrame, column: str, files: set[str], addition: int) -> None:
    buckets = _buckets(spark, folder)
    (
        ids.select(column, id_bucket(column, buckets).alias(BUCKET))
        .hint("rebalance", BUCKET)
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy(BUCKET)
        .parquet(f"{folder}/keys")
    )
    names = spark.createDataFrame([(name,) for name in sorted(files)], "value string")
    names.coalesce(1).write.mode("overwrite").text(f"{folder}/covered/{addition}")


def _complete(spark: SparkSession, path: str) -> list[int]:
    """The indexes that were finished once, oldest first."""
    made = numbered_folders(spark, f"{path}/{INDEX_FOLDER}")
    return [g for g in made if numbered_folders(spark, f"{_index_folder(path, g)}/covered")]


def bring_up_to_date(
    spark: SparkSession, path: str, column: str, buckets: int = DEFAULT_BUCKETS, most_additions: int = MOST_ADDITIONS
) -> str:
    """The folder of the table's index, which then covers all its files.

    Only the ids of files that are not covered yet are read. After ``most_additions``, or
    when a covered file has left the table, the index is made anew from the table's ids.
    The one before the newest stays, for plans that read it.
    """
    files, complete = data_files(spark, path), _complete(spark, path)
    if complete:
        folder = _index_folder(path, complete[-1])
        additions = numbered_folders(spark, f"{folder}/covered")
        covered = _covered(spark, folder)
        if covered <= files and len(additions) <= most_additions:
            new = files - covered
            if new:
                added = [as_pattern(f"{path}/{name}") for name in sorted(new)]
                ids = spark.read.schema(f"`{column}` string").parquet(*added)
                _add(spark, folder, ids, column, new, additions[-1] + 1)
            return folder
    made = numbered_folders(spark, f"{path}/{INDEX_FOLDER}")
    folder = _index_folder(path, made[-1] + 1 if made else 0)
    create_file(spark, f"{folder}/{_BUCKETS_MARK}{buckets}")
    _add(spark, folder, spark.read.parquet(path).select(column), column, files, 0)
    for generation in made:
        if generation not in complete[-1:]:
            drop_folder(spark, _index_folder(path, generation))
    return folder


def _hit(batch: DataFrame, column: str, buckets: int) -> list[int]:
    return [row[BUCKET] for row in batch.select(id_bucket(column, buckets).alias(BUCKET)).distinct().collect()]


def ids_near(
    batch: DataFrame, path: str, column: str, buckets: int = DEFAULT_BUCKETS, most_additions: int = MOST_ADDITIONS
) -> DataFrame:
    """Of a table's ids those in the buckets of a batch; all ids that the batch has are among them.

    The batch's buckets, at most as many as the index has, are found from its ids alone. A batch
    that hits more than half of them gets all ids, from the table's own files: an index would
    spare it little, so that none is made or brought up to date for it.
    """
    spark = batch.sparkSession
    complete = _complete(spark, path)
    made_with = _buckets(spark, _index_folder(path, complete[-1])) if complete else buckets
    hit = _hit(batch, column, made_with)
    if len(hit) > made_with // 2:
        return spark.read.schema(f"`{column}` string").parquet(path).select(column)
    folder = bring_up_to_date(spark, path, column, buckets, most_additions)
    if _buckets(spark, folder) != made_with:
        hit = _hit(batch, column, _buckets(spark, folder))
    keys = spark.read.schema(f"`{column}` string, {BUCKET} int").parquet(f"{folder}/keys")
    return keys.filter(F.col(BUCKET).isin(hit)).select(column)
