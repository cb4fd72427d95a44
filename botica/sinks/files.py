"""Folders and files of tables, on whatever file system they are."""

from __future__ import annotations

from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is missing."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return []
    return [status.getPath().getName() for status in fs.listStatus(target)]


def numbered_folders(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """The numbers among the names in a folder, after a prefix, in order."""
    names = [n.removeprefix(prefix) for n in names_in(spark, path) if n.startswith(prefix)]
    return sorted(int(name) for name in names if name.isdigit())


def create_file(spark: SparkSession, path: str) -> None:
    """An empty file, made at once; one that exists stays."""
    fs, target = file_system(spark, path)
    fs.mkdirs(target.getParent())
    if not fs.exists(target):
        fs.create(target, False).close()


def claim_file(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False if it is there already, so that one of several callers gets it."""
    fs, target = file_system(spark, path)
    fs.mkdirs(target.getParent())
    try:
        fs.create(target, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def written_at(spark: SparkSession, path: str) -> datetime:
    """When a file was last written."""
    fs, target = file_system(spark, path)
    return datetime.fromtimestamp(fs.getFileStatus(target).getModificationTime() / 1000)


def newest_file(spark: SparkSession, path: str) -> datetime:
    """When a file of a folder was last written, by the driver's clock."""
    fs, target = file_system(spark, path)
    found, newest = fs.listFiles(target, True), 0
    while found.hasNext():
        newest = max(newest, found.next().getModificationTime())
    return datetime.fromtimestamp(newest / 1000)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, from_path = file_system(spark, source)
    if not fs.rename(from_path, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def data_files(spark: SparkSession, path: str) -> set[str]:
    """The files of a table that hold rows, by their names below it."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return set()
    names, found, root = set(), fs.listFiles(target, True), fs.resolvePath(target).toString()
    while found.hasNext():
        name = found.next().getPath().toString().removeprefix(root).lstrip("/")
        if not any(step.startswith(("_", ".")) for step in name.split("/")):
            names.add(name)
    return names
