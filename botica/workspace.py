"""Folders for intermediate tables, on storage that every executor can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_marked: set[str] = set()
_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """The folder of this application; it goes when the driver's JVM ends."""
    folder = f"{shared_root(spark)}/botica/{spark.sparkContext.applicationId}"
    if folder not in _marked:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing folder path below the application's folder."""
    folder = f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    scope = _scope.get()
    if scope is not None:
        scope.append(folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the folders made inside the block at its end, also when it fails."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for folder in made:
            remove_folder(spark, folder)
