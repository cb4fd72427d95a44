"""Tables that are replaced as a whole while others read them.

Each version lies in a folder of its own with a number; an empty file names it as
published once it is complete. Nothing is renamed and no file is ever overwritten, so this
holds on object stores too. Readers take the highest published number once and stay with
its files, which go only a while after a newer version came.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from botica.sinks.files import claim_file, drop_folder, newest_file, numbered_folders, written_at
from botica.sources.tables import DEFAULT_FORMAT, read_table

# How long a version that was replaced, or never finished, is kept for those who use it.
KEEP = timedelta(days=1)
_CLAIMED, _PUBLISHED, _VERSION = "_claimed-", "_published-", "version-"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published versions, oldest first."""
    return numbered_folders(spark, path, _PUBLISHED)


def current_version(spark: SparkSession, path: str) -> int | None:
    """The number of the version that a reader gets now; None if none is published."""
    return (versions(spark, path) or [None])[-1]


def version_folder(path: str, number: int) -> str:
    return f"{path}/{_VERSION}{number}"


def read_version(
    spark: SparkSession, path: str, number: int | None = None, fmt: str = DEFAULT_FORMAT
) -> DataFrame:
    """A published version, the current one by default; ``LookupError`` if there is none."""
    published = versions(spark, path)
    if not published or (number is not None and number not in published):
        raise LookupError(f"{path} has no version{'' if number is None else f' {number}'}")
    return read_table(spark, version_folder(path, published[-1] if number is None else number), fmt)


def publish_version(
    df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT, keep: timedelta = KEEP
) -> int:
    """Stores the frame as the table's next version and returns its number.

    The frame may read earlier versions. A number is claimed before it is written to, so
    that two writers never share a folder; of two at work, the higher number counts.
    What breaks off before the last step leaves the former version in place.
    """
    spark = df.sparkSession
    number = max([0, *numbered_folders(spark, path, _CLAIMED), *versions(spark, path)]) + 1
    while not claim_file(spark, f"{path}/{_CLAIMED}{number}"):
        number += 1
    df.write.format(fmt).mode("errorifexists").save(version_folder(path, number))
    if not claim_file(spark, f"{path}/{_PUBLISHED}{number}"):
        raise FileExistsError(f"version {number} of {path} is published already")
    _tidy(spark, path, number, keep)
    return number


def _tidy(spark: SparkSession, path: str, newest: int, keep: timedelta) -> None:
    """Removes what was replaced, or left unfinished, longer ago than ``keep``.

    Ages are measured by the files' own times: now is when the newest was published.
    """
    published = versions(spark, path)
    before = written_at(spark, f"{path}/{_PUBLISHED}{newest}") - keep
    for number, successor in zip(published, published[1:], strict=False):
        if written_at(spark, f"{path}/{_PUBLISHED}{successor}") <= before:
            # No longer found by readers first, then gone.
            drop_folder(spark, f"{path}/{_PUBLISHED}{number}")
            drop_folder(spark, version_folder(path, number))
    # A writer at work has a young claim, or young files.
    claims = set(numbered_folders(spark, path, _CLAIMED))
    old = {n for n in claims if n < newest and written_at(spark, f"{path}/{_CLAIMED}{n}") <= before}
    kept = {newest, *versions(spark, path), *(claims - old)}
    for number in numbered_folders(spark, path, _VERSION):
        folder = version_folder(path, number)
        if number not in kept and newest_file(spark, folder) <= before:
            drop_folder(spark, folder)
    for number in old:
        drop_folder(spark, f"{path}/{_CLAIMED}{number}")


def record_version(spark: SparkSession, path: str, record: str, name: str) -> int:
    """The table's version noted under a name in a folder; notes the current one if none is.

    Work that is repeated under the same name gets the version of its first time.
    """
    noted = numbered_folders(spark, record, f"{name}-")
    if noted:
        return noted[0]
    number = current_version(spark, path)
    if number is None:
        raise LookupError(f"{path} has no version")
    claim_file(spark, f"{record}/{name}-{number}")
    return number

