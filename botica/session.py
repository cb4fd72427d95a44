"""Session settings for a given amount of shuffled data."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A shuffle partition of this size fits an executor core's share of memory.
PARTITION_BYTES = 256 << 20
# Fixed value: Spark's state store on local disks, with its log in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed value: the JVM interprets methods of more bytes than this, however often they run.
HUGE_METHOD_BYTES = 8000


def settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings that keep partitions in memory and let Spark split the hot ones.

    Adaptive execution merges partitions that turn out small but makes no more than
    the number it starts with, so that number follows the data.
    """
    wanted = -(-shuffle_bytes // PARTITION_BYTES)
    partitions = max(wanted, cores)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.shuffle.partitions": str(partitions),
        # What streams remember lies on disk, not in the heap.
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        # Wide rows of checks and formulas run operator by operator rather than interpreted.
        "spark.sql.codegen.hugeMethodLimit": str(HUGE_METHOD_BYTES),
    }


def builder(app: str, shuffle_bytes: int, cores: int) -> SparkSession.Builder:
    session = SparkSession.builder.appName(app)
    for name, value in settings(shuffle_bytes, cores).items():
        session = session.config(name, value)
    return session
