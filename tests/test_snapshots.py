from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from botica.schemas import DIM_PRODUCT_COLUMNS
from botica.sinks import snapshots
from botica.sinks.files import claim_file
from botica.sinks.snapshots import current_version, publish_version, read_version, record_version, versions
from botica.streaming.sales import stream_lines_at_current_prices

AT_ONCE = timedelta(0)


def numbers(df):
    return sorted(r["id"] for r in df.collect())


def test_readers_keep_the_version_they_began_with(spark, tmp_path):
    path = str(tmp_path / "numbers")
    assert publish_version(spark.range(5), path) == 1
    held = read_version(spark, path)
    assert publish_version(held.filter("id > 2"), path) == 2
    assert numbers(held) == [0, 1, 2, 3, 4]
    assert numbers(read_version(spark, path)) == [3, 4]
    assert numbers(read_version(spark, path, 1)) == [0, 1, 2, 3, 4]


def test_an_empty_frame_is_a_version(spark, tmp_path):
    path = str(tmp_path / "numbers")
    publish_version(spark.range(3), path)
    publish_version(spark.range(0), path)
    assert numbers(read_version(spark, path)) == []


def test_replaced_versions_go_after_their_time(spark, tmp_path):
    path = str(tmp_path / "numbers")
    for n in (1, 2, 3):
        publish_version(spark.range(n), path, keep=AT_ONCE)
    # The second was replaced when the third came; both of them were old then.
    assert versions(spark, path) == [3]
    assert sorted(p.name for p in tmp_path.joinpath("numbers").iterdir() if p.name.startswith("version-")) == ["version-3"]
    with pytest.raises(LookupError):
        read_version(spark, path, 1)


def test_a_broken_write_leaves_the_former_version(spark, tmp_path):
    path = str(tmp_path / "numbers")
    publish_version(spark.range(5), path)
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        publish_version(broken, path)
    assert numbers(read_version(spark, path)) == [0, 1, 2, 3, 4]
    assert publish_version(spark.range(2), path) == 3


def test_a_crash_before_the_last_step_publishes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "numbers")
    publish_version(spark.range(5), path)
    claim = snapshots.claim_file

    def crash(spark, name):
        if "_published-" in name:
            raise OSError("no")
        return claim(spark, name)

    monkeypatch.setattr(snapshots, "claim_file", crash)
    with pytest.raises(OSError):
        publish_version(spark.range(9), path)
    monkeypatch.undo()
    assert numbers(read_version(spark, path)) == [0, 1, 2, 3, 4]
    publish_version(spark.range(1), path)
    assert numbers(read_version(spark, path)) == [0]
    # What was left is young: it may be another writer's.
    assert tmp_path.joinpath("numbers", "version-2").exists()
    publish_version(spark.range(2), path, keep=AT_ONCE)
    assert not tmp_path.joinpath("numbers", "version-2").exists()


def test_a_number_is_claimed_once(spark, tmp_path):
    path = str(tmp_path / "numbers")
    assert claim_file(spark, f"{path}/_claimed-1")
    assert not claim_file(spark, f"{path}/_claimed-1")
    assert publish_version(spark.range(1), path) == 2


def test_nothing_published_is_not_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "numbers")
    assert current_version(spark, path) is None
    for read in (lambda: read_version(spark, path), lambda: record_version(spark, path, f"{path}-seen", "0")):
        with pytest.raises(LookupError):
            read()


def dimension(spark, price):
    known = {
        "id": "P1", "industry_name": "Lab", "substance_name": "water", "product_name": "Drops",
        "product_presentation": "10 ml", "unit_price": price, "unit_price_after_taxes": price,
    }
    return spark.createDataFrame(
        [[known.get(c, "-") for c in DIM_PRODUCT_COLUMNS]], ", ".join(f"{c} string" for c in DIM_PRODUCT_COLUMNS)
    )


def deliver(spark, folder, cart):
    row = f"'{cart}' cart_id, '{cart}' transaction_id, timestamp'2025-05-23 10:00:00' sale_datetime, 'P1' product_id"
    line = spark.sql(f"SELECT {row}, 2 quantity, cast(0 as decimal(9,4)) discount_applied")
    line.write.mode("append").parquet(f"{folder}/lines")
    lines = spark.readStream.schema(line.schema).parquet(f"{folder}/lines")
    stream_lines_at_current_prices(
        lines, f"{folder}/dimension", f"{folder}/sales", f"{folder}/unmatched", f"{folder}/checkpoint"
    ).awaitTermination()
    return {r["cart_id"]: str(r["total_price"]) for r in spark.read.parquet(f"{folder}/sales").collect()}


def test_each_batch_has_the_prices_of_its_time(spark, tmp_path):
    folder = str(tmp_path)
    publish_version(dimension(spark, "5,00"), f"{folder}/dimension")
    assert deliver(spark, folder, "A") == {"A": "10.00"}
    publish_version(dimension(spark, "7,00"), f"{folder}/dimension")
    assert deliver(spark, folder, "B") == {"A": "10.00", "B": "14.00"}


def test_a_batch_delivered_again_keeps_its_prices(spark, tmp_path):
    folder = str(tmp_path)
    publish_version(dimension(spark, "5,00"), f"{folder}/dimension")
    # The first try of the batch noted its version and was lost.
    assert record_version(spark, f"{folder}/dimension", f"{folder}/sales/_versions", "0") == 1
    publish_version(dimension(spark, "7,00"), f"{folder}/dimension")
    assert deliver(spark, folder, "A") == {"A": "10.00"}
    assert record_version(spark, f"{folder}/dimension", f"{folder}/sales/_versions", "1") == 2
