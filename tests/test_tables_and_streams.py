from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from botica.operators import carts as c
from botica.operators.quality import accepted, enforce_schema, rejected, split_corrupt, split_lines
from botica.operators.searches import debounce_searches
from botica.schemas import (
    CART_EVENT_SCHEMA,
    CORRUPT_COLUMN,
    ERP_SCHEMA,
    PRICE_LIST_HEADERS,
    SALES_SCHEMA,
    SEARCH_SCHEMA,
)
from botica.sinks import keys
from botica.sinks import tables as sinks
from botica.sinks.refresh import is_stale, refresh_dimension, refresh_if_stale
from botica.sources import files
from botica.sources.tables import read_table, table_exists
from botica.streaming import carts as live
from botica.streaming import settling
from botica.streaming.sales import stream_erp_sales
from botica.streaming.searches import late_searches, live_searches, stream_debounced
from botica.streaming.settling import settle_batch
from botica.streaming.staging import staged_batches
from botica.workspace import new_folder
from tests.frames import START, at, events, money
from tests.test_sales import fold, random_events

ERP_HEADER = (
    "transaction_id,sale_datetime,product_id,product_name,quantity,unit_price,total_price,payment_method,"
    "employee_id,customer_id,prescription_id,is_prescription_item,discount_applied,loyalty_points_earned,"
    "store_location_id"
)
ERP_ROWS = [
    "A1,2025-05-23 10:00:00,P1,Tablets,2,5.50,11.00,Cash,E1,C1,,FALSE,0.00,10,L1",
    "A2,2025-05-23 10:05:30,P2,Plasters,1,8.75,8.75,Card,E2,,,,,L2",
    "A3,2025-05-23 10:15:10,P3,Capsules,1,25.00,22.50,Insurance,E1,C2,R9,TRUE,2.50,0,L1",
    "A4,2025-05-24 10:15:10,P1,Tablets,4,5.50,22.00,Cash,E1,C2,,FALSE,0.00,0,L1",
]


def sale(number, day=0, **changes):
    row = {
        "cart_id": "k",
        "transaction_id": str(number),
        "sale_datetime": START + timedelta(days=day),
        "industry_name": "lab",
        "product_id": "1",
        "product_name": "name",
        "unit_price": money("1.00"),
        "discount_applied": None,
        "liquid_price": money("1.00"),
        "taxes_price": money("0.10"),
        "liquid_price_after_taxes": money("1.10"),
        "quantity": 1,
        "total_price": money("1.00"),
        "total_price_after_taxes": money("1.10"),
    }
    return tuple((row | changes).values())


def sales(spark, *rows):
    return spark.createDataFrame(list(rows), SALES_SCHEMA)


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame(
        [("P1", "lab", money("0.50")), ("P3", "lab3", None)],
        "id string, industry_name string, taxes_price decimal(18,2)",
    )


# --- sinks ----------------------------------------------------------------------------


@pytest.mark.parametrize("period", ["day", "month"])
def test_append_is_idempotent(spark, tmp_path, period):
    path = str(tmp_path / "sales")
    first = sales(spark, sale(1), sale(2, 40), sale(2, 40, quantity=2))
    for batch in (first, first, sales(spark, sale(2, 40), sale(3, 1))):
        sinks.append_new_sales(batch, path, period=period)
    stored = sinks.read_sales(spark, path).collect()
    assert sorted(r["transaction_id"] for r in stored) == ["1", "2", "3"]
    assert {r["quantity"] for r in stored} == {1}


def test_a_corrected_time_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "sales")
    sinks.append_new_sales(sales(spark, *[sale(i, i) for i in range(5)]), path)
    fresh = sinks.new_sales(sales(spark, sale(2, 70), sale(9, 3)), path)
    assert [r["transaction_id"] for r in fresh.collect()] == ["9"]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<transaction_id:string>" in plan


def kept_ids(spark, folder):
    return spark.read.parquet(f"{folder}/keys")


def test_an_append_reads_only_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "sales")
    sinks.append_sales(sales(spark, *[sale(i, i % 90) for i in range(2000)]), path)
    batch = sales(spark, sale(7), sale(5000), sale(5001))
    near = keys.ids_near(batch, path, "transaction_id", buckets=100)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "id_bucket" in plan
    folder = keys.bring_up_to_date(spark, path, "transaction_id")
    stored = kept_ids(spark, folder)
    assert stored.select("id_bucket").distinct().count() == 100
    assert sorted(r[0] for r in stored.select("transaction_id").collect()) == sorted(str(i) for i in range(2000))
    hit = {r[0] for r in batch.select(keys.id_bucket("transaction_id", 100)).collect()}
    read = {f.split("id_bucket=")[1].split("/")[0] for f in near.inputFiles()}
    scanned = {r[0] for r in near.select(keys.id_bucket("transaction_id", 100)).distinct().collect()}
    assert scanned == hit and len(read) == 100  # inputFiles lists the table, the filter prunes it
    assert "7" in {r["transaction_id"] for r in near.collect()}
    assert sinks.read_sales(spark, path).count() == 2000


def test_the_index_follows_the_fact_after_broken_runs(spark, tmp_path):
    path = str(tmp_path / "sales")
    add = lambda *rows: sinks.append_new_sales(sales(spark, *rows), path)
    count = lambda: sinks.read_sales(spark, path).count()
    add(sale(1), sale(2))
    # Rows that came past the index, as of a writer that ended right after its append.
    sinks.append_sales(sales(spark, sale(3, 40)), path)
    add(sale(3, 40), sale(1), sale(4))
    assert count() == 4
    # Ids stored, but their files not named as covered: they are added once more.
    folder = keys.bring_up_to_date(spark, path, "transaction_id")
    last = keys.numbered_folders(spark, f"{folder}/covered")[-1]
    keys.drop_folder(spark, f"{folder}/covered/{last}")
    add(sale(4), sale(5))
    assert count() == 5
    # An index that was begun and not finished is passed over.
    keys.create_file(spark, f"{path}/_ids/9/_buckets-8")
    add(sale(5), sale(6))
    assert count() == 6


def test_the_index_is_made_anew(spark, tmp_path):
    path = str(tmp_path / "sales")
    folders = []
    for i in range(4):
        sinks.append_sales(sales(spark, sale(i, 40 * i)), path)
        folders.append(keys.bring_up_to_date(spark, path, "transaction_id", most_additions=2))
    assert folders[0] == folders[1] == folders[2] != folders[3]
    assert kept_ids(spark, folders[3]).count() == 4
    # A file that left the fact takes its ids along.
    gone = next(name for name in sorted(keys.data_files(spark, path)))
    keys.drop_folder(spark, f"{path}/{gone}")
    folder = keys.bring_up_to_date(spark, path, "transaction_id")
    assert folder != folders[3] and kept_ids(spark, folder).count() == 3
    assert sinks.new_sales(sales(spark, *[sale(i) for i in range(4)]), path).count() == 1


def test_a_batch_of_new_ids_is_not_dealt_by_id(spark, tmp_path, monkeypatch):
    path, dealt = str(tmp_path / "sales"), []
    original = sinks.first_per_transaction

    def first(batch):
        dealt.append(True)
        return original(batch)

    monkeypatch.setattr(sinks, "first_per_transaction", first)
    # What a broken run left beside the fact goes; another table's rows stay.
    sinks.append_sales(sales(spark, sale(1)), f"{path}__batch_left")
    sinks.append_sales(sales(spark, sale(1)), f"{path}_b")
    sinks.append_new_sales(sales(spark, *[sale(i, 20 * i) for i in range(30)]), path)
    sinks.append_new_sales(sales(spark, *[sale(i, 20 * i) for i in range(30, 60)]), path)
    assert not dealt
    # Nothing new, whatever the times: nothing is added.
    files_before = keys.data_files(spark, path)
    sinks.append_new_sales(sales(spark, *[sale(i, 3) for i in range(50)]), path)
    assert not dealt and keys.data_files(spark, path) == files_before
    sinks.append_new_sales(sales(spark, sale(59, 1), sale(60, 1, quantity=2), sale(60, 50)), path)
    assert dealt
    stored = {r["transaction_id"]: r["quantity"] for r in sinks.read_sales(spark, path).collect()}
    assert stored == {str(i): 1 for i in range(61)} and sinks.read_sales(spark, path).count() == 61
    assert sorted(p.name for p in tmp_path.iterdir()) == ["sales", "sales_b"]


def test_ids_repeated_in_the_fact_alone_are_none_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "sales")
    sinks.append_sales(sales(spark, sale(1), sale(1, 40)), path)
    sinks.append_new_sales(sales(spark, sale(2)), path)
    assert sorted(r["transaction_id"] for r in sinks.read_sales(spark, path).collect()) == ["1", "1", "2"]


def test_a_move_that_breaks_off_is_made_up_for(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sales")
    batch = sales(spark, *[sale(i, 40 * i) for i in range(4)])
    moved, rename = [], sinks._rename

    def broken(session, source, target):
        if len(moved) == 2:
            raise OSError("no")
        moved.append(target)
        rename(session, source, target)

    with monkeypatch.context() as patched:
        patched.setattr(sinks, "_rename", broken)
        with pytest.raises(OSError):
            sinks.append_new_sales(batch, path)
    assert sinks.read_sales(spark, path).count() == 2
    sinks.append_new_sales(batch, path)
    assert sorted(r["transaction_id"] for r in sinks.read_sales(spark, path).collect()) == ["0", "1", "2", "3"]


def test_a_large_batch_makes_no_index(spark, tmp_path):
    path = str(tmp_path / "sales")
    batch = sales(spark, *[sale(i) for i in range(1000)])
    sinks.append_sales(batch, path)
    assert keys.ids_near(batch, path, "transaction_id").count() == 1000
    assert "_ids" not in sinks.names_in(spark, path)
    assert keys.ids_near(sales(spark, sale(7)), path, "transaction_id").filter("transaction_id = '7'").count() == 1
    assert "_ids" in sinks.names_in(spark, path)


def test_what_finish_derives_is_not_exchanged(spark, tmp_path):
    seen, path = [], str(tmp_path / "sales")
    lines = sales(spark, sale(1), sale(2, 40)).drop("total_price")

    def finish(gathered):
        seen.append(gathered.columns)
        return gathered.withColumn("total_price", F.col("unit_price")).select(*SALES_SCHEMA.fieldNames())

    sinks.append_new_sales(lines, path, finish=finish)
    assert seen and "total_price" not in seen[0]
    assert sorted(map(tuple, sinks.read_sales(spark, path).drop("sale_period").collect())) == [sale(1), sale(2, 40)]


def test_another_period_is_refused(spark, tmp_path):
    path = str(tmp_path / "sales")
    sinks.append_new_sales(sales(spark, sale(1)), path, period="month")
    with pytest.raises(ValueError, match="partitioned by month"):
        sinks.append_new_sales(sales(spark, sale(2)), path, period="day")
    sinks.append_new_sales(sales(spark, sale(2)), path, period="month")
    assert sinks.read_sales(spark, path).count() == 2


def test_a_lost_file_is_noticed(spark, tmp_path, monkeypatch):
    path = tmp_path / "sales"
    sinks.append_sales(sales(spark, *[sale(i, i) for i in range(6)]), str(path))
    listed = sinks.data_files

    def lose_one(session, folder):
        # After the write, one of the files is gone; the names are those of the files that are there.
        names = listed(session, folder)
        return names if lose_one.first else names - {sorted(names - lose_one.known)[0]}

    lose_one.known, lose_one.first = listed(spark, str(path)), True
    original = sinks.create_file

    def after_write(session, file):
        lose_one.first = False
        original(session, file)

    monkeypatch.setattr(sinks, "data_files", lose_one)
    monkeypatch.setattr(sinks, "create_file", after_write)
    with pytest.raises(sinks.LostRows, match="sent .* found"):
        sinks.append_sales(sales(spark, sale(10, 1), sale(11, 50), sale(12, 90)), str(path))


def test_a_checked_append_works_out_its_rows_once(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            counted.add(batch.num_rows)
            yield batch

    frame = sales(spark, *[sale(i, i) for i in range(40)]).mapInArrow(count, SALES_SCHEMA)
    sinks.append_sales(frame, str(tmp_path / "sales"))
    assert counted.value == 40
    sinks.append_sales(frame.limit(0), str(tmp_path / "sales"))
    assert sinks.read_sales(spark, str(tmp_path / "sales")).count() == 40


@pytest.mark.parametrize("days, rows", [(400, 20), (400, 70), (3, 20), (0, 5)])
def test_newest_sales_read_few_periods(spark, tmp_path, days, rows):
    path = str(tmp_path / "sales")
    every = sales(spark, *[sale(i, i) for i in range(days)])
    sinks.append_sales(every, path)
    if days:
        found = sinks.newest_sales(spark, path, rows)
        assert [r["transaction_id"] for r in found.collect()] == [str(i) for i in reversed(range(days))][:rows]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("PartitionFilters: [isnotnull(sale_period" in plan or "sale_period" in plan.split("PartitionFilters: [")[1].split("]")[0]) == (days > 30)


def test_deduplication_cuts_before_the_shuffle(spark):
    plan = sinks.first_per_transaction(sales(spark, sale(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_overwrite_reads_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "numbers")
    sinks.overwrite_table(spark.range(5), path)
    sinks.overwrite_table(read_table(spark, path).filter("id > 2"), path)
    assert sorted(r["id"] for r in read_table(spark, path).collect()) == [3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["numbers"]


def test_failed_overwrite_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "numbers")
    sinks.overwrite_table(spark.range(5), path)
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        sinks.overwrite_table(broken, path)
    assert read_table(spark, path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["numbers"]


def test_a_failed_swap_brings_the_table_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "numbers")
    sinks.overwrite_table(spark.range(5), path)
    rename = sinks._rename

    def broken(spark, source, target):
        if "__new_" in source:
            raise OSError("no")
        rename(spark, source, target)

    monkeypatch.setattr(sinks, "_rename", broken)
    with pytest.raises(OSError):
        sinks.overwrite_table(spark.range(9), path)
    assert read_table(spark, path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["numbers"]


def test_what_a_broken_run_left_is_tidied(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(3).write.parquet(f"{path}__old_a")
    spark.range(4).write.parquet(f"{path}__new_b")
    spark.range(1).write.parquet(f"{path}__other")
    sinks._tidy(spark, path)
    assert read_table(spark, path).count() == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["numbers", "numbers__other"]


def test_write_error_if_exists(spark, tmp_path):
    path = str(tmp_path / "once")
    sinks.write_new(spark.range(1), path)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        sinks.write_new(spark.range(1), path)


def test_create_database(spark):
    sinks.create_database(spark, "sales")
    sinks.create_database(spark, "sales")
    assert spark.catalog.databaseExists("sales")


def test_enforce_sales_schema(spark, tmp_path):
    good = sales(spark, sale(1))
    sinks.append_sales(good, str(tmp_path / "good"))
    with pytest.raises(ValueError, match="quantity: wanted int, found string"):
        enforce_schema(good.withColumn("quantity", F.lit("1")), SALES_SCHEMA)
    with pytest.raises(ValueError, match="product_id: wanted string, found nothing"):
        enforce_schema(good.drop("product_id"), SALES_SCHEMA)
    with pytest.raises(ValueError, match="extra: not in the schema"):
        enforce_schema(good.withColumn("extra", F.lit(1)), SALES_SCHEMA)
    path = str(tmp_path / "bad")
    without_name = good.withColumn("product_name", F.when(F.col("quantity") > 1, "x"))
    with pytest.raises(PySparkException, match="product_name must not be NULL"):
        sinks.append_sales(without_name, path)
    assert not table_exists(spark, path)


# --- refresh --------------------------------------------------------------------------


def price_file(tmp_path, *products):
    path = tmp_path / "prices.csv"
    headers = list(PRICE_LIST_HEADERS.values())
    lines = [";".join([*headers, "SOBRA"])]
    for code, substance in products:
        row = dict.fromkeys(headers, "a") | {"CÓDIGO GGREM": code, "SUBSTÂNCIA": f'"{substance}"'}
        lines.append(";".join([*row.values(), ""]))
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_refresh_if_stale(spark, tmp_path):
    path = str(tmp_path / "dim")
    landed = price_file(tmp_path, ("1", "A;B"), ("2", "C"))
    now = datetime.now()
    assert is_stale(spark, path, now)
    assert refresh_if_stale(spark, landed, path, now)
    dim = {r["ggrem_code"]: r for r in read_table(spark, path).collect()}
    assert dim["1"]["substance_name"] == "A;B" and dim["1"]["id"] != dim["2"]["id"]

    price_file(tmp_path, ("3", "D"))
    assert not refresh_if_stale(spark, landed, path, now)
    assert read_table(spark, path).count() == 2
    assert refresh_if_stale(spark, landed, path, now + timedelta(days=1))
    assert [r["ggrem_code"] for r in read_table(spark, path).collect()] == ["3"]


def test_refresh_checks_before_it_replaces(spark, tmp_path):
    path, rejected_path = str(tmp_path / "dim"), str(tmp_path / "rejected")
    refresh_dimension(spark, price_file(tmp_path, ("1", "A"), ("2", "B")), path)

    with pytest.raises(ValueError, match="no product"):
        refresh_dimension(spark, price_file(tmp_path), path)
    with pytest.raises(ValueError, match="several products"):
        refresh_dimension(spark, price_file(tmp_path, ("3", "A"), ("3", "B")), path)
    assert sorted(r["ggrem_code"] for r in read_table(spark, path).collect()) == ["1", "2"]

    landed = price_file(tmp_path, ("4", "A"), (" \t", "B"), ("", "C"))
    with open(landed, "a", encoding="utf-8") as out:
        out.write("torn;line\n")
    refresh_dimension(spark, landed, path, rejected_path=rejected_path)
    assert [r["ggrem_code"] for r in read_table(spark, path).collect()] == ["4"]
    errors = sorted(r["error"] for r in read_table(spark, rejected_path).collect())
    assert errors == ["CÓDIGO GGREM is required"] * 2 + ["the line does not fit the header"]


# --- ERP files ------------------------------------------------------------------------


def erp_file(folder, name, rows, header=ERP_HEADER):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


def erp_rows(spark, folder):
    checked = files.check_erp(files.read_erp_files(spark, [str(folder)]))
    return accepted(checked), {r["transaction_id"] or r[CORRUPT_COLUMN]: r for r in rejected(checked).collect()}


def test_erp_extract(spark, tmp_path, catalog):
    erp_file(tmp_path / "in", "a.csv", ERP_ROWS)
    good, bad = erp_rows(spark, tmp_path / "in")
    assert [(r["errors"], r[CORRUPT_COLUMN]) for r in bad.values()] == [
        (["the line does not fit its header"], ERP_ROWS[1])
    ]
    rows = {r["transaction_id"]: r for r in files.erp_to_sales(good, catalog).collect()}
    assert set(rows) == {"A1", "A3", "A4"}
    third = rows["A3"]
    assert third["cart_id"] == "A3" and third["sale_datetime"] == datetime(2025, 5, 23, 10, 15, 10)
    assert third["discount_applied"] == money("0.1") and third["liquid_price"] == money("22.50")
    assert third["total_price"] == money("22.50") and third["industry_name"] == "lab3"
    assert rows["A1"]["total_price_after_taxes"] == money("12.00")
    enforce_schema(files.erp_to_sales(good, catalog), SALES_SCHEMA).collect()


def test_erp_columns_are_found_by_name(spark, tmp_path, catalog):
    names = ERP_HEADER.split(",")
    swapped = ERP_HEADER.replace("product_id,product_name", "product_name,product_id")
    swapped = swapped.replace("unit_price,total_price", "total_price,unit_price")
    row = "C1,2025-05-23 10:00:00,Tablets,P1,30,3000.00,100.00,Cash,E1,C1,,FALSE,0.00,10,L1"
    erp_file(tmp_path / "in", "swapped.csv", [row], swapped)
    fields = dict(zip(names, ERP_ROWS[0].split(",")))
    erp_file(tmp_path / "in", "extra.csv", [",".join(["note", *fields.values()]).replace("A1", "D1")], "remark," + ERP_HEADER)
    few = [n for n in names if n not in ("payment_method", "customer_id")]
    erp_file(tmp_path / "in", "few.csv", [",".join(fields[n] for n in few).replace("A1", "E1", 1)], ",".join(few))
    erp_file(tmp_path / "in", "lost.csv", ["x,y", "z"], "transaction_id,quantity")
    erp_file(tmp_path / "in", "twice.csv", ["q"], ERP_HEADER + ",quantity")
    (tmp_path / "in" / "empty.csv").write_text("")
    good, bad = erp_rows(spark, tmp_path / "in")
    rows = {r["transaction_id"]: r for r in files.erp_to_sales(good, catalog).collect()}
    assert set(rows) == {"C1", "D1", "E1"}
    first = rows["C1"]
    assert (first["product_id"], first["product_name"]) == ("P1", "Tablets")
    assert (first["unit_price"], first["total_price"]) == (money("100.00"), money("3000.00"))
    assert first["total_price_after_taxes"] == money("3015.00")
    assert set(bad) == {"x,y", "z", "q"}
    assert "product_id" in bad["z"]["errors"][0] and "quantity" in bad["q"]["errors"][0]


ODD_LINES = [
    *ERP_ROWS,
    ERP_ROWS[0].replace("Tablets", ""),
    ERP_ROWS[0].replace("Tablets", " \t"),
    ERP_ROWS[0].replace("Tablets", '"Tab,lets"'),
    ERP_ROWS[0].replace("Tablets", '"Tab ""x"" lets"'),
    ERP_ROWS[0].replace("Tablets", 'Tab "x" lets'),
    ERP_ROWS[0].replace("Tablets", '"open'),
    ERP_ROWS[0].replace("Tablets", '""'),
    ERP_ROWS[0].replace("Tablets", "back\\slash\\"),
    ERP_ROWS[0].replace("Tablets", "ü\u00a0\u3000'#\x00"),
    ERP_ROWS[0].replace("Tablets", "\ufeff"),
    ERP_ROWS[0] + ",",
    ERP_ROWS[0][: -len(",L1")],
    ERP_ROWS[0].replace(",L1", ","),
    "," + ERP_ROWS[0].split(",", 1)[1],
    "# " + ERP_ROWS[0],
    "," * 14,
    "," * 13,
    "x",
    '"',
]


def test_cut_lines_have_the_fields_of_the_parser(spark, tmp_path, monkeypatch):
    erp_file(tmp_path / "in", "a.csv", ODD_LINES)
    erp_file(tmp_path / "in", "b.csv", ODD_LINES, ",".join(reversed(ERP_HEADER.split(","))))
    few = [n for n in ERP_HEADER.split(",") if n != "payment_method"]
    erp_file(tmp_path / "in", "c.csv", ODD_LINES, ",".join(few))
    read = lambda: sorted(map(str, files.read_erp_files(spark, [str(tmp_path / "in")]).collect()))
    cut = read()
    nothing = F.lit(None).cast("int"), F.lit(None).cast("array<int>")
    monkeypatch.setattr(files, "_places", lambda header: nothing)
    assert cut == read() and len(cut) == 3 * len(ODD_LINES)


def test_plain_lines_do_not_meet_the_parser(spark, tmp_path, monkeypatch):
    erp_file(tmp_path / "in", "a.csv", [ERP_ROWS[0], ERP_ROWS[2]])
    original = files._read_line

    def fail(header):
        return F.when(F.raise_error(F.lit("parsed")).cast("string").isNull(), original(header))

    monkeypatch.setattr(files, "_read_line", fail)
    rows = files.read_erp_files(spark, [str(tmp_path / "in")])
    assert sorted(r["transaction_id"] for r in rows.collect()) == ["A1", "A3"]


ODD_NAMES = ["with space.csv", "p%41.csv", "b[1].csv", "{x,y}.csv", "a*.csv", "q?.csv", "h#1.csv", "ü+&=;.csv"]


def test_files_of_any_name(spark, tmp_path, catalog):
    for k, name in enumerate(ODD_NAMES):
        erp_file(tmp_path / "in [1] {a,b}", name, [ERP_ROWS[0].replace("A1", f"N{k}")])
    # Names that a pattern would also match.
    erp_file(tmp_path / "in [1] {a,b}", "b1.csv", [ERP_ROWS[0].replace("A1", "N8")])
    rows = files.read_erp_files(spark, [str(tmp_path / "in [1] {a,b}" / n) for n in ODD_NAMES])
    assert sorted(r["transaction_id"] for r in rows.collect()) == [f"N{k}" for k in range(len(ODD_NAMES))]
    good, bad = erp_rows(spark, tmp_path / "in [1] {a,b}")
    assert good.count() == len(ODD_NAMES) + 1 and not bad


def test_a_file_that_cannot_be_read_is_rejected(spark, tmp_path, catalog):
    for k in range(5):
        erp_file(tmp_path / "in", f"f{k}.csv", [ERP_ROWS[0].replace("A1", f"U{k}")])
    (tmp_path / "in" / "broken.csv.gz").write_bytes(b"\x1f\x8b\x08\x00 no archive")
    names = sorted(str(p) for p in (tmp_path / "in").iterdir()) + [str(tmp_path / "in" / "vanished.csv")]
    checked = files.check_erp(files.read_erp_files(spark, names))
    assert sorted(r["transaction_id"] for r in accepted(checked).collect()) == [f"U{k}" for k in range(5)]
    bad = rejected(checked).collect()
    assert sorted(r["_file"].rsplit("/", 1)[1] for r in bad) == ["broken.csv.gz", "vanished.csv"]
    assert {tuple(r["errors"]) for r in bad} == {("the file cannot be read",)}


def test_other_failures_are_not_taken_for_unreadable_files(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise PySparkException("the cluster is gone")

    monkeypatch.setattr(files, "_store_lines", fail)
    with pytest.raises(PySparkException, match="gone"):
        files.read_erp_files(spark, ["a", "b"])


def test_extracts_are_scanned_once(spark, tmp_path):
    erp_file(tmp_path / "in", "a.csv", ERP_ROWS)
    erp_file(tmp_path / "in", "b.csv", ["\n \n", ERP_ROWS[0]], "remark," + ERP_HEADER)
    rows = files.read_erp_files(spark, [str(tmp_path / "in")])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan csv" not in plan
    assert rows.count() == 5 and rows.where("_problem is null").count() == 3


def test_a_small_discount_on_a_large_line(spark, tmp_path, catalog):
    erp_file(tmp_path / "in", "a.csv", ["F1,2025-05-23 10:00:00,P1,T,30,100.00,2999.90,Cash,E1,C1,,FALSE,0.10,10,L1"])
    row = files.erp_to_sales(erp_rows(spark, tmp_path / "in")[0], catalog).first()
    assert row["discount_applied"] == money("0.0000333333")
    assert (row["total_price"], row["total_price_after_taxes"]) == (money("2999.90"), money("3014.90"))


def test_no_extracts(spark, tmp_path, catalog):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty.csv").write_text("")
    good, bad = erp_rows(spark, tmp_path / "in")
    assert files.erp_to_sales(good, catalog).count() == 0 and not bad


def test_unknown_product_keeps_its_row(spark, tmp_path, catalog):
    erp_file(tmp_path / "in", "a.csv", ["B1,2025-05-23 10:00:00,P9,New,1,5.50,5.50,Cash,E1,C1,,FALSE,0.00,10,L1"])
    row = files.erp_to_sales(erp_rows(spark, tmp_path / "in")[0], catalog).first()
    assert row["industry_name"] == files.UNKNOWN_INDUSTRY and row["taxes_price"] == 0


def test_malformed_rows_can_be_counted(spark, tmp_path):
    erp_file(tmp_path / "in", "a.csv", ERP_ROWS)
    parsed = files.read_checked_csv(spark, str(tmp_path / "in"), ERP_SCHEMA)
    good, bad = split_corrupt(parsed, CORRUPT_COLUMN, str(tmp_path / "parsed"))
    assert (good.count(), bad.count()) == (3, 1)


def test_checked_lines_are_parsed_once(spark, tmp_path):
    fields = ["cart_id", "transaction_id", "industry_name", "product_id", "product_name", "sale_datetime",
              "unit_price", "taxes_price", "quantity", "discount_applied"]
    rows = [("k", "1", "i", "p", "\tname\u00a0", "2025-05-23 10:00:00", "1,50", "0", "2", "0,003"),
            ("k", "2", "i", "p", "\t", "2025-05-23 10:00:00", "1,50", "0", "2", None)]
    raw = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    good, bad = split_lines(raw, str(tmp_path / "checked"))
    row = good.first()
    assert row["product_name"] == "name" and row["discount_applied"] == money("0.00003")
    assert [(r["transaction_id"], r["errors"]) for r in bad.collect()] == [("2", ["product_name is required"])]


def test_stream_of_erp_files(spark, tmp_path, catalog):
    landing, out, rejected_path, checkpoint = (tmp_path / n for n in ("in", "out", "rejected", "checkpoint"))

    def load():
        stream_erp_sales(
            spark, str(landing), catalog, str(out), str(rejected_path), str(checkpoint)
        ).awaitTermination()
        return sorted(r["transaction_id"] for r in sinks.read_sales(spark, str(out)).collect())

    erp_file(landing, "a.csv", ERP_ROWS[:3])
    assert load() == ["A1", "A3"]
    blank = "G1,2025-05-23 10:00:00,P1,Tablets,,5.50,11.00,Cash,E1,C1,,FALSE,0.00,10,L1"
    erp_file(landing, "b.csv", [*ERP_ROWS, blank, blank.replace(",,5.50", ",x,5.50")])
    erp_file(landing, "c [1] 5%.csv", ["lost"], "no,such,header")
    assert load() == ["A1", "A3", "A4"]
    assert load() == ["A1", "A3", "A4"]
    errors = sorted(r["errors"][0] for r in read_table(spark, str(rejected_path)).collect())
    assert errors[:2] == ["quantity is not a valid value", "quantity is required"]
    assert errors[2:4] == ["the header must have each of these once: " + ", ".join(files.ERP_REQUIRED)] + [
        "the line does not fit its header"
    ]
    assert len(errors) == 5


# --- cart streams ---------------------------------------------------------------------


def write_event_files(spark, rows, folder, parts, seed=None):
    """Events in several files, in time order or (with a seed) late by up to a file."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    size = -(-len(rows) // parts)
    if seed is not None:
        rng = random.Random(seed)
        rows.sort(key=lambda r: r[2] + rng.randrange(0, 3000))
    for i in range(parts):
        part = events(spark, rows[i * size : (i + 1) * size])
        part.coalesce(1).write.mode("append").parquet(folder)


def run_cart_stream(spark, folder, state, checkpoint, delay):
    stream = spark.readStream.schema(CART_EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    live.stream_saved_carts(stream, state, checkpoint, delay).awaitTermination()


@pytest.mark.parametrize("seed", [None, 3])
def test_stream_cart_state(spark, tmp_path, seed):
    """Batches, repeated events and late events give what one batch job gives."""
    rows = random_events(5, n=300)
    folder, state, checkpoint = (str(tmp_path / n) for n in ("events", "state", "checkpoint"))
    write_event_files(spark, rows + rows[::9], folder, 4, seed)
    run_cart_stream(spark, folder, state, checkpoint, "1 hour")
    assert read_table(spark, f"{state}/committed").count() > 0
    lines = live.live_carts(spark, state).collect()
    got = [(r["cart"], r["save_event_id"], r["product"], r["quantity"]) for r in lines]
    assert len(got) == len(set(got))
    assert set(got) == fold(rows)
    batch = c.saved_carts(events(spark, rows)).select("cart", "cart_seq", "save_event_id").distinct()
    numbers = {(r["cart"], r["cart_seq"], r["save_event_id"]) for r in lines}
    assert numbers == {tuple(r) for r in batch.collect()}


def settle(spark, rows, batch_id, state):
    batch = events(spark, [r for r in rows if r[3] != "search"])
    settle_batch(batch, batch_id, state, "1 hour", live.settle_carts(spark, state, "parquet"), "parquet")


def settled_lines(spark, state):
    return sorted(
        (r["cart"], r["save_event_id"], r["product"], r["quantity"]) for r in live.live_carts(spark, state).collect()
    )


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = random_events(6, n=200)
    rows.sort(key=lambda r: r[2])
    state = str(tmp_path / "state")
    for batch_id, part in ((0, rows[:100]), (1, rows[100:]), (1, rows[100:])):
        settle(spark, part, batch_id, state)
    assert settled_lines(spark, state) == sorted(fold(rows))


def test_a_crash_between_the_writes_shows_nothing(spark, tmp_path, monkeypatch):
    rows = random_events(6, n=200)
    rows.sort(key=lambda r: r[2])
    state = str(tmp_path / "state")
    settle(spark, rows[:100], 0, state)
    before = settled_lines(spark, state)

    def crash(*args):
        raise RuntimeError("crash")

    with monkeypatch.context() as broken:
        broken.setattr(settling, "create_file", crash)
        with pytest.raises(RuntimeError):
            settle(spark, rows[100:], 1, state)
    assert settled_lines(spark, state) == before
    settle(spark, rows[100:], 1, state)
    assert settled_lines(spark, state) == sorted(fold(rows))


def test_late_events_are_kept_apart(spark, tmp_path):
    state = str(tmp_path / "state")
    settle(spark, [(1, 7, 0, "set_qty", 1, 2), (2, 7, 9000, "set_qty", 1, 3)], 0, state)
    late = [(3, 7, 100, "set_qty", 2, 2), (4, 7, 200, "save", None, None)]
    settle(spark, [*late, (5, 7, 9100, "save", None, None)], 1, state)
    assert sorted(r["event_id"] for r in live.late_events(spark, state).collect()) == [3, 4]
    assert settled_lines(spark, state) == [(7, 5, 1, 3)]


def test_repeated_events_are_not_late(spark, tmp_path):
    rows = [(k, 1, 600 * k, c.SET_QUANTITY, k % 3, 1) for k in range(40)]
    folder, state, checkpoint = (str(tmp_path / n) for n in ("in", "state", "checkpoint"))
    late = (100, 1, 900, c.SET_QUANTITY, 1, 1)
    deliveries = [rows[:30], [*rows[30:], *rows[:5]], [late, *rows[:10], rows[39]], [late]]
    for delivery in deliveries:
        events(spark, delivery).coalesce(1).write.mode("append").parquet(folder)
        run_cart_stream(spark, folder, state, checkpoint, "1 hour")
    assert [r["event_id"] for r in live.late_events(spark, state).collect()] == [100]


def test_pending_events_do_not_pile_up(spark, tmp_path):
    rows = [(i, i % 3, i * 600, ["set_qty", "set_qty", "set_qty", "save"][i // 3 % 4], 1, 1) for i in range(120)]
    folder, state, checkpoint = (str(tmp_path / n) for n in ("events", "state", "checkpoint"))
    write_event_files(spark, rows, folder, 3)
    run_cart_stream(spark, folder, state, checkpoint, "30 minutes")
    kept = sinks.numbered_folders(spark, f"{state}/pending", "batch_id=")
    assert len(kept) == 2
    assert read_table(spark, f"{state}/pending/batch_id={kept[-1]}").count() < 30


def test_scratch_goes_when_the_work_fails(spark):
    made = []

    def work(batch, batch_id):
        made.append(new_folder(spark, "inner"))
        batch.write.parquet(made[0])
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        staged_batches(spark, work, "parquet")(spark.range(3), 0)
    names = sinks.names_in(spark, made[0].rsplit("/", 1)[0])
    assert made[0].rsplit("/", 1)[1] not in names and not [n for n in names if n.startswith("batch-")]


# --- search streams -------------------------------------------------------------------


def test_stream_debounce(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(5), at(rng.randrange(4000)), i, f"t{i}") for i in range(200)]
    rows.sort(key=lambda r: r[1])
    frame = spark.createDataFrame(rows, SEARCH_SCHEMA)
    folder, state, checkpoint = (str(tmp_path / n) for n in ("searches", "state", "checkpoint"))
    open_rows = []
    for k in range(4):
        part = spark.createDataFrame(rows[50 * k : 50 * k + 50], SEARCH_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SEARCH_SCHEMA).parquet(folder)
        stream_debounced(stream, state, checkpoint, "20 seconds").awaitTermination()
        newest = settling.newest_batch(spark, state)
        open_rows.append(read_table(spark, f"{state}/pending/batch_id={newest}").count())
    want = sorted(tuple(r) for r in debounce_searches(frame, "20 seconds").select(*SEARCH_SCHEMA.fieldNames()).collect())
    assert sorted(map(tuple, live_searches(spark, state, "20 seconds").collect())) == want
    assert max(open_rows) < 30
    late = [(rows[0][0], rows[0][1], 999, "late")]
    spark.createDataFrame(late, SEARCH_SCHEMA).write.mode("append").parquet(folder)
    stream_debounced(spark.readStream.schema(SEARCH_SCHEMA).parquet(folder), state, checkpoint, "20 seconds").awaitTermination()
    assert [r["event_id"] for r in late_searches(spark, state).collect()] == [999]
    assert sorted(map(tuple, live_searches(spark, state, "20 seconds").collect())) == want


def test_saved_carts_plan_has_no_python(spark):
    plan = c.saved_carts(events(spark, random_events(1, n=20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan
