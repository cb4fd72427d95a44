from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from botica.operators import carts as c
from botica.operators import pricing as p
from botica.operators import quality as q
from botica.operators import reports
from botica.plans import bindings as b
from botica.operators.ordered import in_ranges, next_value, running_sum
from botica.operators.searches import debounce_searches
from botica.schemas import SALES_SCHEMA
from botica.sources.tables import rows_to_table
from tests.frames import START, at, events, money

LINE = "cart_id string, transaction_id string, unit_price decimal(18,2), discount_applied decimal(9,4), taxes_price decimal(18,2), quantity int"


def line(cart, transaction, price="10.00", discount=None, tax="1.20", quantity=1):
    fraction = None if discount is None else Decimal(discount)
    return (cart, transaction, money(price), fraction, money(tax), quantity)


# --- pricing --------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("discount", "quantity", "liquid", "after", "total", "total_after"),
    [
        ("0", 3, "10.00", "11.20", "30.00", "33.60"),
        ("0.05", 2, "9.50", "10.70", "19.00", "21.40"),
        ("1.5", 1, "0.00", "1.20", "0.00", "1.20"),
        ("-0.05", 1, "10.00", "11.20", "10.00", "11.20"),
        (None, 1, "10.00", "11.20", "10.00", "11.20"),
    ],
)
def test_price_lines(spark, discount, quantity, liquid, after, total, total_after):
    frame = spark.createDataFrame([line("k", "t", discount=discount, quantity=quantity)], LINE)
    row = p.price_lines(frame).first()
    got = [row["liquid_price"], row["liquid_price_after_taxes"], row["total_price"], row["total_price_after_taxes"]]
    assert got == [money(v) for v in (liquid, after, total, total_after)]
    assert (row["discount_applied"] is None) == (discount is None)


def test_pricing_again_changes_nothing(spark):
    once = p.price_lines(spark.createDataFrame([line("k", "t", discount="0.1", quantity=4)], LINE))
    assert p.price_lines(once).select(*once.columns).collect() == once.collect()


def test_enrich_and_unmatched(spark):
    catalog = spark.createDataFrame(
        [("1", "lab", "name", money("10.00"), money("1.20")), ("2", "lab", "other", money("5.00"), None)],
        "id string, industry_name string, product_name string, unit_price decimal(18,2), taxes_price decimal(18,2)",
    )
    lines = spark.createDataFrame(
        [("k", t, START, pid, 2, None) for t, pid in (("a", "1"), ("b", "2"), ("c", "9"))],
        "cart_id string, transaction_id string, sale_datetime timestamp, product_id string, quantity int, discount_applied decimal(9,4)",
    )
    priced = {r["transaction_id"]: r for r in p.enrich_lines(lines, catalog).collect()}
    assert priced["a"]["total_price_after_taxes"] == money("22.40")
    # A product whose tax is not known cannot be sold tax-free.
    assert set(priced) == {"a"}
    assert sorted(r["transaction_id"] for r in p.unmatched_lines(lines, catalog).collect()) == ["b", "c"]
    q.enforce_schema(p.enrich_lines(lines, catalog), SALES_SCHEMA).collect()


def test_hot_product_is_split(spark, tmp_path):
    """A product with most of the lines is joined in several tasks."""
    n = 60_000
    lines = spark.range(n).select(
        F.lit("k").alias("cart_id"),
        F.col("id").cast("string").alias("transaction_id"),
        F.current_timestamp().alias("sale_datetime"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("product_id"),
        F.lit(1).alias("quantity"),
        F.lit(None).cast("decimal(9,4)").alias("discount_applied"),
    )
    catalog = spark.range(n).select(
        F.when(F.col("id") == 1, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.lit("lab").alias("industry_name"),
        F.lit("name").alias("product_name"),
        F.lit("1.00").cast("decimal(18,2)").alias("unit_price"),
        F.lit("0.10").cast("decimal(18,2)").alias("taxes_price"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    lines.repartition(8).write.parquet(str(tmp_path / "lines"))
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = p.enrich_lines(spark.read.parquet(str(tmp_path / "lines")), catalog)
        assert len(joined.collect()) == n
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_sales_defaults(spark):
    frame = spark.createDataFrame(
        [(None, None, None, None), ("7", "name", Decimal("0.1"), 3)],
        "product_id string, product_name string, discount_applied decimal(9,4), quantity int",
    )
    rows = [tuple(r) for r in p.with_sales_defaults(frame).collect()]
    assert rows == [("0", "", Decimal(0), 0), ("7", "name", Decimal("0.1"), 3)]


# --- validation -----------------------------------------------------------------------

TYPED = [*q.REQUIRED_FIELDS, "discount_applied"]
GOOD = {
    "cart_id": "k",
    "transaction_id": "t",
    "industry_name": " lab ",
    "product_id": "1",
    "product_name": "name",
    "sale_datetime": "2025-05-23 10:00:00",
    "unit_price": "10,50",
    "taxes_price": "1.20",
    "quantity": " 2 ",
    "discount_applied": "5",
}


def typed(spark, *changes):
    rows = [tuple({**GOOD, **change}[f] for f in TYPED) for change in changes]
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in TYPED))


def test_accepted_line(spark):
    row = q.accepted_lines(typed(spark, {})).first()
    assert row["industry_name"] == "lab" and row["quantity"] == 2
    assert row["unit_price"] == money("10.50") and row["discount_applied"] == Decimal("0.05")


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({"product_name": "  "}, ["product_name is required"]),
        ({"cart_id": None}, ["cart_id is required"]),
        ({"quantity": "abc"}, ["quantity is not a valid value"]),
        ({"quantity": "-1"}, ["quantity is not between 0 and 9999"]),
        ({"quantity": "10000"}, ["quantity is not between 0 and 9999"]),
        ({"sale_datetime": "23/05/2025"}, ["sale_datetime is not a valid value"]),
        ({"discount_applied": "n/a"}, ["discount_applied is not a valid value"]),
        (
            {"quantity": "", "unit_price": "x"},
            ["quantity is required", "unit_price is not a valid value"],
        ),
    ],
)
def test_rejected_line(spark, change, errors):
    frame = typed(spark, change)
    assert q.accepted_lines(frame).count() == 0
    row = q.rejected_lines(frame).first()
    assert row["errors"] == errors
    assert row["industry_name"] == " lab "


def test_bounds_and_optional_discount_are_accepted(spark):
    frame = typed(spark, {"quantity": "0"}, {"quantity": "9999"}, {"discount_applied": ""}, {"discount_applied": None})
    assert q.rejected_lines(frame).count() == 0
    accepted = q.accepted_lines(frame)
    assert accepted.count() == 4
    assert q.positive_quantity(accepted).count() == 3


def test_rows_to_sales(spark):
    good = ("k", "t", START, "lab", "1", "n", money("1"), None, money("1"), money("0"), money("1"), 1, money("1"), money("1"))
    assert rows_to_table(spark, [good], SALES_SCHEMA).count() == 1
    with pytest.raises(PySparkException, match="FIELD_NOT_NULLABLE"):
        rows_to_table(spark, [(None, *good[1:])], SALES_SCHEMA)
    with pytest.raises(PySparkException):
        rows_to_table(spark, [(*good[:6], "1,00", *good[7:])], SALES_SCHEMA)


# --- carts ----------------------------------------------------------------------------


def cart_lines(spark):
    rows = [line("k", str(i), quantity=i) for i in (1, 2, 3)] + [line("m", "4", price="5.00")]
    frame = p.price_lines(spark.createDataFrame(rows, LINE))
    return frame.withColumn("line_seq", F.col("transaction_id").cast("long"))


def test_totals_and_running_totals_agree(spark):
    lines = cart_lines(spark)
    totals = {r["cart_id"]: (r["cart_total"], r["line_count"]) for r in c.cart_totals(lines).collect()}
    assert totals == {"k": (money("67.20"), 3), "m": (money("6.20"), 1)}
    for step in (1, 2, 1 << 20):
        running = c.cart_running_total(lines, step).orderBy("line_seq").collect()
        assert [r["running_total"] for r in running] == [money(v) for v in ("11.20", "33.60", "67.20", "6.20")]


def test_deleting_lines(spark):
    lines = cart_lines(spark)
    gone = spark.createDataFrame([("k", "2"), ("m", "1"), ("m", "4")], "cart_id string, transaction_id string")
    totals = {r["cart_id"]: r["cart_total"] for r in c.cart_totals(c.delete_lines(lines, gone)).collect()}
    assert totals == {"k": money("44.80")}


def test_what_if(spark):
    candidates = spark.createDataFrame([line("k", "c1"), line("new", "c2")], LINE)
    got = {r["transaction_id"]: r["what_if_total"] for r in c.cart_what_if(cart_lines(spark), candidates).collect()}
    assert got == {"c1": money("78.40"), "c2": money("11.20")}


def fold(rows):
    """Event-by-event folding of one table of cart events."""
    open_lines, out = {}, set()
    for event, cart, seconds, action, product, quantity in sorted(rows, key=lambda r: (r[2], r[0])):
        lines = open_lines.setdefault(cart, {})
        if action == "set_qty":
            lines[product] = quantity
        elif action == "delete":
            lines.pop(product, None)
        elif action == "save":
            out |= {(cart, event, k, n) for k, n in lines.items() if n > 0}
            open_lines[cart] = {}
    return out


def random_events(seed, n=1500, hot=0.4):
    """Events of few tills, one of them with a large share, some at the same second."""
    rng = random.Random(seed)
    kinds = ["set_qty"] * 5 + ["delete", "save", "search"]
    return [
        (
            i,
            0 if rng.random() < hot else rng.randrange(1, 9),
            rng.randrange(0, 40_000),
            rng.choice(kinds),
            rng.randrange(4),
            rng.randrange(4),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize(("seed", "pieces"), [(1, None), (2, 40), (3, 1)])
def test_saved_carts_equal_folding(spark, seed, pieces):
    rows = random_events(seed)
    got = {
        (r["cart"], r["save_event_id"], r["product"], r["quantity"])
        for r in c.saved_carts(events(spark, rows), pieces).collect()
    }
    assert got == fold(rows)


def test_save_clears_and_last_quantity_counts(spark):
    rows = [
        (1, 7, 0, "set_qty", 1, 2),
        (2, 7, 1, "set_qty", 1, 5),
        (3, 7, 2, "set_qty", 2, 1),
        (4, 7, 3, "delete", 2, None),
        (5, 7, 4, "save", None, None),
        (6, 7, 5, "save", None, None),
        (7, 7, 6, "set_qty", 3, 0),
        (8, 7, 7, "set_qty", 4, 1),
        (9, 7, 8, "save", None, None),
        (10, 7, 9, "set_qty", 1, 1),
    ]
    got = sorted((r["cart_seq"], r["product"], r["quantity"]) for r in c.saved_carts(events(spark, rows)).collect())
    assert got == [(0, 1, 5), (2, 4, 1)]


# --- ordered operators ----------------------------------------------------------------


@pytest.mark.parametrize("pieces", [None, 1, 7, 100])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum_equals_loop(spark, pieces, inclusive):
    rng = random.Random(pieces)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(3000), i, rng.randrange(10)) for i in range(800)]
    frame = spark.createDataFrame(rows, "k int, at int, id int, v int")
    out = running_sum(frame, ["k"], ["at", "id"], F.col("v"), "total", inclusive, pieces)
    got = {r["id"]: r["total"] for r in out.collect()}
    want, sums = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        before = sums.get(k, 0)
        sums[k] = before + v
        want[i] = sums[k] if inclusive else before
    assert got == want


@pytest.mark.parametrize("pieces", [None, 1, 50])
def test_next_value_equals_loop(spark, pieces):
    rng = random.Random(pieces)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(500), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "k int, at int, id int")
    out = next_value(frame, ["k"], ["at", "id"], "at", "next_at", pieces)
    got = {r["id"]: r["next_at"] for r in out.collect()}
    want, ahead = {}, {}
    for k, when, i in sorted(rows, key=lambda r: (r[1], r[2]), reverse=True):
        want[i] = ahead.get(k)
        ahead[k] = when
    assert got == want


def test_a_hot_group_is_dealt_to_all_pieces(spark):
    """A third of the rows in one group, all at one time: the order's last column parts them."""
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.lit(START).alias("at"),
        "id",
    )
    dealt = in_ranges(frame, ["k"], ["at", "id"], 12)
    sizes = [r["n"] for r in dealt.groupBy("_chunk").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 3000 / 12
    assert dealt.filter("k = 0").select("_chunk").distinct().count() >= 4


def test_debounce(spark):
    rows = [(1, at(0), 1, "a"), (1, at(2), 2, "ab"), (1, at(5), 3, "abc"), (1, at(7), 4, "x"), (2, at(1), 5, "y")]
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, text string")
    assert sorted(r["text"] for r in debounce_searches(frame).collect()) == ["ab", "x", "y"]
    assert sorted(r["text"] for r in debounce_searches(frame, "1 second").collect()) == ["a", "ab", "abc", "x", "y"]


# --- reports --------------------------------------------------------------------------


def test_newest(spark):
    rows = [(str(i), at(i % 7)) for i in range(50)] + [("null", None)]
    frame = spark.createDataFrame(rows, "transaction_id string, sale_datetime timestamp")
    got = [(r["sale_datetime"], r["transaction_id"]) for r in reports.newest(frame).collect()]
    want = sorted(((t, i) for i, t in rows if t), key=lambda r: (-r[0].timestamp(), r[1]))[:20]
    assert got == want
    assert reports.newest_first(frame).collect()[-1]["transaction_id"] == "null"
    plan = reports.newest(frame)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A folder of tables with 900 lines of 300 orders; each order's second line came twice."""
    folder = str(tmp_path_factory.mktemp("shop"))
    lines = spark.range(900).selectExpr(
        "id div 3 + 1 AS l_orderkey", "CAST(greatest(id % 3, 1) AS INT) AS l_linenumber", "id div 3 % 20 + 1 AS l_partkey",
        "7L AS l_suppkey", "CAST(id % 50 + 1 AS DOUBLE) AS l_quantity", "0.05D AS l_discount", "0.02D AS l_tax",
        "'N' AS l_returnflag", "'O' AS l_linestatus", "DATE'1997-05-11' AS l_shipdate",
    )
    orders = spark.range(1, 301).selectExpr("id AS o_orderkey", "TIMESTAMP_NTZ'1997-05-01 00:00:00' AS o_orderdate")
    part = spark.range(1, 21).selectExpr(
        "id AS p_partkey", "concat('bolt ', id) AS p_name", "'Brand#1' AS p_brand", "CAST(900 + id AS DOUBLE) AS p_retailprice"
    )
    for name, rows in {"lineitem": lines, "orders": orders, "part": part}.items():
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_lines_meet_products_as_numbers(spark, shop):
    """Texts are made after the joins, so that none but the product's own is exchanged."""
    plan = b.sale_lines(spark, shop)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Join")
    assert "concat_ws" not in plan[plan.index("Join") :]


def test_all_lines_of_an_order_are_landed_in_one_file(spark, shop):
    """So a line that is delivered twice comes twice in one batch, where the smaller one counts."""
    text = spark.read.option("recursiveFileLookup", True).text(b.erp_landing(spark, shop))
    key = F.regexp_extract("value", r"(\d+)-\d+-\d+-\d+", 1)
    lines = text.select(key.alias("order"), F.col("_metadata.file_path").alias("file")).where("order <> ''")
    assert lines.count() == 900
    assert lines.groupBy("order").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0


def test_dealt_lines_are_exchanged_twice(spark, shop):
    """By product, and by order, as they are dealt."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = b.sale_lines(spark, shop, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning(l_") == 2
    assert "Exchange hashpartitioning(l_orderkey" in plan and "REPARTITION_BY_NUM" in plan


def test_more_lines_are_landed_in_more_files(spark, shop, monkeypatch):
    assert b.landed_files(spark, shop) == b.LANDED_FILES
    monkeypatch.setattr(b, "LANDED_BYTES", 100)
    assert b.landed_files(spark, shop) > b.LANDED_FILES
