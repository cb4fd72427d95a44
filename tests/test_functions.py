from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from botica import session
from botica.functions import keys, money, numbers, text, timing
from tests.frames import START


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_parse_price(spark):
    raw = ["26,78", "7486,97*", "5.50", " 12 ", "1.234,56", "abc", "", "    -     ", None, "3,5 *"]
    want = ["26.78", "7486.97", "5.50", "12.00", None, None, None, None, None, "3.50"]
    got = values(spark, raw, numbers.parse_price(F.col("x")))
    assert got == [None if w is None else Decimal(w) for w in want]


def test_price_flag(spark):
    assert values(spark, ["7486,97*", "26,78", None, "1* "], numbers.price_flag(F.col("x"))) == [
        True,
        False,
        False,
        True,
    ]


def test_int_or_default(spark):
    raw = ["", "  ", None, " 7 ", "-1", "abc", "5.0"]
    assert values(spark, raw, numbers.int_or_default(F.col("x"))) == [0, 0, 0, 7, -1, None, None]


def test_decimal_or_default(spark):
    got = values(spark, ["", "2,5", "n/a", "-5"], numbers.decimal_or_default(F.col("x")))
    assert got == [Decimal(0), Decimal("2.5"), None, Decimal(-5)]


@pytest.mark.parametrize(
    ("percent", "fraction"),
    [("5", "0.05"), ("150", "1"), ("-5", "0"), ("0", "0"), (None, None), ("12,5", "0.125")],
)
def test_discount(spark, percent, fraction):
    column = money.clamp_fraction(money.percent_to_fraction(numbers.parse_decimal(F.col("x"))))
    assert values(spark, [percent], column) == [None if fraction is None else Decimal(fraction)]


def test_format_money_round_trip(spark):
    amounts = [Decimal(a) for a in ("0.00", "1234.50", "38453.52", "0.13", "7.30")]
    shown = values(spark, amounts, money.format_money(F.col("x")), "x decimal(18,2)")
    assert shown == ["0,00", "1234,50", "38453,52", "0,13", "7,30"]
    assert values(spark, shown, numbers.parse_price(F.col("x"))) == amounts


def test_format_money_rounds_half_up(spark):
    assert values(spark, [Decimal("0.125")], money.format_money(F.col("x")), "x decimal(18,3)") == ["0,13"]


def test_display_total(spark):
    rows = [(0, Decimal("5.00")), (3, Decimal("5.00")), (2, Decimal("0.00"))]
    frame = spark.createDataFrame(rows, "q int, p decimal(18,2)")
    got = [r[0] for r in frame.select(money.display_total(F.col("q"), F.col("p"))).collect()]
    assert got == [Decimal("5.00"), Decimal("15.00"), Decimal("0.00")]


def test_display_name_is_null_if_a_part_is(spark):
    frame = spark.createDataFrame([("a", "b"), ("a", None), (None, "b")], "x string, y string")
    got = [r[0] for r in frame.select(text.display_name(F.col("x"), F.col("y"))).collect()]
    assert got == ["a b", None, None]


def test_placeholder(spark):
    got = values(spark, ["    -     ", "", " 789 ", "- (*) "], text.placeholder_to_null(F.col("x")))
    assert got == [None, None, "789", "- (*)"]


def test_contains_is_literal(spark):
    rows = ["100% pure", "100 pure", "o'ring"]
    assert values(spark, rows, text.contains_ignoring_case(F.col("x"), "0%")) == [True, False, False]
    assert values(spark, rows, text.contains_ignoring_case(F.col("x"), "O'R")) == [False, False, True]
    assert values(spark, rows, text.like_ignoring_case(F.col("x"), "0%p")) == [True, True, False]


def test_parse_timestamp(spark):
    got = values(spark, ["2025-05-23 10:00:00", "2025-13-01 10:00:00", "x", ""], timing.parse_timestamp(F.col("x")))
    assert got == [datetime(2025, 5, 23, 10), None, None, None]


def test_surrogate_key_is_per_row_and_stable(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("a",)], "x string")
    once = [r[0] for r in frame.select(keys.surrogate_key(F.col("x"))).collect()]
    assert once[0] == once[2] != once[1]
    assert once == [r[0] for r in frame.select(keys.surrogate_key(F.col("x"))).collect()]


def test_line_uuid(spark):
    assert spark.range(100).select(keys.line_uuid().alias("u")).distinct().count() == 100


def test_sale_datetime_stamp(spark):
    frame = spark.createDataFrame([(START,), (None,)], "x timestamp")
    given, stamped = (r[0] for r in frame.select(timing.sale_stamp(F.col("x"))).collect())
    assert given == START
    assert abs((datetime.now() - stamped).total_seconds()) < 600


def test_settings_follow_the_data():
    small = session.settings(10 << 20, 8)
    large = session.settings(20 << 40, 4000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert int(large["spark.sql.shuffle.partitions"]) == 81_920
    assert large["spark.sql.adaptive.enabled"] == "true"


def test_no_limit_on_shuffle_partitions():
    huge = session.settings(500 << 40, 4000)
    assert int(huge["spark.sql.shuffle.partitions"]) == 500 * 4096


@pytest.mark.parametrize("value", ["\tx", "x\r\n", "\u00a0x\u2003", " \x1cx ", "x"])
def test_all_white_space_is_trimmed(spark, value):
    assert values(spark, [value], text.trimmed(F.col("x"))) == ["x"]
    assert values(spark, [value.replace("x", "")], text.is_blank(F.col("x"))) == [True]
    assert values(spark, [value.replace("x", "")], text.blank_to_null(F.col("x"))) == [None]


def test_like_takes_a_backslash_as_itself(spark):
    rows = ["a\\b", "ab", "A\\B%"]
    assert values(spark, rows, text.like_ignoring_case(F.col("x"), "a\\b")) == [True, False, True]
    assert values(spark, rows, text.like_ignoring_case(F.col("x"), "A_B")) == [True, False, True]


def test_surrogate_key_tells_parts_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, ""), ("", None), ("", ""), (None, None), ("-", ""), ("1:a", "")]
    frame = spark.createDataFrame(rows, "x string, y string")
    found = frame.select(keys.surrogate_key(F.col("x"), F.col("y")).alias("k")).distinct().count()
    assert found == len(rows)
