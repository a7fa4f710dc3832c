import datetime

import pytest
from pyspark.sql import functions as F

from ratelantern.functions import clean


def values(spark, inputs, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_every_kind_of_white_space_is_trimmed(spark):
    assert values(spark, ["  a b\t ", "  ", None], clean.trimmed) == ["a b", "", None]
    assert values(spark, ["　", " x "], clean.text_or_null) == [None, "x"]


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("1234.5", 1234.5),
        (" $1,234.50 ", 1234.5),
        ("-3", -3.0),
        (".5", 0.5),
        ("1e3", 1000.0),
        ("", None),
        ("N/A", None),
        ("NaN", None),
        ("Infinity", None),
        ("1e400", None),
        ("1.0d", None),
        ("2f", None),
        ("1 2", None),
        (None, None),
    ],
)
def test_money(spark, text, number):
    assert values(spark, [text], clean.money) == [number]


def test_flexible_number(spark):
    inputs = ["24,945.00", "7", "", None, "$5", "abc"]
    assert values(spark, inputs, clean.flexible_number) == [24945.0, 7.0, None, None, None, None]
    assert values(spark, inputs, clean.is_bad_flexible_number) == [
        False, False, False, False, True, True,
    ]


def test_dates(spark):
    day = datetime.date(2024, 7, 1)
    inputs = ["2024-07-01", "07/01/2024", "7/1/2024", "July", "", None]
    assert values(spark, inputs, clean.parsed_date) == [day, day, day, None, None, None]


def test_damaged_bytes_become_one_mark_per_run(spark):
    df = spark.createDataFrame([(bytearray(b"caf\xe9\xe8 ol\xe9"),)], "b binary")
    text = F.col("b").cast("string")
    row = df.select(
        clean.repaired_utf8(text).alias("a"), clean.repaired_utf8(text, " ").alias("b")
    ).first()
    assert row.a == "caf� ol�"
    assert row.b == "caf  ol "


def test_modifiers(spark):
    assert values(spark, ["26|TC", "", None, "26 59"], clean.split_modifiers) == [
        ["26", "TC"], None, None, ["26 59"],
    ]
    df = spark.createDataFrame([(["26", "TC"],), ([],), (None,)], "m array<string>")
    assert [r[0] for r in df.select(clean.joined_modifiers(F.col("m"))).collect()] == [
        "26|TC", None, None,
    ]


def test_prices(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (None, None)], "c double, g double")
    c, g = F.col("c"), F.col("g")
    got = df.select(clean.display_price(c, g), clean.display_price_kind(c, g)).collect()
    assert [tuple(r) for r in got] == [(1.0, "Cash Price"), (2.0, "Gross Charge"), (None, None)]
