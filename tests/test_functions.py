import numpy as np
import pandas as pd
import pytest

from opsmeter.functions import numbers, text, times


def evaluate(spark, kind, values, sql):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r[0] for r in frame.selectExpr("i", f"{sql} AS r").orderBy("i").select("r").collect()]


def test_blank_knows_every_white_space_character(spark):
    values = [None, "", "  ", "\t", "\xa0", " 　\x1f", "a", " a ", ".", "​"]
    expected = [v is None or v.strip() == "" for v in values]
    assert evaluate(spark, "STRING", values, text.is_blank("v")) == expected
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_email_shape(spark):
    import re

    values = [
        "a@b.c", "a@b", " a@b.c", "a@@b.c", "a@b.c\n", "a@b.c\n\n", "a@b.c\r", "a@b.c ",
        "a\xa0b@c.d", "a@b.c.d", "@b.c", "a@.c", "a@b.", "ä@ö.ü", "a@b.c\x85", "", "a.b@c",
    ]
    expected = [bool(re.match(text.EMAIL_SHAPE, v)) for v in values]
    assert evaluate(spark, "STRING", values, text.has_email_shape("v")) == expected


def test_outside_counts_null(spark):
    assert evaluate(spark, "STRING", ["US", "us", None, "it's"], text.outside("v", ["US", "it's"])) == [
        False,
        True,
        True,
        False,
    ]


@pytest.mark.parametrize(
    "value",
    [-12.5, -0.0, 0.0, -1e7, -123456789.25, -1e15, -1e16, -1.5e22, -1e-4, -1e-5, -0.00123,
     -1.25e-7, float("-inf"), float("inf"), -1.2345678901234567e-4, 9999999.0, 1e7, 0.1 + 0.2],
)
def test_float_text_is_the_shortest_decimal(spark, value):
    assert evaluate(spark, "DOUBLE", [value], text.float_text("v")) == [repr(value)]


def test_parse_number_reads_what_pandas_reads(spark):
    values = [
        "nan", "1d", "1f", "1,000", " 2 ", "inf", "-inf", "Infinity", "+INF", "0x10", "0x1p3", "1_000",
        "True", "+5", ".5", "5.", "1e3", "1e400", "-0", "\t3\n", "", "- 5", "e5", "1E+05", "1e", ".",
        None, "12.75", "-0.01", "٣",
    ]
    expected = pd.to_numeric(pd.Series(values, dtype=object), errors="coerce")
    result = evaluate(spark, "STRING", values, numbers.parse_number("v"))
    assert [np.nan if r is None else r for r in result] == pytest.approx(list(expected), nan_ok=True)


def test_parse_timestamp(spark):
    values = ["2024-01-05", "2024-01-05 10:00:00.5", "2024-01-05T10:00:00", "2024-02-30", "x", "",
              None, "9999-12-31", "1600-01-01", "2262-04-11"]
    stamps = evaluate(spark, "STRING", values, f"CAST({times.parse_timestamp('v')} AS STRING)")
    assert stamps == [
        "2024-01-05 00:00:00",
        "2024-01-05 10:00:00.5",
        "2024-01-05 10:00:00",
        None,
        None,
        None,
        None,
        None,
        None,
        "2262-04-11 00:00:00",
    ]


def test_durations_ignore_the_session_zone(spark):
    frame = spark.sql(
        f"""SELECT {times.micros_between("a", "b")} AS micros
            FROM VALUES (TIMESTAMP_NTZ '2024-03-31 01:30:00', TIMESTAMP_NTZ '2024-03-31 03:30:00.000001')
            AS t(a, b)"""
    )
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert frame.collect()[0][0] == 7_200_000_001
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ratios_round_half_up(spark):
    sql = f"""SELECT {numbers.rounded_rate("3", "96", 4)},
                     {numbers.rounded_rate("1", "0", 4)},
                     {numbers.rounded_ratio("1", "0", 4)},
                     {numbers.rounded_ratio("1912419", "(2 * 100)", 2)},
                     {numbers.rounded_rate("-1", "4000", 4)}"""
    assert list(spark.sql(sql).collect()[0]) == [0.0313, 0.0, None, 9562.1, -0.0003]


def test_first_largest_and_clamp(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, 5, 5), (7, 7, 7), (1, 2, 3) AS t(a, b, c)")
    named = numbers.first_largest({"x": "a", "y": "b", "z": "c"})
    assert [r[0] for r in frame.selectExpr(named).collect()] == ["y", "x", "z"]
    clamped = [numbers.clamp(v, 0.0, 100.0) for v in ("-5D", "50D", "500D", "CAST(NULL AS DOUBLE)")]
    assert list(spark.sql("SELECT " + ", ".join(clamped)).collect()[0]) == [0.0, 50.0, 100.0, 100.0]
