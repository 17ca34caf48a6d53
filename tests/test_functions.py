"""Column functions: dates, rounding, bands, keyed draws, text."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.bands import age_band, age_band_order
from cohortspark.functions.dates import days_between, parse_yyyymmdd
from cohortspark.functions.keyed import keyed_uniform
from cohortspark.functions.numeric import clamp, percent, round_cast_int, round_dp
from cohortspark.functions.text import grouped_int, label_or_fallback, plain_number
from cohortspark.plans.oracle import ku


def test_parse_yyyymmdd(spark):
    df = spark.createDataFrame([(20080103,), (19991231,), (None,)], "d int")
    got = [r[0] for r in df.select(parse_yyyymmdd(F.col("d"))).collect()]
    assert got == [dt.date(2008, 1, 3), dt.date(1999, 12, 31), None]


def test_parse_invalid_strict_fails_lenient_nulls(spark):
    df = spark.createDataFrame([(20081301,)], "d int")
    with pytest.raises(Exception):
        df.select(parse_yyyymmdd(F.col("d"))).collect()
    assert df.select(parse_yyyymmdd(F.col("d"), strict=False)).collect()[0][0] is None


def test_days_between_order(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 1, 11))], "a date, b date")
    assert df.select(days_between(F.col("b"), F.col("a"))).collect()[0][0] == 10


def test_round_dp_ties_match_duckdb(spark):
    xs = [1.005, 2.675, 0.125, -0.125, 1.5, 25.545]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_dp(F.col("x"), 2)).collect()]
    con = duckdb.connect()
    want = [
        con.execute(f"SELECT CAST(ROUND(CAST({x}::DOUBLE AS DECIMAL(28,10)), 2) AS DOUBLE)").fetchone()[0]
        for x in xs
    ]
    assert got == want


def test_round_cast_int_half_even_like_sql_cast(spark):
    xs = [0.5, 1.5, 2.5, 18.5, -2.5, 3.2, 3.7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_cast_int(F.col("x"))).collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT CAST({x}::DOUBLE AS INTEGER)").fetchone()[0] for x in xs]
    assert got == want


def test_clamp_ignores_null_bounds(spark):
    df = spark.createDataFrame([(5.0, 1.0, 4.0), (0.0, 1.0, 4.0), (2.0, None, None)], "v double, lo double, hi double")
    got = [r[0] for r in df.select(clamp(F.col("v"), F.col("lo"), F.col("hi"))).collect()]
    assert got == [4.0, 1.0, 2.0]


def test_percent_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1, 3), (0, 0)], "a long, b long")
    got = [r[0] for r in df.select(percent(F.col("a"), F.col("b"))).collect()]
    assert got == [33.3, None]


@pytest.mark.parametrize(
    "age,band,order",
    [(19, "<20", 1), (20, "20-40", 2), (39, "20-40", 2), (40, "40-60", 3), (59, "40-60", 3), (60, "60+", 4),
     (-22, "<20", 1), (None, None, None)],
)
def test_age_band_edges(spark, age, band, order):
    df = spark.createDataFrame([(age,)], "a int")
    row = df.select(age_band(F.col("a")).alias("b")).select("b", age_band_order(F.col("b"))).collect()[0]
    assert (row[0], row[1]) == (band, order)


def test_keyed_uniform_matches_sql_and_is_stable(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    got = {r[0]: r[1] for r in df.select("k", keyed_uniform(F.col("k"), salt="s")).collect()}
    con = duckdb.connect()
    want = dict(con.execute(f"SELECT k, {ku('s', 'k')} FROM range(0, 2000) t(k)").fetchall())
    assert got == want
    assert all(0.0 <= v < 1.0 for v in got.values())
    again = {r[0]: r[1] for r in df.repartition(13).select("k", keyed_uniform(F.col("k"), salt="s")).collect()}
    assert again == got


def test_text_helpers(spark):
    df = spark.createDataFrame([(None, 7, 1234567, 26.0), ("", 8, 5, 25.5), ("Name", 9, 0, 100.0)],
                               "n string, i int, c long, v double")
    rows = df.select(
        label_or_fallback(F.col("n"), F.col("i")), grouped_int(F.col("c")), plain_number(F.col("v"))
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("Condition 7", "1,234,567", "26"),
        ("Condition 8", "5", "25.5"),
        ("Name", "0", "100"),
    ]
