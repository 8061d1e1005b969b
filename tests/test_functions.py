"""Ledger items of the source dialect, one small frame each."""

from datetime import date

from pyspark.sql import functions as F

from strata.functions import (decode, first_match, full_name, guarded_idiv, has_outer_blanks, idiv,
                              month_boundaries, sign_label, trunc_avg, year_boundaries, yyyymmdd_to_date)


def test_boundary_differences(spark):
    df = spark.createDataFrame(
        [(date(2023, 1, 31), date(2023, 2, 1)), (date(2022, 12, 31), date(2023, 1, 1)),
         (date(2023, 5, 5), date(2023, 5, 5)), (date(2023, 3, 15), date(2022, 1, 20))], "a date, b date")
    out = df.select(month_boundaries("a", "b").alias("m"), year_boundaries("a", "b").alias("y")).collect()
    assert [(r.m, r.y) for r in out] == [(1, 0), (1, 1), (0, 0), (-14, -1)]


def test_integer_division_truncates_toward_zero(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (5, 0)], "a int, b int")
    got = [r[0] for r in df.select(idiv(F.col("a"), F.nullif("b", F.lit(0)))).collect()]
    assert got == [3, -3, -3, None]


def test_truncating_average_skips_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    assert df.agg(trunc_avg("x")).first()[0] == 1  # 5 // 3
    neg = spark.createDataFrame([(-1,), (-2,), (-2,)], "x int")
    assert neg.agg(trunc_avg("x")).first()[0] == -1  # -5 / 3 truncates to -1


def test_full_name_treats_null_as_empty(spark):
    df = spark.createDataFrame([("Ann", "Lee"), (None, "Lee"), ("Ann", None), (None, None)], "f string, l string")
    assert [r[0] for r in df.select(full_name("f", "l")).collect()] == ["Ann Lee", " Lee", "Ann ", " "]


def test_yyyymmdd_to_date(spark):
    df = spark.createDataFrame([(20230115,), (0,), (None,), (20235,), (202301151,), (20231301,), (20230229,),
                                (-2023011,)], "d int")
    got = [r[0] for r in df.select(yyyymmdd_to_date("d")).collect()]
    assert got == [date(2023, 1, 15), None, None, None, None, None, None, None]


def test_decode_trims_and_upper_cases(spark):
    df = spark.createDataFrame([(" s ",), ("M",), ("x",), (None,), ("",)], "c string")
    mapping = [(["S"], "Single"), (["M"], "Married")]
    assert [r[0] for r in df.select(decode("c", mapping)).collect()] == ["Single", "Married", "n/a", "n/a", "n/a"]


def test_first_match_tiers_overlap_and_null(spark):
    df = spark.createDataFrame([(99,), (100,), (500,), (501,), (1000,), (1001,), (None,)], "cost int")
    c = F.col("cost")
    tier = first_match([(c < 100, "Below 100"), (c.between(100, 500), "100-500"),
                        (c.between(500, 1000), "500-1000")], "Above 1000")
    assert [r[0] for r in df.select(tier).collect()] == [
        "Below 100", "100-500", "100-500", "500-1000", "500-1000", "Above 1000", "Above 1000"]


def test_sign_label_and_guarded_division(spark):
    df = spark.createDataFrame([(10, 3), (-4, 0), (None, 2)], "n long, d long")
    out = df.select(sign_label("n", "up", "down", "flat").alias("s"),
                    guarded_idiv("n", "d", F.col("n")).alias("q")).collect()
    assert [(r.s, r.q) for r in out] == [("up", 3), ("down", -4), ("flat", None)]


def test_previous_day_and_month_label(spark):
    df = spark.createDataFrame([(date(2023, 6, 5),)], "d date")
    r = df.select(F.date_sub("d", 1).alias("prev"), F.date_format("d", "yyyy-MMM").alias("label"),
                  F.trunc("d", "MM").alias("month")).first()
    assert (r.prev, r.label, r.month) == (date(2023, 6, 4), "2023-Jun", date(2023, 6, 1))


def test_blank_check_binary_or_source_collation(spark):
    df = spark.createDataFrame([("a ",), (" a",), ("a",), (None,)], "s string")
    binary = [r[0] for r in df.select(has_outer_blanks("s")).collect()]
    source = [r[0] for r in df.select(has_outer_blanks("s", source_collation=True)).collect()]
    assert binary == [True, True, False, None]
    assert source == [False, True, False, None]  # trailing blanks are invisible to the source's comparison
