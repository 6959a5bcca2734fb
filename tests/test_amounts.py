"""Exact amounts: conversion to hundredths and sums of any size, in any order."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallymark.functions import exact_sum, hundredths, large_amount, units

AMOUNT = "amount double"
CENTS = st.integers(min_value=-(2**51), max_value=2**51)


def to_hundredths(spark, values):
    frame = spark.createDataFrame([(value,) for value in values], AMOUNT)
    return [row[0] for row in frame.select(hundredths("amount")).collect()]


def test_amounts_whose_product_with_100_is_not_whole(spark):
    # 0.29 * 100 is 28.999999999999996 and 1.15 * 100 is 114.99999999999999 in doubles.
    amounts = [0.29, 1.15, -0.29, 0.57, 104999.91]
    assert to_hundredths(spark, amounts) == [29, 115, -29, 57, 10499991]


def test_zero_negative_zero_and_null(spark):
    assert to_hundredths(spark, [0.0, -0.0, None]) == [0, 0, None]


def test_every_cent_of_a_range_converts(spark):
    cents = spark.range(-1_000_000, 1_000_000)
    amounts = cents.select("id", (F.col("id") / 100).alias("amount"))
    assert amounts.where(hundredths("amount") != F.col("id")).count() == 0


@pytest.mark.parametrize("power", range(40, 52))
def test_large_amounts_convert(spark, power):
    # An odd stride visits all residues; the last value is 2 ** power itself.
    cents = spark.range(2**power, 2**power - 2**20, -7)
    amounts = cents.select("id", (F.col("id") / 100).alias("amount"))
    assert amounts.where(hundredths("amount") != F.col("id")).count() == 0


@pytest.mark.parametrize(
    "value", [0.125, 0.001, 1234.5678, float("nan"), float("inf"), float("-inf"), 1e300]
)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_other_values_fail_the_query(spark, conf, value, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    frame = spark.createDataFrame([(1.0,), (value,)], AMOUNT)
    with pytest.raises(Exception, match="not an amount with two decimals"):
        frame.select(hundredths("amount"), large_amount("amount")).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_amounts_beyond_the_longs_are_decimals(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    values = [2.3e13, -2.3e13, 22517998136852.49, 1e20, 1.5, None]
    frame = spark.createDataFrame([(value,) for value in values], AMOUNT)
    got = [tuple(r) for r in frame.select(hundredths("amount"), large_amount("amount")).collect()]
    assert got == [
        (None, Decimal("23000000000000.00")),
        (None, Decimal("-23000000000000.00")),
        (None, Decimal("22517998136852.49")),
        (None, Decimal("100000000000000000000.00")),
        (150, None),
        (None, None),
    ]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_sum_of_longs_that_would_wrap(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    frame = spark.createDataFrame([(sign * 2**62,) for sign in (1, 1, 1)], "units long")
    assert frame.agg(exact_sum("units", 2)).first()[0] == Decimal(3 * 2**62) / 100
    frame = spark.createDataFrame([(-(2**63),), (-(2**63),), (2**63 - 1,)], "units long")
    assert frame.agg(exact_sum("units", 0)).first()[0] == -(2**63) - 1


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_sum_of_large_amounts(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    values = [(2.3e13,), (0.01,), (None,), (1e20,), (-0.02,)]
    frame = spark.createDataFrame(values, AMOUNT)
    frame = frame.select(units("amount").alias("u"), large_amount("amount").alias("l"))
    assert frame.agg(exact_sum("u", 2, "l")).first()[0] == Decimal("100000023000000000000") - Decimal("0.01")
    only = frame.where("u IS NULL")
    assert only.agg(exact_sum("u", 2, "l")).first()[0] == Decimal("100000023000000000000")
    assert only.where("l IS NULL").agg(exact_sum("u", 2, "l")).first()[0] is None


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_total_of_too_many_digits_fails(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    frame = spark.createDataFrame([(9e35,), (9e35,)], AMOUNT)
    frame = frame.select(units("amount").alias("u"), large_amount("amount").alias("l"))
    with pytest.raises(Exception, match="more than 38 digits"):
        frame.agg(exact_sum("u", 2, "l")).collect()


@pytest.mark.parametrize("name", ["it's", "back`tick", "a.b", "a b", "back\\slash"])
def test_any_column_name_works(spark, name):
    frame = spark.createDataFrame([(1.25,), (2.3e13,)], AMOUNT).toDF(name)
    frame = frame.select(units(name).alias(name), large_amount(name).alias("l"))
    assert frame.agg(exact_sum(name, 2, "l")).first()[0] == Decimal("23000000000001.25")
    wrong = spark.createDataFrame([(0.001,)], AMOUNT).toDF(name)
    with pytest.raises(Exception, match="not an amount with two decimals"):
        wrong.select(units(name)).collect()


def test_four_decimals(spark):
    frame = spark.createDataFrame([(1.2345,), (-0.0001,), (7.0,)], AMOUNT)
    assert [row[0] for row in frame.select(units("amount", 4)).collect()] == [12345, -1, 70000]
    total = frame.select(units("amount", 4).alias("u")).agg(exact_sum("u", 4)).first()[0]
    assert total == Decimal("8.2344")
    with pytest.raises(Exception, match="not an amount with four decimals"):
        spark.createDataFrame([(1.00001,)], AMOUNT).select(units("amount", 4)).collect()


@settings(
    max_examples=20,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(cents=st.lists(CENTS, min_size=1, max_size=50))
def test_conversion_and_sum_equal_whole_number_arithmetic(spark, cents):
    frame = spark.createDataFrame([(value / 100,) for value in cents], AMOUNT)
    units = frame.select(hundredths("amount").alias("units"))
    assert sorted(row[0] for row in units.collect()) == sorted(cents)
    total = units.agg(exact_sum("units", 2)).first()[0]
    assert total == Decimal(sum(cents)) / 100


@pytest.mark.parametrize("sign", [1, -1])
def test_sum_beyond_a_long(spark, sign):
    # 20,000 times 10**15 is more than twice the largest long.
    units = spark.range(20_000).select((F.lit(sign * 10**15) + sign * F.col("id")).alias("units"))
    total = units.agg(exact_sum("units", 4)).first()[0]
    assert total == Decimal(sign * sum(10**15 + i for i in range(20_000))) / 10_000


def test_sum_of_mixed_signs_and_nulls(spark):
    frame = spark.createDataFrame([(150,), (-275,), (None,), (-1,), (99,)], "units long")
    assert frame.agg(exact_sum("units", 2)).first()[0] == Decimal("-0.27")


def test_sum_of_nothing_is_null(spark):
    frame = spark.createDataFrame([(None,), (None,)], "units long")
    assert frame.agg(exact_sum("units", 2)).first()[0] is None
    assert frame.where("false").agg(exact_sum("units", 2)).first()[0] is None


def test_sum_does_not_depend_on_the_partitioning(spark):
    # 0.1 has no exact double, so adding doubles drifts; the sum of hundredths must not.
    rows = spark.range(100_000).select(
        F.round(F.col("id") % 97 / 100 + 1000, 2).alias("amount")
    )
    units = rows.select(hundredths("amount").alias("units"))
    expected = Decimal(sum(i % 97 + 100_000 for i in range(100_000))) / 100
    for parts in (1, 3, 64):
        assert units.repartition(parts).agg(exact_sum("units", 2)).first()[0] == expected
