"""The pricing summary: results against plain arithmetic, edge cases, and its plan."""

import re
from contextlib import redirect_stdout
from datetime import UTC, date, datetime
from decimal import ROUND_HALF_UP, Decimal
from io import StringIO
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from tallymark.operators import pricing_summary, shipped_through
from tallymark.plans import PRICING_SUMMARY_SQL, pricing_summary_query
from tallymark.sources import read_table

from conftest import TESTDATA

SCHEMA = (
    "l_quantity double, l_extendedprice double, l_discount double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)
DAY = datetime(2000, 1, 1)


def rounded(value, places):
    return value.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def by_hand(rows):
    """Summarise rows without nulls one by one, in decimals."""

    def key(row):
        return row["l_returnflag"], row["l_linestatus"]

    def amount(row, name):
        return Decimal(str(row[name]))

    result = []
    for group, members in groupby(sorted(rows, key=key), key):
        lines = list(members)
        price = sum(amount(r, "l_extendedprice") * (1 - amount(r, "l_discount")) for r in lines)
        discount = sum(amount(r, "l_discount") for r in lines)
        result.append(
            (
                *group,
                sum(amount(r, "l_quantity") for r in lines),
                rounded(price, 2),
                rounded(discount / len(lines), 6),
                len(lines),
            )
        )
    return result


def summary_of(spark, rows):
    return sorted(map(tuple, pricing_summary(spark.createDataFrame(rows, SCHEMA)).collect()))


@pytest.mark.parametrize("last", [date(1996, 5, 1), date(2000, 12, 1), date(2030, 1, 1)])
def test_equals_row_by_row_arithmetic(spark, last):
    lineitem = read_table(spark, str(TESTDATA / "sf0.001"), "lineitem")
    end = datetime(last.year, last.month, last.day)
    rows = [row for row in lineitem.collect() if row["l_shipdate"] <= end]
    assert rows
    result = pricing_summary(shipped_through(lineitem, last)).collect()
    assert sorted(map(tuple, result)) == by_hand(rows)


def test_price_is_rounded_half_up_from_the_exact_sum(spark):
    # 0.50 less 1 % is 0.495 and 0.01 less 50 % is 0.005: both exact halves of a cent.
    rows = [
        (1.0, 0.50, 0.01, "A", "F", DAY),
        (1.0, 0.01, 0.50, "B", "F", DAY),
        (1.0, -0.01, 0.50, "C", "F", DAY),
    ]
    assert [row[3] for row in summary_of(spark, rows)] == [
        Decimal("0.50"),
        Decimal("0.01"),
        Decimal("-0.01"),
    ]


def test_nulls_are_skipped_by_sums_and_average_but_counted(spark):
    rows = [
        (None, 10.0, 0.10, "A", "F", DAY),
        (2.0, None, 0.30, "A", "F", DAY),
        (3.0, 30.0, None, "A", "F", DAY),
    ]
    assert summary_of(spark, rows) == [
        ("A", "F", Decimal("5.00"), Decimal("9.00"), Decimal("0.200000"), 3)
    ]


def test_group_of_nulls_only_has_null_totals(spark):
    rows = [(None, None, None, "A", "F", DAY)]
    assert summary_of(spark, rows) == [("A", "F", None, None, None, 1)]


def test_null_keys_form_a_group(spark):
    rows = [(1.0, 1.0, 0.0, None, "F", DAY), (2.0, 2.0, 0.0, None, "F", DAY)]
    assert summary_of(spark, rows) == [
        (None, "F", Decimal("3.00"), Decimal("3.00"), Decimal("0.000000"), 2)
    ]


def test_no_rows_give_no_groups(spark):
    assert pricing_summary(spark.createDataFrame([], SCHEMA)).collect() == []


def test_amount_with_three_decimals_fails(spark):
    with pytest.raises(Exception, match="not an amount with two decimals: 1.005"):
        summary_of(spark, [(1.0, 1.005, 0.0, "A", "F", DAY)])


def test_last_shipdate_is_included_to_the_microsecond(spark):
    rows = [
        (1.0, 1.0, 0.0, "A", "F", stamp)
        for stamp in (
            datetime(2000, 11, 30, 23, 59, 59, 999999),
            datetime(2000, 12, 1),
            datetime(2000, 12, 1, 0, 0, 0, 1),
            None,
        )
    ]
    lineitem = spark.createDataFrame(rows, SCHEMA)
    assert shipped_through(lineitem, date(2000, 12, 1)).count() == 2
    assert shipped_through(lineitem, datetime(2000, 12, 1)).count() == 2
    assert shipped_through(lineitem, datetime(2000, 12, 1, 0, 0, 0, 1)).count() == 3


@pytest.mark.parametrize("last", [date(2000, 12, 1), datetime(2000, 12, 1)])
@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Pacific/Auckland"])
def test_session_time_zone_does_not_matter(spark, conf, zone, last):
    conf("spark.sql.session.timeZone", zone)
    lineitem = read_table(spark, str(TESTDATA / "sf0.001"), "lineitem")
    expected = lineitem.where("l_shipdate <= timestamp_ntz'2000-12-01'").count()
    assert shipped_through(lineitem, last).count() == expected


def test_zoned_cutoff_is_refused(spark):
    lineitem = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="no time zone"):
        shipped_through(lineitem, datetime(2000, 12, 1, tzinfo=UTC))


def test_zoned_shipdate_is_refused(spark, conf):
    # With this option off, Spark reads the column as zoned and the cutoff would shift.
    conf("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    lineitem = read_table(spark, str(TESTDATA / "sf0.001"), "lineitem")
    with pytest.raises(ValueError, match="timestamp_ntz"):
        shipped_through(lineitem, date(2000, 12, 1))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_group_that_holds_nearly_all_rows(spark, conf, adaptive):
    conf("spark.sql.adaptive.enabled", adaptive)
    lineitem = read_table(spark, str(TESTDATA / "sf0.01"), "lineitem")
    hot = F.col("l_orderkey") % 50 != 0
    skewed = lineitem.withColumns(
        {
            "l_returnflag": F.when(hot, "A").otherwise(F.col("l_returnflag")),
            "l_linestatus": F.when(hot, "F").otherwise(F.col("l_linestatus")),
        }
    ).repartition(16)
    assert sorted(map(tuple, pricing_summary(skewed).collect())) == by_hand(skewed.collect())


def test_result_does_not_depend_on_the_partitioning(spark):
    lineitem = read_table(spark, str(TESTDATA / "sf0.01"), "lineitem")
    results = {
        tuple(sorted(map(tuple, pricing_summary(lineitem.repartition(n)).collect())))
        for n in (1, 7, 40)
    }
    assert len(results) == 1


def plan_of(frame, mode="simple"):
    out = StringIO()
    with redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_products_beyond_a_long_are_exact(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    rows = [
        (1.0, 1e12, -1e6, "A", "F", DAY),
        (2.3e13, 2.3e13, 0.5, "B", "F", DAY),
        (1.0, -1e12, -1e6, "C", "F", DAY),
        (1.0, 0.01, 2.3e13, "D", "F", DAY),
        (1.0, 2.3e13, None, "E", "F", DAY),
    ]
    got = summary_of(spark, rows)
    assert [row[3] for row in got] == [
        Decimal("1000001000000000000.00"),
        Decimal("11500000000000.00"),
        Decimal("-1000001000000000000.00"),
        Decimal("-229999999999.99"),
        None,
    ]
    assert got[1][2] == Decimal("23000000000000.00")
    assert got[3][4] == Decimal("23000000000000.000000")


@pytest.mark.parametrize("last", [date(1995, 3, 1), datetime(1995, 3, 1), datetime(1995, 3, 1, 7)])
@pytest.mark.parametrize("zone", ["UTC", "Pacific/Auckland"])
def test_shipdate_may_be_a_date(spark, conf, last, zone):
    conf("spark.sql.session.timeZone", zone)
    days = [date(1995, 2, 28), date(1995, 3, 1), date(1995, 3, 2), None]
    lineitem = spark.createDataFrame([(day,) for day in days], "l_shipdate date")
    assert shipped_through(lineitem, last).count() == 2


@pytest.fixture(scope="module")
def by_day(spark, tmp_path_factory):
    """Line items with dates: one table sorted by day in small row groups, one partitioned."""
    folder = tmp_path_factory.mktemp("days")
    lineitem = read_table(spark, str(TESTDATA / "sf0.01"), "lineitem")
    dated = lineitem.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    ordered = dated.coalesce(1).sortWithinPartitions("l_shipdate")
    ordered = ordered.write.option("parquet.block.size", 200_000)
    ordered.parquet(str(folder / "sorted" / "lineitem.parquet"))
    months = dated.withColumn("l_shipdate", F.trunc("l_shipdate", "month")).coalesce(1)
    months.write.partitionBy("l_shipdate").parquet(str(folder / "parts" / "lineitem.parquet"))
    return folder


@pytest.mark.parametrize("layout", ["sorted", "parts"])
def test_query_over_dates_equals_its_sql(spark, by_day, layout):
    files = by_day / layout / "lineitem.parquet" / "**" / "*.parquet"
    with duckdb.connect() as connection:
        connection.execute(
            f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{files}', hive_partitioning = true)"
        )
        expected = connection.execute(PRICING_SUMMARY_SQL).fetchall()
    result = pricing_summary_query(spark, str(by_day / layout)).collect()
    assert sorted(map(tuple, result)) == sorted(expected) and result


def rows_scanned(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("layout", ["sorted", "parts"])
def test_early_cutoff_reads_few_rows_of_dates(spark, conf, by_day, layout):
    conf("spark.sql.adaptive.enabled", "false")
    lineitem = read_table(spark, str(by_day / layout), "lineitem")
    early = shipped_through(lineitem, date(1995, 6, 15))
    kept = early.count()
    assert 0 < kept < 6_000
    assert rows_scanned(pricing_summary(early)) < 3 * kept
    assert rows_scanned(pricing_summary(shipped_through(lineitem, date(2030, 1, 1)))) == 60_000


@pytest.mark.parametrize("sign", [1, -1])
def test_average_on_a_tie_equals_its_sql(spark, tmp_path, sign):
    # A sum of 0.15 over 20,000 rows is 0.0000075 exactly, which rounds away from zero.
    rows = spark.range(20_000).select(
        F.lit(1.0).alias("l_quantity"),
        F.lit(1.0).alias("l_extendedprice"),
        F.when(F.col("id") < 15, sign * 0.01).otherwise(0.0).alias("l_discount"),
        F.lit("A").alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
        F.lit("1999-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    with duckdb.connect() as connection:
        files = tmp_path / "lineitem.parquet" / "*.parquet"
        connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{files}'")
        expected = connection.execute(PRICING_SUMMARY_SQL).fetchall()
    result = list(map(tuple, pricing_summary_query(spark, str(tmp_path)).collect()))
    assert result == expected and result[0][4] == sign * 0.000008


def test_scan_reads_the_columns_used_and_filters_on_a_bare_one(spark):
    plan = plan_of(pricing_summary_query(spark, str(TESTDATA / "sf0.001")), "formatted")
    assert "LessThanOrEqual(l_shipdate,2000-12-01T00:00)" in plan
    columns = re.search(r"ReadSchema: struct<(.*)>", plan)[1].split(",")
    assert {column.split(":")[0] for column in columns} == {
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    }


def test_work_stays_in_generated_code_around_one_shuffle(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")
    plan = plan_of(pricing_summary_query(spark, str(TESTDATA / "sf0.001")))
    # A star before the step marks generated code.
    steps = re.findall(r"^[ :+-]*(\*?)(?:\(\d+\) )?([A-Z]\w+)\b(?! Plan)", plan, re.MULTILINE)
    assert steps == [
        ("*", "HashAggregate"),
        ("", "Exchange"),
        ("*", "HashAggregate"),
        # Amounts to longs, then their product, then the rare products that are decimals.
        ("*", "Project"),
        ("*", "Project"),
        ("*", "Project"),
        ("*", "Filter"),
        ("*", "ColumnarToRow"),
        ("", "FileScan"),
    ]


def test_each_task_sends_one_row_per_group(spark, conf):
    conf("spark.sql.adaptive.enabled", "true")
    lineitem = read_table(spark, str(TESTDATA / "sf0.01"), "lineitem").repartition(4)
    summary = pricing_summary(lineitem)
    groups = len(summary.collect())
    # The plan is printed from its end, so the first shuffle is the one of the aggregation.
    shuffled = re.search(r"rowCount=(\d+)", plan_of(summary, "formatted"))
    assert int(shuffled[1]) == 4 * groups
