"""The pricing summary as a query, with the SQL that checks it."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.operators import pricing_summary, shipped_through
from tallymark.sources import read_table

LAST_SHIPDATE = date(2000, 12, 1)


def pricing_summary_query(spark: SparkSession, data_dir: str) -> DataFrame:
    """Run the pricing summary over all line items shipped through 2000-12-01.

    The table holds its amounts as doubles, so the exact sums are given back as doubles.
    """
    lineitem = read_table(spark, data_dir, "lineitem")
    summary = pricing_summary(shipped_through(lineitem, LAST_SHIPDATE))
    return summary.withColumns(
        {name: F.col(name).cast("double") for name in ("sum_qty", "sum_disc_price", "avg_disc")}
    )


# Whole hundredths and HUGEINT sums: exact, and rounded half up by whole-number division. The
# text with an exponent is read as the nearest double.
PRICING_SUMMARY_SQL = f"""
WITH lines AS (
    SELECT
        l_returnflag,
        l_linestatus,
        CAST(round(l_quantity * 100) AS HUGEINT) AS quantity,
        CAST(round(l_extendedprice * 100) AS HUGEINT) AS price,
        CAST(round(l_discount * 100) AS HUGEINT) AS discount
    FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '{LAST_SHIPDATE} 00:00:00'
),
totals AS (
    SELECT
        l_returnflag,
        l_linestatus,
        sum(quantity) AS quantity,
        sum(price * (100 - discount)) AS disc_price,
        sum(discount) AS discount,
        count(discount) AS count_disc,
        count(*) AS count_order
    FROM lines
    GROUP BY l_returnflag, l_linestatus
)
SELECT
    l_returnflag,
    l_linestatus,
    CAST(CAST(quantity AS VARCHAR) || 'e-2' AS DOUBLE) AS sum_qty,
    CAST(CAST(sign(disc_price) * ((abs(disc_price) + 50) // 100) AS VARCHAR) || 'e-2' AS DOUBLE)
        AS sum_disc_price,
    CAST(CAST(
        sign(discount) * ((abs(discount) * 20000 + count_disc) // (2 * count_disc)) AS VARCHAR
    ) || 'e-6' AS DOUBLE) AS avg_disc,
    count_order
FROM totals
"""
