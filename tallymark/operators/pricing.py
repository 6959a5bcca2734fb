"""Totals over line items."""

from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, TimestampNTZType

from tallymark.functions import exact_sum, large_amount, units


def shipped_through(lineitem: DataFrame, last: date | datetime) -> DataFrame:
    """Keep the line items shipped at ``last`` or before.

    ``l_shipdate`` is a date or a timestamp without time zone, also as the column that a table
    is partitioned by; so ``last`` must have no time zone. A date is at or before a point of
    time exactly when it is at or before its day. A Python datetime would reach Spark as a
    zoned timestamp and put a cast around the column; the text form keeps the column bare and
    the comparison free of the session's time zone.
    """
    kind = lineitem.schema["l_shipdate"].dataType
    if isinstance(last, datetime) and last.tzinfo is not None:
        raise ValueError("l_shipdate has no time zone; pass a datetime without one")
    if kind == DateType():
        day = last.date() if isinstance(last, datetime) else last
        return lineitem.where(F.col("l_shipdate") <= F.lit(day))
    if kind != TimestampNTZType():
        raise ValueError("l_shipdate must be a date or a timestamp_ntz, without time zone")
    return lineitem.where(F.col("l_shipdate") <= F.lit(last.isoformat()).cast("timestamp_ntz"))


def pricing_summary(lineitem: DataFrame) -> DataFrame:
    """Summarise quantity, discounted price and discount per return flag and line status.

    Sums and the average skip nulls as in SQL; the row count does not. Results are exact
    decimals, the price rounded half up to cents and the average to six decimals, whatever the
    amounts and whether ANSI mode is on. Rows are aggregated before the only shuffle, so a
    group that holds most of the table still sends one row per task.
    """
    keys = ("l_returnflag", "l_linestatus")
    amounts = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    lines = lineitem.select(
        *keys,
        *(units(column).alias(name) for name, column in amounts.items()),
        *(large_amount(column).alias(f"large_{name}") for name, column in amounts.items()),
    )
    # Hundredths times hundredths: the price after discount has four decimals. A discount of
    # at most 2,000 % keeps the product within a long; the rest is multiplied as decimals.
    lines = lines.withColumn(
        "disc_price", F.expr("CASE WHEN abs(discount) <= 200000L THEN price * (100 - discount) END")
    )

    def whole(name):
        small = f"CAST({name} AS DECIMAL(20, 0)) * 0.01BD"
        return f"CAST(coalesce(large_{name}, {small}) AS DECIMAL(38, 2))"

    lines = lines.withColumn(
        "large_disc_price",
        F.expr(
            f"""
            CASE WHEN disc_price IS NULL
                AND (price IS NOT NULL OR large_price IS NOT NULL)
                AND (discount IS NOT NULL OR large_discount IS NOT NULL)
            THEN coalesce(
                try_multiply({whole("price")}, try_subtract(1BD, {whole("discount")})),
                CAST(raise_error('a discounted price has more than 38 digits') AS DECIMAL(38, 4))
            ) END
            """
        ),
    )
    count = F.count("discount") + F.count("large_discount")
    return lines.groupBy(*keys).agg(
        exact_sum("quantity", 2, "large_quantity").alias("sum_qty"),
        F.round(exact_sum("disc_price", 4, "large_disc_price"), 2).alias("sum_disc_price"),
        F.round(exact_sum("discount", 2, "large_discount") / count, 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )
