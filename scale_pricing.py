"""Times ways to sum amounts over many line items; prints one JSON line.

    python scale_pricing.py FOLDER [COPIES]

Makes the table once in FOLDER, from COPIES copies (100) of the line items of ``BENCH_SF_DIR``,
and leaves it there for the next run. ``BENCH_CPUS`` is the number of local threads.
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from tallymark.operators import pricing_summary
from tallymark.sources import read_table

RUNS = 3
FILES = 32


def grouped(lineitem, amount):
    """Sum quantity, discounted price and discount of each group, each amount as given."""
    quantity, price, discount = map(amount, ("l_quantity", "l_extendedprice", "l_discount"))
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(quantity), F.sum(price * (1 - discount)), F.avg(discount), F.count("*")
    )


def ways(lineitem):
    """Return the ways to sum by name."""
    return {
        "doubles": grouped(lineitem, F.col),
        "decimals": grouped(lineitem, lambda name: F.col(name).cast("decimal(15, 2)")),
        "checked longs": pricing_summary(lineitem),
    }


def timed(frame):
    """Return the seconds that one run takes."""
    start = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    """Make the table if it is not there, then time each way, the best of some runs."""
    folder, copies = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 100
    cpus = os.environ.get("BENCH_CPUS", "8")
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not (Path(folder) / "lineitem.parquet" / "_SUCCESS").exists():
        copy = F.explode(F.sequence(F.lit(1), F.lit(copies)))
        rows = read_table(spark, source, "lineitem").withColumn("copy", copy).drop("copy")
        rows.repartition(FILES).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    lineitem = read_table(spark, folder, "lineitem")
    report = {"rows": lineitem.count(), "cpus": cpus, "seconds": {}}
    for name, frame in ways(lineitem).items():
        report["seconds"][name] = round(min(timed(frame) for _ in range(RUNS)), 2)
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
