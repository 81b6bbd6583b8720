"""Running totals and numbers over all values of a table, without one task that sees them all.

The values are written once and counted on the way.  Where they are many, Spark deals them into ranges of about ``RANGE_ROWS`` by its
own sample, as many as their number asks for; each range is worked on by itself and the totals of the ranges before it are added.  No
value comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import io

RANGE_ROWS = 1_000_000


def ranged(values: DataFrame, column: str, into: str = "_range") -> DataFrame:
    """``values`` (distinct in ``column``, without nulls) with the number of the range each belongs to, as a written table."""
    spark, seen = values.sparkSession, Observation()
    path = io.shared_dir(spark, "values")
    io.write_table(values.observe(seen, F.count(F.lit(1)).alias("n")), path)
    held = io.read_table(spark, path)
    ranges = -(-seen.get["n"] // RANGE_ROWS)
    if ranges <= 1:
        return held.withColumn(into, F.lit(0))
    # the sample is drawn once: what reads the numbers reads the written ones
    dealt = held.repartitionByRange(ranges, column).withColumn(into, F.spark_partition_id())
    path = io.shared_dir(spark, "ranges")
    io.write_table(dealt, path)
    return io.read_table(spark, path)


def running(values: DataFrame, column: str, amount: str, into: str, total: str) -> DataFrame:
    """Adds the running sum of ``amount`` in the order of ``column``, and its sum over all rows."""
    cut = ranged(values, column)
    within = W.partitionBy("_range").orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = cut.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    # a row for each range
    every = W.partitionBy(F.lit(0))
    before = every.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(every).alias(total)
    )
    summed = cut.withColumn("_within", F.sum(amount).over(within)).join(offsets, "_range")
    return summed.withColumn(into, F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")
