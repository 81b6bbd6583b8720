"""Grouped roll-ups, tabulations and duplicate counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import quote, sum0, sum_na
from .ranges import running


def collapse(
    df: DataFrame, by: Sequence[str], sums: Sequence[str] = (), maxima: Sequence[str] = (), dealt: bool = False
) -> DataFrame:
    """Sums with nulls as 0 and maxima that skip nulls, per group; a null key is a group of its own.

    ``dealt`` is for wide rows in many groups: a task that meets rows of all groups holds as many rows of sums as it reads and folds
    next to nothing.  Rows are dealt by a hash of the key first, in parts of bounded size; a part that is too large, as of one group
    with very many rows, is split, and the few sums of each part meet in the usual way.
    """
    by = list(by)
    if dealt:
        df = df.withColumn("_part", F.xxhash64(*[F.col(quote(c)) for c in by])).hint("rebalance", F.col("_part"))
    return df.groupBy(*by).agg(
        *[sum0(c).alias(c) for c in sums], *[F.max(quote(c)).alias(c) for c in maxima if c not in by]
    )


def sum_groups(df: DataFrame, by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Group sums in which one null makes the group null; ``sums`` maps new name to source column."""
    return df.groupBy(*by).agg(*[sum_na(c).alias(n) for n, c in sums.items()])


def tabulate(df: DataFrame, column: str) -> DataFrame:
    """Count, percent and cumulative percent per value, in value order; nulls are left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    table = running(counts, column, "n", "_running", "_total")
    return table.select(
        column,
        "n",
        (F.lit(100.0) * F.col("n") / F.col("_total")).alias("percent"),
        (F.lit(100.0) * F.col("_running") / F.col("_total")).alias("cum_percent"),
    )


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def duplicates_report(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """How many rows sit in groups of 1, 2, 3 ... copies, and how many of them are surplus."""
    groups = df.groupBy(*on).agg(F.count(F.lit(1)).alias("copies"))
    rows, keys = F.sum("copies"), F.count(F.lit(1))
    return groups.groupBy("copies").agg(rows.alias("observations"), (rows - keys).alias("surplus"))


def dup_index(df: DataFrame, by: Sequence[str], order: str, into: str = "dup") -> DataFrame:
    """Distinct ``(by, order)`` rows with 0 in groups of one and 1, 2, ... in larger groups.

    Blank and null text is one value, null, and ranks first.  Rows are made distinct before they are
    numbered, so a key with many rows costs nothing; a group is as large as the list of different
    names one code has.
    """
    by = list(by)
    value = F.nullif(F.col(order), F.lit(""))
    pairs = df.select(*by, value.alias(order)).distinct()
    group = W.partitionBy(*by)
    number = F.row_number().over(group.orderBy(F.col(order).asc_nulls_first()))
    alone = F.count(F.lit(1)).over(group) == 1
    return pairs.select(*by, order, F.when(alone, 0).otherwise(number).alias(into))


def lookup_from(df: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """Dimension derived from the rows themselves: per key the named value rather than the blank one.

    A key with a blank and two names keeps both, and the m:1 merge that follows must then fail.
    """
    return dup_index(df, [key], value).filter(F.col("dup") != 1).select(key, F.col(value).alias(into))
