"""Data-quality checks.  Each returns rows of (check, n), so a report is their union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollup import duplicate_keys


def _rows(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check"), "n")


def exclusive(df: DataFrame, one: Column, other: Column, check: str = "both standards") -> DataFrame:
    """Rows for which two conditions that exclude each other both hold."""
    return _rows(df.filter(one & other), check)


def unique_key(df: DataFrame, on: Sequence[str], check: str = "repeated keys") -> DataFrame:
    """Surplus rows on a key that should be unique."""
    surplus = duplicate_keys(df, on).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    return surplus.select(F.lit(check).alias("check"), "n")


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys on the left only, on the right only, and on both."""
    on = list(on)
    sides = [d.select(*on, F.lit(s).alias("_side")) for s, d in ((1, left), (2, right))]
    keys = sides[0].unionByName(sides[1]).groupBy(*on).agg(
        F.max(F.col("_side") == 1).alias("_l"), F.max(F.col("_side") == 2).alias("_r")
    )
    counts = keys.agg(
        F.count_if(F.col("_l") & ~F.col("_r")).alias("left only"),
        F.count_if(~F.col("_l") & F.col("_r")).alias("right only"),
        F.count_if(F.col("_l") & F.col("_r")).alias("matched"),
    )
    return counts.unpivot([], ["left only", "right only", "matched"], "check", "n")


def covered(df: DataFrame, column: str, check: str = "values covered") -> DataFrame:
    """Distinct non-null values of a column, such as the years of a panel."""
    return _rows(df.select(column).dropna().distinct(), check)


def totals_differ(df: DataFrame, reported: str, summed: str, check: str = "totals differ") -> DataFrame:
    """Rows whose reported total is not the sum of its parts; two nulls agree."""
    return _rows(df.filter(~F.col(reported).eqNullSafe(F.col(summed))), check)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
