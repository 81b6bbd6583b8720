"""Data-quality checks counted on the way of the job that writes a table, without a job or a read of their own.

A check is one or more counts over the rows, and the helper columns they need.  ``Watch`` adds the helpers, counts by
``DataFrame.observe`` and takes the helpers off again, so the rows pass as they are.  Counts belong in the last stage of the job: a lost
executor may have an earlier stage run twice, and its counts with it.  ``sources.io.write_table`` puts them there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import quote

# True on the rows of the table itself; a match with another table adds rows for the keys that only that one has.
HERE = "_here"


def _as_is(df: DataFrame) -> DataFrame:
    return df


class Check(NamedTuple):
    """Counts by name, from the flag of the table's own rows, and what must be added to the rows before."""

    counts: Callable[[Column], dict[str, Column]]
    prepare: Callable[[DataFrame], DataFrame] = _as_is


def exclusive(one: Column, other: Column, check: str = "both standards") -> Check:
    """Rows for which two conditions that exclude each other both hold."""
    return Check(lambda here: {check: F.count_if(here & one & other)})


def totals_differ(reported: str, summed: str, check: str = "totals differ") -> Check:
    """Rows whose reported total is not the sum of its parts; two nulls agree."""
    return Check(lambda here: {check: F.count_if(here & ~F.col(reported).eqNullSafe(F.col(summed)))})


def covered(column: str, check: str = "values covered") -> Check:
    """Distinct non-null values of a column with a short list of values, such as the years of a panel."""
    return Check(lambda here: {check: F.size(F.collect_set(F.when(here, F.col(quote(column))))).cast("bigint")})


def unique_key(on: Sequence[str], check: str = "repeated keys") -> Check:
    """Surplus rows on a key that should be unique.  Rows that are already dealt by the key, or by part of it, do not move."""
    copy = f"_copy of {', '.join(on)}"
    number = F.row_number().over(W.partitionBy(*on).orderBy(F.col(HERE).desc_nulls_last()))
    return Check(lambda here: {check: F.count_if(here & (F.col(quote(copy)) > 1))}, lambda df: df.withColumn(copy, number))


def matched(right: DataFrame, on: Sequence[str], checks: Sequence[str] = ("left only", "right only", "matched")) -> Check:
    """Keys of the rows only, of another table only, and of both.  Each key counts once and null keys match; rows of one key meet, so
    the rows are those of a table that is rolled up to a few rows a key."""
    on = list(on)
    there, first = f"_there {', '.join(on)}", f"_first of {', '.join(on)}"
    renamed = {k: f"{there}|{k}" for k in on}

    def prepare(df: DataFrame) -> DataFrame:
        keys = right.select(*on).distinct().select(*[F.col(quote(k)).alias(n) for k, n in renamed.items()], F.lit(True).alias(there))
        number = F.row_number().over(W.partitionBy(*on).orderBy(F.col(HERE).desc_nulls_last()))
        same = reduce(lambda a, b: a & b, [F.col(quote(k)).eqNullSafe(F.col(quote(n))) for k, n in renamed.items()])
        return df.withColumn(first, number == 1).join(keys, F.col(HERE) & same, "full").drop(*renamed.values())

    def counts(here: Column) -> dict[str, Column]:
        other, one = F.col(quote(there)).isNotNull(), F.col(quote(first))
        return dict(zip(checks, (F.count_if(here & one & ~other), F.count_if(other & ~here), F.count_if(here & one & other)), strict=True))

    return Check(counts, prepare)


class Watch:
    """Checks on the rows of one job.

    >>> watch = Watch(unique_key(["LEAID", "YEAR"]), covered("YEAR"))
    >>> io.write_table(panel, path, watch=watch)
    >>> watch.report(spark)
    """

    def __init__(self, *checks: Check):
        self.checks = checks
        self.seen = Observation()
        self.columns: list[str] = []
        self.names: list[str] = []

    def prepare(self, df: DataFrame) -> DataFrame:
        """The rows with the helper columns, and with rows that ``count`` takes away again."""
        self.columns = df.columns
        return reduce(lambda rows, check: check.prepare(rows), self.checks, df.withColumn(HERE, F.lit(True)))

    def count(self, df: DataFrame) -> DataFrame:
        """Counts the rows as they pass, and gives them back as they were."""
        here = F.coalesce(F.col(HERE), F.lit(False))
        counts = {name: value for check in self.checks for name, value in check.counts(here).items()}
        self.names = list(counts)
        watched = df.observe(self.seen, *[value.alias(name) for name, value in counts.items()])
        return watched.filter(here).select(*map(quote, self.columns))

    def report(self, spark: SparkSession) -> DataFrame:
        """Rows (check, n), once the job has run."""
        found = self.seen.get
        return spark.createDataFrame([(name, found[name]) for name in self.names], "check string, n bigint")
