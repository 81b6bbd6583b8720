"""District panel and enrolment to the published state-year-race table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.cleaning import state_prefix
from ..functions.metrics import percent_or_null, round_to
from ..functions.nulls import sum0
from ..operators import columns as K
from ..operators.guards import guard
from ..operators.merge import merge_many, merge_one
from ..operators.reshape import reshape_long
from ..operators.rollup import collapse, lookup_from

GROUPS = [*V.RACES, V.SUM_RACE]


def sample(df: DataFrame, reported: str, rule: str = "reported") -> DataFrame:
    """Rows that enter the denominators: ``all`` of them, or those whose outcome was ``reported``."""
    if rule not in ("all", "reported"):
        raise ValueError(f"unknown sample rule {rule!r}")
    return df.filter(F.col(reported).isNotNull()) if rule == "reported" else df


def attach(enrolment: DataFrame, panel: DataFrame, many: bool = False) -> DataFrame:
    """Enrolment rows with their outcome; unmatched rows of either side are dropped."""
    if many:
        return merge_many(enrolment, panel, V.DISTRICT_KEY, keep=["both"])
    return merge_one([enrolment, panel], V.DISTRICT_KEY, keep=["both"])


def fill_state(df: DataFrame) -> DataFrame:
    """FIPS from the district id and STATE_CODE from the lookup the rows themselves imply."""
    with_fips = df.withColumn("FIPS", state_prefix("LEAID"))
    codes = lookup_from(with_fips, "FIPS", "STATE", "STATE_CODE")
    merged = merge_many(with_fips, codes, ["FIPS"], keep=["left", "both"])
    return K.order(merged, "YEAR", "LEAID", "STATE", "FIPS", "STATE_CODE")


def state_sums(df: DataFrame, columns: list[str], counted: Column | None = None) -> DataFrame:
    """Sums by year and filled-in state, in one pass over the district rows.

    Same result as ``fill_state`` followed by ``collapse``, without the self-join: the rows are
    first summed by (YEAR, FIPS, STATE), which leaves a few rows per state, and the state name is
    settled among those.  ``counted`` limits the sums, not the rows the names are learnt from.
    """
    name = F.nullif(F.col("STATE"), F.lit(""))
    inside = F.lit(True) if counted is None else counted
    small = df.groupBy("YEAR", state_prefix("LEAID").alias("FIPS"), name.alias("STATE")).agg(
        F.max(inside).alias("_counted"), *[sum0(F.when(inside, F.col(c))).alias(c) for c in columns]
    )
    fips = W.partitionBy("FIPS")
    # the least name but one: of the names other than the first
    first = F.min("STATE").over(fips)
    small = small.withColumn("_later", F.when(F.col("STATE") != first, F.col("STATE")))
    settled = small.withColumns(
        {
            "_first": F.min("STATE").over(fips),
            "_last": F.max("STATE").over(fips),
            "_second": F.min("_later").over(fips),
            "_blank": F.max(F.col("STATE").isNull()).over(fips),
        }
    )
    # A blank gives way to names; without one, two names lose the first, as the lookup does.
    alone, two = F.col("_first") == F.col("_last"), F.col("_second") == F.col("_last")
    fine = F.col("_first").isNull() | alone | (~F.col("_blank") & two)
    settled = guard(settled, fine, F.concat(F.lit("several states share FIPS "), F.col("FIPS")))
    code = F.when(F.col("_blank"), F.col("_first")).otherwise(F.col("_last")).alias("STATE_CODE")
    counted_rows = settled.filter("_counted").select("YEAR", code, *columns)
    return collapse(counted_rows, ["YEAR", "STATE_CODE"], columns)


def outcome_columns(topic: str) -> list[str]:
    prefix = V.outcome(topic)
    return [f"ENR_{g}" for g in GROUPS] + [f"{prefix}_{g}" for g in GROUPS]


def corporal_punishment_table(enrolment: DataFrame, panel: DataFrame, rule: str = "reported", unit: int = 5) -> DataFrame:
    """YEAR, STATE_CODE, race, CORP_, ENR_: eight rows per state and year, rounded for disclosure."""
    rows = sample(attach(enrolment, panel), f"CORP_{V.SUM_RACE}", rule)
    sums = state_sums(rows, outcome_columns("CP"))
    long = reshape_long(sums, ["CORP_", "ENR_"], "race", sorted(GROUPS))
    return K.apply_to(long, ["ENR_", "CORP_"], lambda c: round_to(c, unit)) if unit else long


def suspension_table(enrolment: DataFrame, panel: DataFrame, rule: str = "reported", unit: int = 0) -> DataFrame:
    """YEAR, STATE_CODE, race, OSS_, ENR_, pct_.  Not rounded as published; ``unit=5`` rounds.

    State names are learnt from all matched rows, the sums from the sampled ones.
    """
    rows = attach(enrolment, panel, many=True)
    reported = F.col(f"OSS_{V.SUM_RACE}").isNotNull() if rule == "reported" else None
    sums = state_sums(rows, outcome_columns("OSS"), reported)
    long = reshape_long(sums, ["OSS_", "ENR_"], "race", sorted(GROUPS))
    if unit:
        long = K.apply_to(long, ["ENR_", "OSS_"], lambda c: round_to(c, unit))
    percent = long.withColumn("pct_", percent_or_null("OSS_", "ENR_"))
    return K.replace_by(percent, race=F.when(F.col("race") == V.SUM_RACE, "total").otherwise(F.col("race")))
