"""State-year-race tables to tidy series of rates, risk ratios and risk differences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.cleaning import rewrite_year
from ..functions.nulls import in_, not_in, ratio, sum_na_where
from ..operators.reshape import pivot_longer
from ..operators.rollup import sum_groups

# Sample years, states and chart limits of the published series.
FIRST_YEAR = 1975
LAST_YEAR_LEFT_OUT = 2020
UNIVERSE_YEARS = [1976, 2000, 2011, 2013, 2015, 2017, 2020]
NEVER_ALLOWED_STATES = ["NJ", "MA"]
OUTLAWED_AFTER = 2020
CHART_YEARS = (1970, 2020)
CHART_LIMITS = {
    "cp_rate": (0.0, 0.075),
    "oss_rate": (0.0, 0.165),
    "cp_risk": (0.0, 4.0),
    "oss_risk": (-0.05, 4.0),
    "oss_risk_2020": (-0.05, 4.25),
}

COHORTS = ("all", "always", "sometime")


@dataclass(frozen=True)
class Topic:
    """Column names and year bounds of one topic's state table."""

    count: str
    base: str
    total: str
    rate: str
    count_sum: str
    base_sum: str


CP = Topic("CORP_", "ENR_", "sumrace", "cp_rate", "cp_sum", "enr_sum")
OSS = Topic("OSS_", "ENR_", "total", "oss_rate", "oss_sum", "oss_mem")


def law_cohort(laws: DataFrame, states: DataFrame) -> DataFrame:
    """State codes that never fully banned the practice.

    ``laws`` has state (full name), corporal_punishment, year_outlawed; ``states`` has state (code)
    and state_name.
    """
    dimension = states.select(F.col("state").alias("STATE_CODE"), "state_name").distinct()
    allowed = (
        (F.col("corporal_punishment") == "Yes")
        | (F.col("corporal_punishment") == "Not Mentioned")
        | (F.col("year_outlawed") > OUTLAWED_AFTER)
    )
    named = laws.withColumnRenamed("state", "state_name")
    return named.join(dimension, "state_name", "inner").filter(allowed).select("STATE_CODE")


def in_cohort(
    table: DataFrame, cohort: str, allowed: DataFrame | None = None, excluded: Sequence[str] = NEVER_ALLOWED_STATES
) -> DataFrame:
    """Rows of one cohort: ``always`` keeps the allowed states, ``sometime`` the rest but ``excluded``.

    A null state is in no list, so ``sometime`` keeps it.  The lists stay DataFrames; Spark
    broadcasts them when they are small.
    """
    if cohort == "all":
        return table
    codes = allowed.select("STATE_CODE").distinct()
    if cohort == "always":
        return table.join(codes, "STATE_CODE", "left_semi")
    if cohort == "sometime":
        return table.join(codes, "STATE_CODE", "left_anti").filter(not_in("STATE_CODE", excluded))
    raise ValueError(f"unknown cohort {cohort!r}")


def tag_cohorts(
    table: DataFrame, allowed: DataFrame, excluded: Sequence[str] = NEVER_ALLOWED_STATES
) -> DataFrame:
    """Each row once per cohort it belongs to, so that one aggregate serves all three.

    Meant for the state table, whose size is (years x states x races); the copies add at most one
    row per row.
    """
    flags = allowed.select("STATE_CODE").distinct().withColumn("_allowed", F.lit(True))
    marked = table.join(flags, "STATE_CODE", "left")
    cohort = (
        F.when(F.col("_allowed"), F.array(F.lit("all"), F.lit("always")))
        .when(not_in("STATE_CODE", excluded), F.array(F.lit("all"), F.lit("sometime")))
        .otherwise(F.array(F.lit("all")))
    )
    return marked.select(*[F.col(c) for c in table.columns], F.explode(cohort).alias("cohort"))


def without_year(table: DataFrame, year: int | None = LAST_YEAR_LEFT_OUT) -> DataFrame:
    """Rows of other years; a null year is dropped as well, as a filter does."""
    return table if year is None else table.filter(F.col("YEAR") != year)


def suspension_input(table: DataFrame, base: str = "MEM_") -> DataFrame:
    """Suspension table as the series read it: 2021 counts as 2020, membership is the base."""
    out = table.withColumn("YEAR", rewrite_year("YEAR", 2021, 2020))
    return out.withColumnRenamed(base, "ENR_") if base in out.columns and base != "ENR_" else out


def rate_series(
    table: DataFrame,
    topic: Topic = CP,
    first_year: int | None = FIRST_YEAR,
    drop_null_state: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Yearly rate per racial group, HP counted with AI, with label and line class.

    One missing count makes its group's sum missing.  Filters on year and group are stated after
    the sum and pushed below it by the optimizer.
    """
    rows = table.dropna(subset=["STATE_CODE"]) if drop_null_state else table
    rows = rows.withColumn("race_fixed", M.merge_group("race"))
    sums = sum_groups(rows, [*by, "YEAR", "race_fixed"], {topic.count_sum: topic.count, topic.base_sum: topic.base})
    rates = sums.withColumn(topic.rate, ratio(topic.count_sum, topic.base_sum))
    if first_year is not None:
        rates = rates.filter(F.col("YEAR") >= first_year)
    labelled = rates.withColumns(
        {"legend_text": M.group_label("race_fixed", topic.total), "size": M.series_class("race_fixed", topic.total)}
    )
    return labelled.filter(in_("race_fixed", M.COMPARED_GROUPS))


def risk_series(
    table: DataFrame, topic: Topic = CP, first_year: int | None = FIRST_YEAR, by: Sequence[str] = ()
) -> DataFrame:
    """Yearly risk ratios and differences of six pairs, long, with the wide counts beside them.

    The sum per group and its pivot to one row per year are one aggregate, which also makes the
    long rows distinct.
    """
    ids = [*by, "YEAR"]
    rows = table.filter(F.col("race") != topic.total).withColumn("race_adjusted", M.other_group("race"))
    if first_year is not None:
        rows = rows.filter(F.col("YEAR") >= first_year)
    wide = rows.groupBy(*ids).agg(
        *[
            sum_na_where("race_adjusted", g, value).alias(f"{name}_{g}")
            for name, value in (("ENR", topic.base), ("CORP", topic.count))
            for g in [*M.COMPARED_GROUPS, M.OTHER]
        ]
    )
    compared = wide.withColumns(M.risk_columns("CORP_", "ENR_"))
    long = pivot_longer(compared, M.RISK_TYPES, "type", "value")
    return long.withColumn("legend_text", M.type_label("type"))


def universe(series: DataFrame, years: Sequence[int] = UNIVERSE_YEARS) -> DataFrame:
    """Years in which every district was surveyed.

    The list names 2020 although the series leave that year out; it is kept as published.
    """
    return series.filter(in_("YEAR", years))


def chart_ready(
    series: DataFrame,
    value: str = "value",
    limits: tuple[float, float] = CHART_LIMITS["cp_risk"],
    years: tuple[int, int] = CHART_YEARS,
    types: Sequence[str] | None = M.CHART_TYPES,
) -> DataFrame:
    """Points that a chart shows: its types, its axis ranges, in drawing order per line."""
    shown = series if types is None else series.filter(in_("type", types))
    inside = F.col("YEAR").between(*years) & F.col(value).between(*limits)
    return shown.filter(inside).orderBy("legend_text", "YEAR")


def all_cohorts(table: DataFrame, allowed: DataFrame, topic: Topic = CP, **options) -> DataFrame:
    """Rate series of the three cohorts from one pass over the state table."""
    return rate_series(tag_cohorts(table, allowed), topic, by=["cohort"], **options)

