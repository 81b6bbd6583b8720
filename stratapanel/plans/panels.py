"""Long panels of districts and schools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.nulls import rowtotal_missing
from ..operators import columns as K
from ..operators.guards import guard
from ..operators.merge import stack_panel
from ..operators.reshape import append
from ..sources import io
from .waves import race_partials, reported_partials


def add_race_totals(panel: DataFrame, topic: str) -> DataFrame:
    """Race totals of a stacked district panel, a reported total before a summed one, and their sum."""
    prefix = V.outcome(topic)
    totals = []
    for race in V.RACES:
        cells = [c for c in V.total_cells(topic, race) if c in panel.columns]
        options = [F.col(f"{prefix}_{race}")] if f"{prefix}_{race}" in panel.columns else []
        options += [rowtotal_missing(cells)] if cells else []
        value = F.coalesce(*options) if options else F.lit(None)
        totals.append(value.cast("bigint").alias(f"{prefix}_{race}"))
    names = [f"{prefix}_{r}" for r in V.RACES]
    sumrace = f"{prefix}_{V.SUM_RACE}"
    rest = [c for c in panel.columns if c not in {*V.DISTRICT_KEY, *names, sumrace}]
    with_totals = panel.select(*V.DISTRICT_KEY, *totals, *rest)
    with_sum = with_totals.withColumn(sumrace, rowtotal_missing(names))
    return K.order(with_sum, "YEAR", "LEAID", *names, sumrace)


def lea_panel(by_year: dict[int, Sequence[DataFrame]], topic: str) -> DataFrame:
    """District panel with all columns: years stacked, tables of one year merged, totals added."""
    return add_race_totals(stack_panel(by_year, V.DISTRICT_KEY), topic)


def school_panel(by_year: dict[int, Sequence[DataFrame]]) -> DataFrame:
    """School panel: tables of one year merged 1:1 on school and year, years stacked."""
    return stack_panel(by_year, V.SCHOOL_KEY)


def add_wave(spark: SparkSession, path: str, year: int, tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Put one wave into the panel at ``path``, in place of what it holds of that year; other years are neither read nor written.

    The wave's tables are merged 1:1 with their keys checked, and a row of another year stops the job.  The panel may be new.
    """
    wave = stack_panel({year: tables}, on)
    wave = guard(wave, F.col("YEAR").eqNullSafe(F.lit(year)), F.concat(F.lit(f"a row of another year than {year}: "), F.coalesce(F.col("YEAR").cast("string"), F.lit("null"))))
    io.replace_partitions(wave, path)
    return io.read_panel(spark, path)


def lea_totals(
    topic: str,
    schools: Sequence[DataFrame] = (),
    districts: Sequence[DataFrame] = (),
    historic: Sequence[DataFrame] = (),
) -> DataFrame:
    """The race totals of ``lea_panel`` straight from the tables, in one shuffle.

    A total is a sum over schools, tables, sexes and disability groups, so each row first adds up
    its own cells; the sums of all waves then meet in one ``groupBy`` with map-side partials.  No
    wide table is collapsed and nothing is joined, so a district with a third of all rows costs
    nothing extra.  The same aggregate counts rows, and a district-year that is twice in one of the
    district tables stops the job.
    """
    prefix = V.outcome(topic)
    parts = [race_partials(t, topic, suppressed_as_zero=True) for t in schools]
    whole = [race_partials(t, topic, suppressed_as_zero=False) for t in districts]
    whole += [reported_partials(t, topic) for t in historic]
    # which district table a row is from; a district-year may be in each of them once
    parts += [t.withColumn("_table", F.lit(i)) for i, t in enumerate(whole)]
    stacked = append(*parts)
    once = [F.expr(f"count_if(_table = {i})") for i in range(len(whole))]
    sums = [F.sum(f"summed_{r}").alias(f"summed_{r}") for r in V.RACES if f"summed_{r}" in stacked.columns]
    reports = [F.max(f"reported_{r}").alias(f"reported_{r}") for r in V.RACES if f"reported_{r}" in stacked.columns]
    grouped = stacked.groupBy(*V.DISTRICT_KEY).agg(*sums, *reports, F.greatest(*once, F.lit(0), F.lit(0)).alias("_rows"))
    where = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in V.DISTRICT_KEY])
    grouped = guard(grouped, F.col("_rows") <= 1, F.concat(F.lit("not unique in a district table: "), where)).drop("_rows")

    def total(race: str):
        options = [c for c in (f"reported_{race}", f"summed_{race}") if c in grouped.columns]
        return F.coalesce(*options, F.lit(None).cast("bigint")).alias(f"{prefix}_{race}")

    totals = grouped.select("YEAR", "LEAID", *[total(r) for r in V.RACES])
    return totals.withColumn(f"{prefix}_{V.SUM_RACE}", rowtotal_missing([f"{prefix}_{r}" for r in V.RACES]))
