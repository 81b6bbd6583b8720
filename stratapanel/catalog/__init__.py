"""The library's operators run over the star-schema test tables, each with the SQL it must agree with.

The tables stand in for survey data: customer = district, order = school, nation = state, region =
law group, order year = survey year, line status = sex, return flag = disability status, supplier
number modulo seven = racial group, quantity = enrolment, quantity of returned lines = outcome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cleaning, merges, rollups, series, shapes, stata, surveys

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (series, rollups, cleaning, merges, shapes, stata, surveys)


def queries() -> dict[str, Query]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
