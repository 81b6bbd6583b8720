"""The plans this library chose against the plain ones they replace, on the test tables.

Prints one JSON line per choice: seconds (median of BENCH_RUNS after a warm-up) and shuffles.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from stratapanel.catalog import base as B  # noqa: E402
from stratapanel.catalog import merges, surveys  # noqa: E402
from stratapanel.functions import vocabulary as V  # noqa: E402
from stratapanel.operators.crosswalk import fact_cells  # noqa: E402
from stratapanel.operators.merge import merge_one  # noqa: E402
from stratapanel.operators.rollup import collapse  # noqa: E402
from stratapanel.plans import panels, series, waves  # noqa: E402
from stratapanel.session import local_session  # noqa: E402


def chained_joins(spark, sf):
    tables = [merges._flag_sums(spark, sf, f, n) for f, n in (("R", "y"), ("A", "z"), ("N", "w"))]
    plain = [t.withColumnRenamed("x", f"x{i}") for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.join(b, "l_orderkey", "full_outer"), plain)


def one_merge(spark, sf):
    tables = [merges._flag_sums(spark, sf, f, n) for f, n in (("R", "y"), ("A", "z"), ("N", "w"))]
    return merge_one(tables, ["l_orderkey"])


def three_passes(spark, sf):
    table, allowed = B.state_long(spark, sf), B.allowed_states(spark, sf)
    parts = [
        series.rate_series(series.in_cohort(table, c, allowed, B.EXCLUDED_STATES)).withColumn("cohort", F.lit(c))
        for c in series.COHORTS
    ]
    return reduce(DataFrame.unionByName, parts)


def one_pass(spark, sf):
    tagged = series.tag_cohorts(B.state_long(spark, sf), B.allowed_states(spark, sf), B.EXCLUDED_STATES)
    return series.rate_series(tagged, by=["cohort"])


def _school(spark, sf):
    return waves.table_2011(surveys.raw_2011(surveys.school_cells(spark, sf), False), "CORP", False, declared=True)


def unpivot_first(spark, sf):
    school = _school(spark, sf)
    fact = fact_cells(school, V.DISTRICT_KEY, waves.measures_of(school))
    return collapse(fact, [*V.DISTRICT_KEY, "measure", "gender", "race", "status"], ["value"])


def roll_up_first(spark, sf):
    return waves.lea_fact(_school(spark, sf))


def totals_by_merges(spark, sf):
    historic, nodis, dis, modern = surveys._panel_tables(spark, sf)
    by_year = {1997: [historic], 2011: [waves.to_lea(nodis), waves.to_lea(dis)], 2013: [waves.to_lea(modern)]}
    names = [f"CORP_{g}" for g in [*V.RACES, V.SUM_RACE]]
    return panels.lea_panel(by_year, "CP").select(*V.DISTRICT_KEY, *names)


CHOICES = {
    "three tables merged": (chained_joins, one_merge),
    "three cohorts": (three_passes, one_pass),
    "long fact": (unpivot_first, roll_up_first),
    "panel totals": (totals_by_merges, surveys.lea_panel_totals),
}


def measure(run, spark, sf, runs):
    def once():
        start = time.perf_counter()
        run(spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once()
    plan = run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    return {"seconds": round(statistics.median(once() for _ in range(runs)), 2), "shuffles": plan.count("Exchange hashpartitioning")}


if __name__ == "__main__":
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    # Broadcasts off, so that the plans are those of tables too large for one.
    session = local_session("choices", os.environ.get("BENCH_CPUS", "*"), **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    session.sparkContext.setLogLevel("ERROR")
    for label, (plain, chosen) in CHOICES.items():
        runs = int(os.environ.get("BENCH_RUNS", "3"))
        print(json.dumps({"choice": label, "plain": measure(plain, session, folder, runs), "chosen": measure(chosen, session, folder, runs)}), flush=True)
    session.stop()
