"""Roll-ups, tabulations, duplicate counts and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import round_to
from ..functions.nulls import rowtotal, rowtotal_missing
from ..operators import rollup, watch
from ..sources import io
from . import base as B

CELLS = [f"{p}{r}" for p in ("ENR_", "CORP_") for r in B.RACES]


def collapse_school_to_lea(spark, sf):
    schools = B.school_years(spark, sf).withColumn("LEAID", B.district_id())
    return rollup.collapse(schools, ["LEAID"], CELLS, ["YEAR"])


LEA_SQL = f"""WITH {B.FACT}
SELECT lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS "LEAID", max("YEAR") AS "YEAR",
{", ".join(f"{B.group_sum(v, r)} AS {p}{r}" for p, v in (("ENR_", "enr"), ("CORP_", "corp")) for r in B.RACES)}
FROM fact GROUP BY 1"""


def collapse_lea_to_state(spark, sf):
    leas = B.lea_years(spark, sf).join(B.customer_states(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return rollup.collapse(leas, ["YEAR", "STATE_CODE"], B.WIDE)


def collapse_null_as_zero(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    kept = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    value = lines.select("l_orderkey", F.when(kept, F.col("l_quantity").cast("bigint")).alias("qty"), "l_linenumber")
    return rollup.collapse(value, ["l_orderkey"], ["qty"], ["l_linenumber"])


def sum_na_propagating(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    rows = lines.select("l_orderkey", F.nullif(F.col("l_quantity").cast("bigint"), F.lit(25)).alias("qty"))
    return rollup.sum_groups(rows, ["l_orderkey"], {"qty_sum": "qty"})


def nullable_cells(spark, sf):
    """Per order, outcome per racial group with a null where the group has no outcome; orders without any too."""
    lines = B.table(spark, sf, "lineitem")
    qty = F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint")).alias("qty")
    rows = lines.select("l_orderkey", B.race_code().alias("race"), qty)
    return rows.groupBy("l_orderkey").agg(*[F.sum(F.when(F.col("race") == r, F.col("qty"))).alias(r) for r in B.RACES])


NULLABLE = f"""nullable AS (SELECT l_orderkey, {", ".join(
    f"CAST(sum(CASE WHEN race = '{r}' THEN qty END) AS BIGINT) AS {'AS_' if r == 'AS' else r}" for r in B.RACES)}
  FROM (SELECT l_orderkey, {B.RACE_SQL} AS race, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END AS qty FROM lineitem)
  GROUP BY l_orderkey)"""
FEW = ["HP", "MR", "AI"]


def rowtotal_zero(spark, sf):
    return nullable_cells(spark, sf).select("l_orderkey", rowtotal(FEW).alias("total"))


def rowtotal_missing_query(spark, sf):
    return nullable_cells(spark, sf).select("l_orderkey", rowtotal_missing(FEW).alias("total"))


def round_to_five(spark, sf):
    leas = B.lea_years(spark, sf)
    return leas.select("o_custkey", "YEAR", round_to("ENR_sumrace").alias("enr"), round_to("CORP_sumrace").alias("corp"))


def tab_year(spark, sf):
    return rollup.tabulate(B.table(spark, sf, "orders").select(B.year_of().alias("YEAR")), "YEAR")


def duplicates_report(spark, sf):
    return rollup.duplicates_report(B.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def key_uniqueness(spark, sf):
    return rollup.duplicate_keys(B.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def count_if(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    returned, open_ = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    return rollup.count_where(lines, both=returned & open_, either=returned | open_, neither=~(returned | open_))


def state_pairs(spark, sf):
    """Districts with a FIPS code and a state name that is blank for part of them."""
    rows = B.table(spark, sf, "customer").join(B.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.format_string("%02d", F.col("n_nationkey")).alias("FIPS"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("n_name")).alias("STATE"),
    )


PAIRS = """pairs AS (SELECT DISTINCT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS FIPS,
  CASE WHEN c_acctbal >= 0 THEN n_name END AS STATE FROM customer JOIN nation ON c_nationkey = n_nationkey),
dups AS (SELECT FIPS, STATE, CASE WHEN count(*) OVER (PARTITION BY FIPS) = 1 THEN 0
  ELSE CAST(row_number() OVER (PARTITION BY FIPS ORDER BY STATE NULLS FIRST) AS INTEGER) END AS dup FROM pairs)"""


def dup_index(spark, sf):
    return rollup.dup_index(state_pairs(spark, sf), ["FIPS"], "STATE")


def state_lookup(spark, sf):
    return rollup.lookup_from(state_pairs(spark, sf), "FIPS", "STATE", "STATE_CODE")


def quality_report(spark, sf):
    """All checks over the district-year sums, counted while they are written; each table is read once."""
    leas = B.lea_years(spark, sf)
    panel = leas.select(
        F.col("o_custkey").alias("LEAID"), "YEAR",
        F.when(F.col("YEAR") <= 1998, F.col("ENR_AI")).otherwise(0).alias("t5"),
        F.when(F.col("YEAR") >= 1998, F.col("ENR_MR")).otherwise(0).alias("t7"),
        F.col("ENR_sumrace").alias("summed"),
        F.when(F.col("YEAR") > 1996, F.col("ENR_sumrace")).otherwise(F.col("ENR_WH")).alias("reported"),
    )
    districts = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("LEAID"))
    checks = watch.Watch(
        watch.exclusive(F.col("t5") != 0, F.col("t7") != 0), watch.unique_key(["LEAID", "YEAR"]), watch.matched(districts, ["LEAID"]),
        watch.covered("YEAR"), watch.totals_differ("reported", "summed"),
    )
    io.write_table(panel, io.shared_dir(spark, "panel"), watch=checks)
    return checks.report(spark)


QUALITY_SQL = f"""WITH {B.FACT},
leas AS (SELECT o_custkey AS LEAID, "YEAR", sum(enr) AS summed,
  sum(CASE WHEN race = 'WH' THEN enr ELSE 0 END) AS white,
  CASE WHEN "YEAR" <= 1998 THEN sum(CASE WHEN race = 'AI' THEN enr ELSE 0 END) ELSE 0 END AS t5,
  CASE WHEN "YEAR" >= 1998 THEN sum(CASE WHEN race = 'MR' THEN enr ELSE 0 END) ELSE 0 END AS t7
  FROM fact GROUP BY 1, 2)
SELECT 'both standards' AS "check", count(*) AS n FROM leas WHERE t5 <> 0 AND t7 <> 0
UNION ALL SELECT 'repeated keys', 0
UNION ALL SELECT 'left only', count(*) FROM (SELECT LEAID FROM leas EXCEPT SELECT c_custkey FROM customer)
UNION ALL SELECT 'right only', count(*) FROM customer WHERE c_custkey NOT IN (SELECT LEAID FROM leas)
UNION ALL SELECT 'matched', count(DISTINCT LEAID) FROM leas
UNION ALL SELECT 'values covered', count(DISTINCT "YEAR") FROM leas
UNION ALL SELECT 'totals differ', count(*) FROM leas WHERE "YEAR" <= 1996 AND white <> summed"""

QUERIES = {
    "collapse_school_to_lea": (collapse_school_to_lea, LEA_SQL),
    "collapse_lea_to_state": (
        collapse_lea_to_state, f"WITH {B.FACT}, {B.STATE_WIDE} SELECT * FROM state_wide",
    ),
    "collapse_null_as_zero": (
        collapse_null_as_zero,
        """SELECT l_orderkey, CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_quantity END), 0) AS BIGINT) AS qty,
        max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey""",
    ),
    "sum_na_propagating": (
        sum_na_propagating,
        """SELECT l_orderkey, CASE WHEN count(q) = count(*) THEN CAST(sum(q) AS BIGINT) END AS qty_sum
        FROM (SELECT l_orderkey, nullif(l_quantity, 25) AS q FROM lineitem) GROUP BY l_orderkey""",
    ),
    "rowtotal_zero": (
        rowtotal_zero,
        f"WITH {NULLABLE} SELECT l_orderkey, coalesce(HP, 0) + coalesce(MR, 0) + coalesce(AI, 0) AS total FROM nullable",
    ),
    "rowtotal_missing": (
        rowtotal_missing_query,
        f"""WITH {NULLABLE} SELECT l_orderkey, CASE WHEN HP IS NOT NULL OR MR IS NOT NULL OR AI IS NOT NULL
        THEN coalesce(HP, 0) + coalesce(MR, 0) + coalesce(AI, 0) END AS total FROM nullable""",
    ),
    "round_to_five": (
        round_to_five,
        f"""WITH {B.FACT} SELECT o_custkey, "YEAR", CAST(5 * round(sum(enr) / 5) AS BIGINT) AS enr,
        CAST(5 * round(sum(corp) / 5) AS BIGINT) AS corp FROM fact GROUP BY 1, 2""",
    ),
    "tab_year": (
        tab_year,
        """SELECT "YEAR", n, 100.0::DOUBLE * n / total AS percent, 100.0::DOUBLE * running / total AS cum_percent FROM (
        SELECT "YEAR", n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(sum(n) OVER (ORDER BY "YEAR") AS BIGINT) AS running
        FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS "YEAR", count(*) AS n FROM orders GROUP BY 1))""",
    ),
    "duplicates_report": (
        duplicates_report,
        """SELECT copies, CAST(sum(copies) AS BIGINT) AS observations, CAST(sum(copies) - count(*) AS BIGINT) AS surplus
        FROM (SELECT count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY copies""",
    ),
    "key_uniqueness": (
        key_uniqueness,
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "count_if": (
        count_if,
        """SELECT count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS "both",
        count(*) FILTER (l_returnflag = 'R' OR l_linestatus = 'O') AS either,
        count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O') AS neither FROM lineitem""",
    ),
    "dup_index": (dup_index, f"WITH {PAIRS} SELECT * FROM dups"),
    "state_lookup": (state_lookup, f"WITH {PAIRS} SELECT FIPS, STATE AS STATE_CODE FROM dups WHERE dup <> 1"),
    "quality_report": (quality_report, QUALITY_SQL),
}
