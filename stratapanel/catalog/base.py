"""Survey-shaped views of the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import rowtotal, sum0
from ..operators.reshape import reshape_long

RACES = ["AI", "AS", "BL", "HI", "WH", "HP", "MR"]
GROUPS = sorted([*RACES, "sumrace"])
SEXES = {"O": "M", "F": "F"}
STATUSES = {"N": "NODIS", "R": "IDEA", "A": "LEP"}
LAST_YEAR = 2001
COHORT_REGIONS = ["ASIA", "EUROPE"]
EXCLUDED_STATES = ["NATION_0", "NATION_1"]
WIDE = [f"{p}{g}" for p in ("ENR_", "CORP_") for g in GROUPS]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def race_code(key: str = "l_suppkey") -> Column:
    codes = F.array(*[F.lit(r) for r in RACES])
    return F.element_at(codes, (F.col(key) % len(RACES) + 1).cast("int"))


def year_of(c: str = "o_orderdate") -> Column:
    return F.year(c).cast("int")


def district_id(c: str = "o_custkey") -> Column:
    return F.format_string("%07d", F.col(c))


def school_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Enrolment and outcome per order and racial group, summed before any join."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        (F.col("l_suppkey") % len(RACES)).alias("code"),
        F.col("l_quantity").cast("bigint").alias("enr"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint")).alias("corp"),
    )
    return lines.groupBy("l_orderkey").agg(
        *[
            F.expr(f"coalesce(sum(CASE WHEN code = {i} THEN {v} END), 0) AS {p}{r}")
            for p, v in (("ENR_", "enr"), ("CORP_", "corp"))
            for i, r in enumerate(RACES)
        ]
    )


def school_years(spark: SparkSession, sf: str) -> DataFrame:
    """School sums with their district and year."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", year_of().alias("YEAR"))
    return school_sums(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def add_sumrace(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{p}sumrace": rowtotal([f"{p}{r}" for r in RACES]) for p in ("ENR_", "CORP_")})


def lea_years(spark: SparkSession, sf: str) -> DataFrame:
    """District-year sums, all eight groups wide."""
    sums = [sum0(f"{p}{r}").alias(f"{p}{r}") for p in ("ENR_", "CORP_") for r in RACES]
    return add_sumrace(school_years(spark, sf).groupBy("o_custkey", "YEAR").agg(*sums))


def customer_states(spark: SparkSession, sf: str) -> DataFrame:
    """Districts with the name of their state and of its region."""
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    states = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = customers.join(states, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", "n_nationkey", F.col("n_name").alias("STATE_CODE"), F.col("r_name").alias("REGION"))


def state_wide(spark: SparkSession, sf: str) -> DataFrame:
    """State-year sums, wide.

    The state goes to the narrow orders first, where a hot district is split by the adaptive skew
    join; the wide sums then move once, by order, and fold into one row per state and year.
    """
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", year_of().alias("YEAR"))
    placed = orders.join(customer_states(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    rows = school_sums(spark, sf).join(
        placed.select("o_orderkey", "YEAR", "STATE_CODE"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    sums = [sum0(f"{p}{r}").alias(f"{p}{r}") for p in ("ENR_", "CORP_") for r in RACES]
    return add_sumrace(rows.groupBy("YEAR", "STATE_CODE").agg(*sums))


def state_long(spark: SparkSession, sf: str) -> DataFrame:
    """YEAR, STATE_CODE, race, CORP_, ENR_: eight rows per state and year."""
    return reshape_long(state_wide(spark, sf), ["CORP_", "ENR_"], "race", GROUPS)


def allowed_states(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region").filter(F.col("r_name").isin(COHORT_REGIONS))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(
        F.col("n_name").alias("STATE_CODE")
    )


# The same views in SQL.

RACE_SQL = "CASE l_suppkey % 7 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RACES)) + " END"

FACT = f"""fact AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS "YEAR", n.n_name AS STATE_CODE, r.r_name AS REGION,
         o.o_custkey, l.l_orderkey, {RACE_SQL} AS race, CAST(l.l_quantity AS BIGINT) AS enr,
         CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_quantity AS BIGINT) ELSE 0 END AS corp
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def group_sum(value: str, group: str) -> str:
    test = "" if group == "sumrace" else f"WHEN race = '{group}' "
    case = value if group == "sumrace" else f"CASE {test}THEN {value} END"
    return f"CAST(coalesce(sum({case}), 0) AS BIGINT)"


WIDE_SUMS = ", ".join(
    f"{group_sum(v, g)} AS {p}{g}" for p, v in (("ENR_", "enr"), ("CORP_", "corp")) for g in GROUPS
)

STATE_WIDE = f"""state_wide AS (
  SELECT "YEAR", STATE_CODE, {WIDE_SUMS} FROM fact GROUP BY "YEAR", STATE_CODE)"""

STATE_LONG = "state_long AS (\n  " + "\n  UNION ALL ".join(
    f"""SELECT "YEAR", STATE_CODE, '{g}' AS race, CORP_{g} AS CORP_, ENR_{g} AS ENR_ FROM state_wide""" for g in GROUPS
) + ")"

STATE = f"WITH {FACT},\n{STATE_WIDE},\n{STATE_LONG}"

ALLOWED = "(SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))"
EXCLUDED = "('NATION_0', 'NATION_1')"


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)
