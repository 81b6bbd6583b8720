"""Reshapes, sorted panels, and tables that go through storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.reshape import pivot_longer, pivot_wider, reshape_long
from ..plans import state_tables as T
from ..sources import io
from . import base as B


def reshape_long_two_stubs(spark, sf):
    return reshape_long(B.lea_years(spark, sf), ["ENR_", "CORP_"], "race")


def pivot_wider_two_values(spark, sf):
    long = B.state_long(spark, sf)
    renamed = long.withColumnsRenamed({"ENR_": "ENR", "CORP_": "CORP"})
    return pivot_wider(renamed, ["YEAR", "STATE_CODE"], "race", ["ENR", "CORP"], B.GROUPS)


def pivot_longer_one_value(spark, sf):
    wide = B.state_wide(spark, sf).select("YEAR", "STATE_CODE", "ENR_sumrace", "CORP_AI", "CORP_BL")
    return pivot_longer(wide, ["CORP_AI", "CORP_BL"])


def sort_panel(spark, sf):
    leas = B.lea_years(spark, sf).select(F.col("o_custkey").alias("LEAID"), "YEAR", "ENR_sumrace")
    return io.sort_panel(leas)


def _not_again():
    raise RuntimeError("a finished table must not be built again")


def read_through_cache(spark, sf):
    """District panel built and written on the first read, only read on the second."""
    path = io.shared_dir(spark, "panel")
    io.materialize(spark, path, lambda: B.lea_years(spark, sf), ["YEAR"])
    again = io.materialize(spark, path, _not_again, ["YEAR"])
    return again.groupBy("YEAR").agg(F.count(F.lit(1)).alias("districts"), F.sum("ENR_sumrace").alias("enr"))


def csv_roundtrip_forced_strings(spark, sf):
    """Export as CSV and read back: ids keep their zeros, NA is null, other columns get their types."""
    path = io.shared_dir(spark, "extract")
    rows = B.table(spark, sf, "customer").select(
        B.district_id("c_custkey").alias("LEAID"),
        F.concat_ws(", ", "c_name", "c_mktsegment").alias("NAME"),
        F.when(F.col("c_nationkey") == 7, "NA").otherwise(F.col("c_nationkey").cast("string")).alias("NATION"),
        F.floor("c_acctbal").cast("string").alias("BALANCE"),
    )
    io.export_table(rows, path)
    return io.read_csv(spark, path, "LEAID string, NAME string, NATION int, BALANCE bigint")


def extract_all_text(spark, sf):
    """The same kind of file read as text only."""
    path = io.shared_dir(spark, "extract")
    rows = B.table(spark, sf, "supplier").select(B.district_id("s_suppkey").alias("LEAID"), F.col("s_nationkey").alias("N"))
    io.export_table(rows, path)
    return io.read_extract(spark, path, ["LEAID", "N"])


def _districts(spark, sf):
    """District-years with their state; written once, as enrolment and outcomes are both taken from it."""

    def build():
        return B.lea_years(spark, sf).join(B.customer_states(spark, sf), F.col("o_custkey") == F.col("c_custkey"))

    return io.materialize(spark, io.shared_dir(spark, "districts"), build)


def _enrolment(joined):
    """Enrolment per district and year, with ids that start with the state number and some blank states."""
    return joined.select(
        F.format_string("%02d%07d", "n_nationkey", "o_custkey").alias("LEAID"), "YEAR",
        F.when(F.col("ENR_AI") == 0, "").otherwise(F.col("STATE_CODE")).alias("STATE"),
        *[f"ENR_{g}" for g in B.GROUPS],
    )


def _outcomes(joined, prefix):
    """Outcome counts of the districts; no row where group MR is empty, no counts where HP is."""
    rows = joined.filter(F.col("ENR_MR") > 0)
    counts = [F.expr(f"CASE WHEN ENR_HP > 0 THEN CORP_{g} END AS {prefix}_{g}") for g in B.GROUPS]
    return rows.select(F.format_string("%02d%07d", "n_nationkey", "o_custkey").alias("LEAID"), "YEAR", *counts)


def state_table_rounded(spark, sf):
    joined = _districts(spark, sf)
    return T.corporal_punishment_table(_enrolment(joined), _outcomes(joined, "CORP"))


def state_table_pct(spark, sf):
    joined = _districts(spark, sf)
    return T.suspension_table(_enrolment(joined), _outcomes(joined, "OSS"))


def state_table_all(spark, sf):
    """The table without the sample rule: districts without a reported outcome stay in the denominators."""
    joined = _districts(spark, sf)
    return T.corporal_punishment_table(_enrolment(joined), _outcomes(joined, "CORP"), rule="all")


def read_forced_positions(spark, sf):
    """A file of which the first column is text by its place and the others are inferred."""
    path = io.shared_dir(spark, "extract")
    rows = B.table(spark, sf, "customer").select(
        B.district_id("c_custkey").alias("LEAID"), F.col("c_nationkey").alias("NATION"), F.round("c_acctbal", 2).alias("BALANCE")
    )
    io.export_table(rows, path)
    return io.read_forced(spark, path, [1])


def read_csv_inferred(spark, sf):
    """A file read with the null mark and types as its cells have them."""
    path = io.shared_dir(spark, "extract")
    rows = B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ID"), F.when(F.col("s_nationkey") == 7, "NA").otherwise(F.col("s_nationkey").cast("string")).alias("NATION"), F.col("s_name").alias("NAME")
    )
    io.export_table(rows, path)
    return io.read_csv(spark, path)


def fill_state_code(spark, sf):
    """District rows with the state name their code implies, blanks included; sums per state."""
    filled = T.fill_state(_enrolment(_districts(spark, sf)))
    return filled.groupBy("YEAR", "FIPS", "STATE_CODE").agg(F.count(F.lit(1)).alias("districts"), F.sum("ENR_sumrace").alias("enr"))


SAMPLED = f"""leas AS (SELECT o_custkey, "YEAR", STATE_CODE, {B.WIDE_SUMS} FROM fact GROUP BY 1, 2, 3),
sampled AS (SELECT * FROM leas WHERE ENR_MR > 0 AND ENR_HP > 0),
sums AS (SELECT "YEAR", STATE_CODE, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in B.WIDE)} FROM sampled GROUP BY 1, 2)"""


ALL_SAMPLED = SAMPLED.replace("WHERE ENR_MR > 0 AND ENR_HP > 0", "WHERE ENR_MR > 0")
for _c in B.WIDE:
    if _c.startswith("CORP_"):
        ALL_SAMPLED = ALL_SAMPLED.replace(f"sum({_c})", f"coalesce(sum(CASE WHEN ENR_HP > 0 THEN {_c} END), 0)")


def _rounded(c):
    return f"CAST(5 * round({c} / 5) AS BIGINT)"


ROUNDED_SQL = f"WITH {B.FACT}, {SAMPLED}\n" + "\nUNION ALL ".join(
    f"""SELECT "YEAR", STATE_CODE, '{g}' AS race, {_rounded(f'CORP_{g}')} AS "CORP_", {_rounded(f'ENR_{g}')} AS "ENR_" FROM sums"""
    for g in B.GROUPS
)
PCT_SQL = f"WITH {B.FACT}, {SAMPLED}\n" + "\nUNION ALL ".join(
    f"""SELECT "YEAR", STATE_CODE, '{'total' if g == 'sumrace' else g}' AS race, CORP_{g} AS "OSS_", ENR_{g} AS "ENR_",
    nullif(100 * (CORP_{g} / nullif(ENR_{g}, 0)), 0) AS "pct_" FROM sums"""
    for g in B.GROUPS
)
ALL_SQL = ROUNDED_SQL.replace(SAMPLED, ALL_SAMPLED)

QUERIES = {
    "fill_state_code": (
        fill_state_code,
        f"""WITH {B.FACT} SELECT "YEAR", lpad(replace(STATE_CODE, 'NATION_', ''), 2, '0') AS "FIPS", STATE_CODE AS "STATE_CODE",
        count(DISTINCT o_custkey) AS districts, CAST(sum(enr) AS BIGINT) AS enr FROM fact GROUP BY 1, 2, 3""",
    ),
    "reshape_long_two_stubs": (
        reshape_long_two_stubs,
        f"""WITH {B.FACT}, leas AS (SELECT o_custkey, "YEAR", {B.WIDE_SUMS} FROM fact GROUP BY 1, 2)\n"""
        + "\nUNION ALL ".join(f"""SELECT o_custkey, "YEAR", '{g}' AS race, ENR_{g} AS "ENR_", CORP_{g} AS "CORP_" FROM leas""" for g in B.GROUPS),
    ),
    "pivot_wider_two_values": (
        pivot_wider_two_values,
        f"""{B.STATE} SELECT "YEAR", STATE_CODE, {", ".join(
            f'''max(CASE WHEN race = '{r}' THEN {v}_ END) AS "{v}_{r}"''' for v in ("ENR", "CORP") for r in B.GROUPS)}
        FROM state_long GROUP BY 1, 2""",
    ),
    "pivot_longer_one_value": (
        pivot_longer_one_value,
        f"""WITH {B.FACT}, {B.STATE_WIDE}
        SELECT "YEAR", STATE_CODE, ENR_sumrace AS "ENR_sumrace", 'CORP_AI' AS type, CORP_AI AS value FROM state_wide
        UNION ALL SELECT "YEAR", STATE_CODE, ENR_sumrace, 'CORP_BL', CORP_BL FROM state_wide""",
    ),
    "sort_panel": (
        sort_panel,
        f"""WITH {B.FACT} SELECT o_custkey AS "LEAID", "YEAR", CAST(sum(enr) AS BIGINT) AS "ENR_sumrace" FROM fact GROUP BY 1, 2""",
    ),
    "read_through_cache": (
        read_through_cache,
        f"""WITH {B.FACT} SELECT "YEAR", count(DISTINCT o_custkey) AS districts, CAST(sum(enr) AS BIGINT) AS enr FROM fact GROUP BY 1""",
    ),
    "csv_roundtrip_forced_strings": (
        csv_roundtrip_forced_strings,
        """SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS "LEAID", c_name || ', ' || c_mktsegment AS "NAME",
        nullif(c_nationkey, 7) AS "NATION", CAST(floor(c_acctbal) AS BIGINT) AS "BALANCE" FROM customer""",
    ),
    "extract_all_text": (
        extract_all_text,
        """SELECT lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS "LEAID", CAST(s_nationkey AS VARCHAR) AS "N" FROM supplier""",
    ),
    "state_table_rounded": (state_table_rounded, ROUNDED_SQL),
    "state_table_all": (state_table_all, ALL_SQL),
    "read_forced_positions": (
        read_forced_positions,
        """SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS "LEAID", c_nationkey AS "NATION", round(c_acctbal, 2) AS "BALANCE" FROM customer""",
    ),
    "read_csv_inferred": (
        read_csv_inferred,
        """SELECT CAST(s_suppkey AS INTEGER) AS "ID", nullif(s_nationkey, 7) AS "NATION", s_name AS "NAME" FROM supplier""",
    ),
    "state_table_pct": (state_table_pct, PCT_SQL),
}
