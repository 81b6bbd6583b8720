"""Stata files: the district panel written and read in byte ranges, with labels and missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as K
from ..sources import io
from . import base as B
from .cleaning import labelled_customers

# Small enough that the test tables are read in several ranges.
SPLIT = {"splitBytes": 1 << 16, "partBytes": 1 << 20}


def dta_scan(spark, sf):
    """District-year sums through a Stata file: ids stay text, no outcome is a missing value."""
    leas = B.lea_years(spark, sf)
    counts = [F.col("ENR_sumrace").cast("int").alias("ENR"), F.nullif("CORP_sumrace", F.lit(0)).cast("double").alias("CORP")]
    panel = leas.select(B.district_id().alias("LEAID"), F.col("YEAR").cast("short").alias("YEAR"), *counts)
    path = io.shared_dir(spark, "panel-dta")
    io.write_dta(panel, path, partBytes=SPLIT["partBytes"])
    return io.read_dta(spark, path, splitBytes=SPLIT["splitBytes"]).select("LEAID", F.col("YEAR").cast("int").alias("YEAR"), "ENR", "CORP")


def dta_dates(spark, sf):
    """Days and moments through a Stata file, those before 1960 and missing ones too."""
    day = F.col("o_orderdate").cast("date")
    rows = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("o_orderkey"), F.when(F.col("o_orderstatus") != "P", F.date_sub(day, 14_000)).alias("day"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("moment"),
    )
    path = io.shared_dir(spark, "dates-dta")
    io.write_dta(rows, path)
    back = io.read_dta(spark, path, splitBytes=SPLIT["splitBytes"])
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("day").cast("string").alias("day"), F.unix_micros(F.col("moment").cast("timestamp")).alias("moment"))


def dta_labels(spark, sf):
    """Labels of columns and values through a Stata file; the codes read back as their texts."""
    rows = labelled_customers(spark, sf)
    slim = rows.select(*[F.col(c).cast("int").alias(c, metadata=rows.schema[c].metadata) for c in ("c_custkey", "c_nationkey")], "c_mktsegment")
    path = io.shared_dir(spark, "labels-dta")
    io.write_dta(slim, path)
    back = io.read_dta(spark, path, splitBytes=SPLIT["splitBytes"])
    said = F.lit("; ".join(f.metadata["comment"] for f in back.schema.fields))
    return K.decode(back, "c_nationkey", "state").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "state", "c_mktsegment", said.alias("labels"))


QUERIES = {
    "dta_scan": (
        dta_scan,
        f"""WITH {B.FACT} SELECT lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS "LEAID", "YEAR", CAST(sum(enr) AS INTEGER) AS "ENR",
        CAST(nullif(sum(corp), 0) AS DOUBLE) AS "CORP" FROM fact GROUP BY o_custkey, "YEAR\"""",
    ),
    "dta_dates": (
        dta_dates,
        """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) - 14000 AS VARCHAR) END AS day,
        CASE WHEN o_orderstatus <> 'F' THEN epoch_us(o_orderdate) END AS moment FROM orders""",
    ),
    "dta_labels": (
        dta_labels,
        """SELECT c_custkey, n_name AS state, c_mktsegment, 'District id; State; District type' AS labels FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
}
