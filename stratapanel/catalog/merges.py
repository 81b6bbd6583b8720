"""Validated merges, lookups, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as G
from ..operators.reshape import append, append_distinct
from ..sources.io import state_dimension
from . import base as B


def _flag_sums(spark, sf, flag, second):
    """Per order, a sum that is null when it divides by three, and a plain count, over the lines of a flag (``!``: of all others)."""
    same = F.col("l_returnflag") == flag[-1]
    lines = B.table(spark, sf, "lineitem").filter(~same if flag[0] == "!" else same)
    total = F.sum(F.col("l_quantity").cast("bigint"))
    return lines.groupBy("l_orderkey").agg(
        F.when(total % 3 != 0, total).alias("x"), F.count(F.lit(1)).alias(second)
    )


def _flag_sql(flag, second):
    return f"""(SELECT l_orderkey, CASE WHEN sum(l_quantity) % 3 <> 0 THEN CAST(sum(l_quantity) AS BIGINT) END AS x,
    count(*) AS {second} FROM lineitem WHERE l_returnflag {'<>' if flag[0] == '!' else '='} '{flag[-1]}' GROUP BY l_orderkey)"""


def merge_1to1_master_wins(spark, sf):
    return G.merge_one([_flag_sums(spark, sf, "R", "y"), _flag_sums(spark, sf, "!R", "z")], ["l_orderkey"], "_merge")


def merge_chain(spark, sf):
    """Three tables at once, each overlapping the others."""
    tables = [_flag_sums(spark, sf, f, n) for f, n in (("R", "y"), ("A", "z"), ("N", "w"))]
    return G.merge_one(tables, ["l_orderkey"])


def merge_provenance_counts(spark, sf):
    documents = B.table(spark, sf, "documents").select("doc_id", "lang")
    labels = B.table(spark, sf, "labels").select(F.when(F.col("quality") == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), "quality")
    return G.merge_report(G.merge_one([documents, labels], ["doc_id"], "_merge"))


def merge_matched_only(spark, sf):
    documents = B.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = B.table(spark, sf, "labels")
    return G.merge_one([documents, labels], ["doc_id"], keep=["both"])


def merge_m1_lookup(spark, sf):
    """Orders to customers with all three outcomes, then to the state; counts per state and outcome."""
    orders = B.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("key"), "o_orderkey"
    )
    customers = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    merged = G.merge_many(orders, customers, ["key"], "_merge", null_keys_match=False)
    counted = merged.groupBy("nation", "_merge").agg(F.count(F.lit(1)).alias("n"))
    states = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return G.merge_many(counted, states, ["nation"], keep=["left", "both"])


def merge_inner_dim(spark, sf):
    states = B.table(spark, sf, "nation").join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = B.table(spark, sf, "supplier").join(states, F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select("s_suppkey", "n_name", "r_name")


def merge_null_safe_attrs(spark, sf):
    """Dictionary-like rows on attributes that may be null: null meets null."""

    def rows(name, flag):
        # lines of one flag, or with ! of all others
        same = F.col("l_returnflag") == flag[-1]
        lines = B.table(spark, sf, "lineitem").filter(~same if flag[0] == "!" else same)
        keys = lines.select(
            F.nullif(B.race_code(), F.lit("MR")).alias("race"), F.nullif(F.col("l_linenumber"), F.lit(1)).alias("line"),
            F.nullif(F.col("l_linestatus"), F.lit("O")).alias("sex"),
        )
        return keys.groupBy("race", "line", "sex").agg(F.count(F.lit(1)).alias(name))

    return G.merge_one([rows("a", "R"), rows("b", "!R")], ["race", "line", "sex"])


def _attr_sql(name, flag):
    return f"""(SELECT nullif({B.RACE_SQL}, 'MR') AS race, nullif(l_linenumber, 1) AS line, nullif(l_linestatus, 'O') AS sex,
    count(*) AS {name} FROM lineitem WHERE l_returnflag {flag} GROUP BY 1, 2, 3)"""


def panel_stack(spark, sf):
    """Late years come as two overlapping tables to merge, early years as one; years go under one another."""
    leas = B.lea_years(spark, sf).withColumnRenamed("o_custkey", "LEAID")
    early, late = leas.filter("YEAR < 1998"), leas.filter("YEAR >= 1998")
    first = late.filter("ENR_AI > 0").select("LEAID", "YEAR", "ENR_AI", "ENR_BL")
    second = late.filter("ENR_AS > 0 OR ENR_AI = 0").select("LEAID", "YEAR", "ENR_BL", "CORP_BL")
    single = early.select("LEAID", "YEAR", "ENR_AI", "CORP_WH")
    return G.stack_panel({1997: [single], 2001: [first, second]}, ["LEAID", "YEAR"])


PANEL_SQL = f"""WITH {B.FACT}, leas AS (SELECT o_custkey AS "LEAID", "YEAR", {B.WIDE_SUMS} FROM fact GROUP BY 1, 2)
SELECT "LEAID", "YEAR", nullif(ENR_AI, 0) AS "ENR_AI", ENR_BL AS "ENR_BL",
  CASE WHEN ENR_AS > 0 OR ENR_AI = 0 THEN CORP_BL END AS "CORP_BL", CAST(NULL AS BIGINT) AS "CORP_WH"
  FROM leas WHERE "YEAR" >= 1998
UNION ALL SELECT "LEAID", "YEAR", ENR_AI, NULL, NULL, CORP_WH FROM leas WHERE "YEAR" < 1998"""


def append_union(spark, sf):
    customers = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    suppliers = B.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return append(customers, suppliers)


def append_distinct_query(spark, sf):
    customers = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    suppliers = B.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return append_distinct(customers, suppliers)


def dim_lookup(spark, sf):
    """Distinct dimension drawn from the districts, looked up by the orders."""
    dimension = state_dimension(B.customer_states(spark, sf), "n_nationkey", "STATE_CODE")
    orders = B.table(spark, sf, "orders").select("o_custkey")
    customers = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    per_customer = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    coded = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    per_state = coded.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("n").alias("orders"))
    return per_state.join(dimension, "n_nationkey").select("STATE_CODE", "orders")


QUERIES = {
    "merge_1to1_master_wins": (
        merge_1to1_master_wins,
        f"""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CASE WHEN a.l_orderkey IS NOT NULL THEN a.x ELSE b.x END AS x, y, z,
        CASE WHEN b.l_orderkey IS NULL THEN 1 WHEN a.l_orderkey IS NULL THEN 2 ELSE 3 END AS _merge
        FROM {_flag_sql('R', 'y')} a FULL JOIN {_flag_sql('!R', 'z')} b ON a.l_orderkey = b.l_orderkey""",
    ),
    "merge_chain": (
        merge_chain,
        f"""SELECT k AS l_orderkey, CASE WHEN a.l_orderkey IS NOT NULL THEN a.x WHEN b.l_orderkey IS NOT NULL THEN b.x ELSE c.x END AS x, y, z, w
        FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) LEFT JOIN {_flag_sql('R', 'y')} a ON k = a.l_orderkey
        LEFT JOIN {_flag_sql('A', 'z')} b ON k = b.l_orderkey LEFT JOIN {_flag_sql('N', 'w')} c ON k = c.l_orderkey""",
    ),
    "merge_provenance_counts": (
        merge_provenance_counts,
        """SELECT CASE WHEN l.doc_id IS NULL THEN 1 WHEN d.doc_id IS NULL THEN 2 ELSE 3 END AS _merge, count(*) AS n
        FROM documents d FULL JOIN (SELECT CASE WHEN quality = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM labels) l
        ON d.doc_id = l.doc_id GROUP BY 1""",
    ),
    "merge_matched_only": (
        merge_matched_only,
        "SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "merge_m1_lookup": (
        merge_m1_lookup,
        """SELECT nation, _merge, count(*) AS n, any_value(n_name) AS n_name FROM (
        SELECT c_nationkey AS nation, CASE WHEN c_custkey IS NULL THEN 1 WHEN o_orderkey IS NULL THEN 2 ELSE 3 END AS _merge
        FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_custkey - 1 ELSE o_custkey END AS key FROM orders)
        FULL JOIN customer ON key = c_custkey) LEFT JOIN nation ON nation = n_nationkey GROUP BY 1, 2""",
    ),
    "merge_inner_dim": (
        merge_inner_dim,
        """SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    ),
    "merge_null_safe_attrs": (
        merge_null_safe_attrs,
        f"""SELECT coalesce(x.race, y.race) AS race, coalesce(x.line, y.line) AS line, coalesce(x.sex, y.sex) AS sex, a, b
        FROM {_attr_sql('a', "= 'R'")} x FULL JOIN {_attr_sql('b', "<> 'R'")} y ON x.race IS NOT DISTINCT FROM y.race
        AND x.line IS NOT DISTINCT FROM y.line AND x.sex IS NOT DISTINCT FROM y.sex""",
    ),
    "panel_stack": (panel_stack, PANEL_SQL),
    "append_union": (
        append_union,
        """SELECT c_nationkey AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
        UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier""",
    ),
    "append_distinct": (
        append_distinct_query,
        "SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION SELECT s_nationkey, NULL FROM supplier",
    ),
    "dim_lookup": (
        dim_lookup,
        """SELECT n_name AS "STATE_CODE", count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    ),
}
