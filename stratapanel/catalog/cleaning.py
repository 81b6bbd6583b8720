"""Cell cleaning, filters, column selection and naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.nulls import not_in
from ..operators import columns as K
from ..operators.crosswalk import destring, scrub
from ..plans.state_tables import sample
from ..sources import io
from . import base as B


def reserve_code_scrub(spark, sf):
    return scrub(B.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"))


def text_accounts(spark, sf):
    """Customer balances as text, with a lone dash for some and a minus sign where negative."""
    whole = F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal")).otherwise(F.ceil("c_acctbal"))
    text = F.when(F.col("c_mktsegment") == "BUILDING", "-").otherwise(whole.cast("string"))
    return B.table(spark, sf, "customer").select("c_custkey", "c_name", text.alias("balance"))


def lenient_destring(spark, sf):
    return destring(text_accounts(spark, sf), ["c_name", "balance"], ignore="-")


def lenient_destring_strict(spark, sf):
    return destring(text_accounts(spark, sf), ["c_name", "balance"], ignore="-", mode="strict")


BALANCE = "CASE WHEN c_mktsegment = 'BUILDING' THEN '-' ELSE CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) END"


def flag_decode(spark, sf):
    said = F.col("o_orderstatus")
    text = F.when(said == "F", "Yes").when(said == "O", "No").when(said == "P", "-5")
    coded = B.table(spark, sf, "orders").select("o_orderkey", C.flag_code(text).alias("CORPIND"))
    return scrub(coded)


def encode_recode(spark, sf):
    remark = F.nullif(F.substring("o_orderstatus", 1, 1), F.lit("O"))
    rows = B.table(spark, sf, "orders").select("o_orderkey", remark.alias("Incomplete"))
    coded = K.encode(rows, "Incomplete", "Inc_num")
    recoded = K.recode(coded, "Inc_num", {None: 0, 2: 1, 3: 1})
    return recoded.select("o_orderkey", "Inc_num", C.incomplete_flag("Incomplete").alias("INCOMPLETE"))


def zero_pad_key(spark, sf):
    orders = B.table(spark, sf, "orders")
    ids = orders.select("o_orderkey", B.district_id().alias("LEAID"), F.col("o_orderkey").cast("string").alias("SCHID"))
    return ids.select(
        "o_orderkey", C.zero_pad("SCHID").alias("SCHID"), C.school_key("LEAID", "SCHID").alias("COMBOKEY"),
        C.state_prefix("LEAID").alias("FIPS"),
    )


def fill_from_alternative(spark, sf):
    leas = B.lea_years(spark, sf)
    reported = F.when(F.col("YEAR") < 1998, F.col("CORP_BL"))
    return leas.select("o_custkey", "YEAR", F.coalesce(reported, F.col("CORP_WH")).alias("CORP_BL"))


def not_in_null_kept(spark, sf):
    rows = B.table(spark, sf, "customer").withColumn("segment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return rows.filter(not_in("segment", ["HOUSEHOLD", "MACHINERY"])).select("c_custkey", "segment")


def year_text_rewrite(spark, sf):
    year = C.rewrite_year(B.year_of(), 2001, 2000)
    return B.table(spark, sf, "orders").select(year.alias("YEAR")).groupBy("YEAR").agg(F.count(F.lit(1)).alias("n"))


def three_valued_filter(spark, sf):
    rows = B.table(spark, sf, "customer").select(
        "c_custkey",
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("a"),
        F.nullif(F.col("c_nationkey"), F.lit(7)).alias("b"),
    )
    return rows.filter((F.col("a") == "HOUSEHOLD") | (F.col("a") == "MACHINERY") | (F.col("b") > 20))


def drop_null_key(spark, sf):
    rows = B.customer_states(spark, sf).withColumn("STATE_CODE", F.nullif(F.col("STATE_CODE"), F.lit("NATION_3")))
    return rows.dropna(subset=["STATE_CODE"]).groupBy("STATE_CODE").agg(F.count(F.lit(1)).alias("n"))


def sample_rule_reported(spark, sf):
    leas = B.lea_years(spark, sf).withColumn("CORP_sumrace", F.nullif(F.col("CORP_sumrace"), F.lit(0)))
    return sample(leas, "CORP_sumrace").select("o_custkey", "YEAR", "ENR_sumrace", "CORP_sumrace")


def select_glob_range(spark, sf):
    """Prefix, substring, range and plain picks of columns, then an order."""
    wide = B.lea_years(spark, sf)
    picked = K.keep(wide, "o_custkey", "YEAR", "CORP_*", "*_HP", ("ENR_AS", "ENR_HI"))
    trimmed = K.drop(picked, "CORP_sumrace", ("CORP_WH", "CORP_MR"))
    return K.order(trimmed, "YEAR", "ENR_*")


def typed_column_apply(spark, sf):
    """A loop over the numeric columns, a replaced column and constants."""
    rows = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    added = K.constants(rows, YEAR=2009, RACES_REPORTED=7)
    shifted = K.apply_numeric(added, lambda c: c + 1, exclude=["o_orderkey"])
    return K.replace_by(shifted, o_orderpriority=F.substring("o_orderpriority", 1, 1))


def rename_pairs(spark, sf):
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return K.rename_pairs(rows, ["c_name", "c_mktsegment"], ["name", "type"])


def labelled_customers(spark, sf):
    """Districts with a label for each column, and the state's number labelled with its name, from the states themselves."""
    states = {r[0]: r[1] for r in B.table(spark, sf, "nation").select("n_nationkey", "n_name").collect()}
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    labelled = K.label(rows, {"c_custkey": "District id", "c_nationkey": "State", "c_mktsegment": "District type"})
    return K.label_values(labelled, "c_nationkey", states)


def column_labels(spark, sf):
    """The labels of a table after it was written and read, each with the number of rows that carry the value."""
    path = io.shared_dir(spark, "labelled")
    io.write_table(labelled_customers(spark, sf), path)
    back = io.read_table(spark, path)
    counts = back.groupBy(F.col("c_nationkey").cast("bigint").alias("code")).agg(F.count("*").alias("n"))
    labels = K.label_list(back)
    return labels.join(counts, "code", "left").select("column", "label", "code", "text", "n")


def encode_labelled(spark, sf):
    """Text categories to codes that carry their texts, through a file and back to texts."""
    coded = K.encode(B.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "segment", labelled=True)
    path = io.shared_dir(spark, "encoded")
    io.write_table(coded, path)
    return K.decode(io.read_table(spark, path), "segment", "text").select("c_custkey", "segment", "c_mktsegment", "text")


QUERIES = {
    "reserve_code_scrub": (
        reserve_code_scrub,
        """SELECT CASE WHEN c_custkey >= 0 THEN c_custkey END AS c_custkey, CASE WHEN c_nationkey >= 0 THEN c_nationkey END AS c_nationkey,
        CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer""",
    ),
    "lenient_destring": (
        lenient_destring,
        f"SELECT c_custkey, c_name, TRY_CAST(nullif(replace({BALANCE}, '-', ''), '') AS BIGINT) AS balance FROM customer",
    ),
    "lenient_destring_strict": (
        lenient_destring_strict,
        f"SELECT c_custkey, c_name, TRY_CAST(nullif({BALANCE}, '-') AS BIGINT) AS balance FROM customer",
    ),
    "flag_decode": (
        flag_decode,
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS \"CORPIND\" FROM orders",
    ),
    "encode_recode": (
        encode_recode,
        """SELECT o_orderkey, CASE WHEN x IS NULL THEN 0 WHEN code IN (2, 3) THEN 1 ELSE CAST(code AS INTEGER) END AS "Inc_num",
        CASE WHEN x IS NULL THEN 0 ELSE 1 END AS "INCOMPLETE"
        FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS x FROM orders) LEFT JOIN
        (SELECT s, row_number() OVER (ORDER BY s) AS code FROM (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'O')) ON x = s""",
    ),
    "zero_pad_key": (
        zero_pad_key,
        """SELECT o_orderkey, printf('%05d', o_orderkey) AS "SCHID", printf('%07d%05d', o_custkey, o_orderkey) AS "COMBOKEY",
        substr(printf('%07d', o_custkey), 1, 2) AS "FIPS" FROM orders""",
    ),
    "fill_from_alternative": (
        fill_from_alternative,
        f"""WITH {B.FACT} SELECT o_custkey, "YEAR",
        coalesce(CASE WHEN "YEAR" < 1998 THEN {B.group_sum('corp', 'BL')} END, {B.group_sum('corp', 'WH')}) AS "CORP_BL"
        FROM fact GROUP BY 1, 2""",
    ),
    "not_in_null_kept": (
        not_in_null_kept,
        """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer
        WHERE coalesce(nullif(c_mktsegment, 'BUILDING') NOT IN ('HOUSEHOLD', 'MACHINERY'), TRUE)""",
    ),
    "year_text_rewrite": (
        year_text_rewrite,
        """SELECT CAST(regexp_replace(CAST(year(o_orderdate) AS VARCHAR), '2001', '2000') AS INTEGER) AS "YEAR", count(*) AS n
        FROM orders GROUP BY 1""",
    ),
    "three_valued_filter": (
        three_valued_filter,
        """SELECT * FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS a, nullif(c_nationkey, 7) AS b FROM customer)
        WHERE a = 'HOUSEHOLD' OR a = 'MACHINERY' OR b > 20""",
    ),
    "drop_null_key": (
        drop_null_key,
        """SELECT nullif(n_name, 'NATION_3') AS "STATE_CODE", count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE nullif(n_name, 'NATION_3') IS NOT NULL GROUP BY 1""",
    ),
    "sample_rule_reported": (
        sample_rule_reported,
        f"""WITH {B.FACT} SELECT o_custkey, "YEAR", CAST(sum(enr) AS BIGINT) AS "ENR_sumrace", CAST(sum(corp) AS BIGINT) AS "CORP_sumrace"
        FROM fact GROUP BY 1, 2 HAVING sum(corp) <> 0""",
    ),
    "select_glob_range": (
        select_glob_range,
        f"""WITH {B.FACT} SELECT "YEAR", {", ".join(f'{B.group_sum("enr", g)} AS "ENR_{g}"' for g in ("AS", "BL", "HI", "HP"))},
        o_custkey, {", ".join(f'{B.group_sum("corp", g)} AS "CORP_{g}"' for g in ("AI", "AS", "BL", "HI"))}
        FROM fact GROUP BY o_custkey, "YEAR\"""",
    ),
    "typed_column_apply": (
        typed_column_apply,
        """SELECT o_orderkey, o_custkey + 1 AS o_custkey, substr(o_orderpriority, 1, 1) AS o_orderpriority,
        2010 AS "YEAR", 8 AS "RACES_REPORTED" FROM orders""",
    ),
    "rename_pairs": (rename_pairs, "SELECT c_custkey, c_name AS name, c_mktsegment AS type FROM customer"),
    "column_labels": (
        column_labels,
        """SELECT 'c_custkey' AS "column", 'District id' AS label, CAST(NULL AS BIGINT) AS code, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BIGINT) AS n
        UNION ALL SELECT 'c_mktsegment', 'District type', NULL, NULL, NULL
        UNION ALL SELECT 'c_nationkey', 'State', n_nationkey, n_name, (SELECT nullif(count(*), 0) FROM customer WHERE c_nationkey = n_nationkey) FROM nation""",
    ),
    "encode_labelled": (
        encode_labelled, "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS INTEGER) AS segment, c_mktsegment, c_mktsegment AS text FROM customer",
    ),
}
