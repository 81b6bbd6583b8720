"""Repeated keys and odd columns stop the job or are handled, and plans stay narrow."""

import pytest
from pyspark.sql import functions as F

from stratapanel.functions import vocabulary as V
from stratapanel.operators import columns as K
from stratapanel.operators import crosswalk as X
from stratapanel.operators import merge as G
from stratapanel.operators import reshape
from stratapanel.plans import panels, state_tables, waves


def test_district_tables_are_unique(spark):
    names = "LEAID string, YEAR string, T_AME_COR string, T_ASI_COR string, T_HIS_COR string, T_BLA_COR string, T_WHI_COR string"
    old = waves.historic_lea(spark.createDataFrame([("01", "1976", "1", None, None, "3", "4")], names), "CP")
    assert panels.lea_totals("CP", historic=[old, old.withColumn("YEAR", F.lit(1978))]).count() == 2
    with pytest.raises(Exception, match="not unique in a district table"):
        panels.lea_totals("CP", historic=[old.union(old)]).collect()
    cell = "CORP_M_BL_NODIS"
    restricted = spark.createDataFrame([("01", 2009, 3), ("01", 2009, 5)], f"LEAID string, YEAR int, {cell} bigint")
    with pytest.raises(Exception, match="not unique in a district table"):
        panels.lea_totals("CP", districts=[restricted]).collect()


def test_a_single_table_of_a_year_is_checked(spark):
    rows = spark.createDataFrame([("s1", 2011, 1), ("s1", 2011, 2)], "COMBOKEY string, YEAR int, x int")
    with pytest.raises(Exception, match="not unique"):
        G.stack_panel({2011: [rows]}, V.SCHOOL_KEY).collect()
    assert G.stack_panel({2011: [rows]}, V.SCHOOL_KEY, merged=False).count() == 2


def test_pivot_and_availability_stop_at_duplicates(spark):
    rows = spark.createDataFrame([(1, "a", 3), (1, "a", 9)], "id int, name string, v int")
    with pytest.raises(Exception, match="several rows of one name"):
        reshape.pivot_wider(rows, ["id"], "name", ["v"], ["a", "b"]).collect()
    twice = X.wave_dictionary(spark, {"A": "CORP_M_BL_IDEA", "B": "CORP_M_BL_IDEA"})
    with pytest.raises(Exception, match="not unique in a wave"):
        X.availability({"w": twice}).collect()


def test_text_column_beside_the_cells(spark):
    choices = V.table_choices("CORP", False)
    cells = [c for pair in choices for c in (pair.five, pair.seven) if c]
    rows = [("01", "1", "011", *["2" if "_7_" in c else "-" for c in cells], "-"), ("01", "2", "012", *["-" for _ in cells], "remark")]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ["LEAID", "SCHID", "COMBOKEY", *cells, "TOT_AME_7_NOTE"]))
    found = {r.COMBOKEY: r.RACES_REPORTED for r in waves.table_2009(raw, "CORP", False).collect()}
    assert found == {"011": 7, "012": 5}


def test_state_names_per_fips(spark):
    def sums(*rows):
        df = spark.createDataFrame([(2011, lea, state, 1) for lea, state in rows], "YEAR int, LEAID string, STATE string, x long")
        return sorted((r.STATE_CODE, r.x) for r in state_tables.state_sums(df, ["x"]).collect())

    assert sums(("0101", "AL"), ("0102", "")) == [("AL", 2)]
    assert sums(("0101", "AL"), ("0102", "AL")) == [("AL", 2)]
    assert sums(("0101", "AK"), ("0102", "AL")) == [("AL", 2)]
    for bad in ([("0101", "AK"), ("0102", "AL"), ("0103", "")], [("0101", "AK"), ("0102", "AL"), ("0103", "AZ")]):
        with pytest.raises(Exception, match="several states share FIPS"):
            sums(*bad)


def test_labels_take_one_projection(spark):
    df = spark.range(1).select(*[F.col("id").alias(f"c{i}") for i in range(200)])
    named = K.label(df, {f"c{i}": f"label {i}" for i in range(200)})
    assert named.schema["c7"].metadata == {"comment": "label 7"}
    assert named._jdf.queryExecution().analyzed().toString().count("Project") <= 2
    assert K.clear_labels(named).schema["c7"].metadata == {}
