"""Cells as one array column: the same numbers as column by column, and code that compiles at any width."""

import pytest
from pyspark.sql import functions as F

from stratapanel import catalog
from stratapanel.functions import cleaning as C
from stratapanel.operators import cells
from stratapanel.operators.crosswalk import convertible, destring

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "-", ".", "12", " 7 ", "-9", "--3-", "12.0", "1e2", "+4", "007", None, "999999999999999999", "-0"]
WAVES = [
    "wave_ingest_to_lea", "modern_wave_to_lea", "modern_2015_to_lea", "modern_2020_to_lea", "oss_2015_to_lea", "oss_2017_to_lea", "oss_2020_to_lea", "oss_panel_totals",
    "lea_panel_totals", "school_panel", "standard_detect_select",
]


@pytest.mark.parametrize("mode", C.STRIP_MODES)
@pytest.mark.parametrize("ignore", ["", "-"])
def test_longs_are_those_of_single_columns(spark, mode, ignore):
    texts = [t for t in TEXTS if ignore and mode == "faithful" or t != "--3-" and (ignore or t != "-")]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts[::3]], "a string, b string")
    held = cells.gather(df, ["a", "b"]).select("a", "b", cells.to_longs(ignore=ignore, mode=mode).alias(cells.CELLS))
    both = held.select(*cells.unpacked(["a", "b"]).values(), C.text_to_long("a", ignore, mode), C.text_to_long("b", ignore, mode)).collect()
    assert both and all(r[0] == r[2] and r[1] == r[3] for r in both)
    scrubbed = cells.gather(df, ["a"]).select(cells.to_longs(ignore=ignore, mode=mode, scrubbed=True)[0]).collect()
    assert all(v[0] is None or v[0] >= 0 for v in scrubbed)


def test_doubles_and_grades(spark):
    df = spark.createDataFrame([("1.5", "x", "3", None), ("2", "", "-", "1e400")], "a string, b string, c string, d string")
    held = cells.gather(df, list("abcd")).select(cells.grades(ignore="-").alias("g"), cells.to_doubles(ignore="-").alias("v")).collect()
    assert [r.g for r in held] == [[1, 2, 0, 0], [0, 0, 0, 1]]
    assert [r.v for r in held] == [[1.5, None, 3.0, None], [2.0, None, None, float("inf")]]
    assert convertible(df, list("abc"), ignore="-") == {"a": "double", "b": "string", "c": "bigint"}
    assert convertible(df.limit(0), ["a"]) == {"a": "bigint"} and convertible(df, []) == {}


def test_order_of_columns_and_names_with_dots(spark):
    df = spark.createDataFrame([("1", "k", "2.5", "t")], ["x.1", "LEAID", "y", "z"])
    out = destring(df)
    assert out.columns == ["x.1", "LEAID", "y", "z"] and out.dtypes[0][1] == "bigint" and out.dtypes[2][1] == "double"
    assert tuple(out.first()) == (1, "k", 2.5, "t")


def test_text_in_a_declared_column_stops_the_job(spark):
    df = spark.createDataFrame([("1", "2"), ("3", "4x")], "a string, b string")
    with pytest.raises(Exception, match="no whole number: 4x"):
        destring(df, ["a", "b"], declared=True).collect()


@pytest.mark.parametrize("name", WAVES)
def test_waves_of_any_width_compile(spark, name):
    """Without the fallback to interpreted code, a stage whose code is too large stops the query."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert catalog.queries()[name](spark, SF).agg(F.count("*")).first()[0] > 0
        catalog.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
