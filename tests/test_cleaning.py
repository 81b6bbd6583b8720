import pytest
from pyspark.sql import functions as F

from stratapanel.functions import cleaning as C
from stratapanel.functions import metrics as M
from stratapanel.operators import columns as K
from stratapanel.operators.crosswalk import both_standards, destring, detect_standard, scrub


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def result(df):
    return [r[1] for r in sorted(df.select("i", "x").collect())]


def test_scrub(spark):
    assert result(scrub(column(spark, [-9, -5, 0, 7, None], "int"))) == [None, None, 0, 7, None]
    assert result(scrub(column(spark, [-0.5, 0.5], "double"))) == [None, 0.5]


@pytest.mark.parametrize("declared", [False, True])
def test_destring_modes(spark, declared):
    df = column(spark, ["-", "12", "-9", "", None, " 7 ", "."][: 6 if declared else 7])
    faithful = destring(df, ["x"], ignore="-", declared=declared)
    strict = destring(df, ["x"], ignore="-", mode="strict", declared=declared)
    assert dict(faithful.dtypes)["x"] == dict(strict.dtypes)["x"] == "bigint"
    assert result(faithful)[:6] == [None, 12, 9, None, None, 7]
    assert result(strict)[:6] == [None, 12, -9, None, None, 7]


def test_destring_all_or_nothing(spark):
    kept = destring(column(spark, ["12", "16SOP01"]), ["x"])
    assert dict(kept.dtypes)["x"] == "string" and result(kept) == ["12", "16SOP01"]
    for text in ("16SOP01", "1.5", "NaN", "1d"):
        with pytest.raises(Exception, match="no whole number"):
            destring(column(spark, ["12", text]), ["x"], declared=True).collect()
    notations = destring(column(spark, ["12.0", "1e2", "-", " 3 ", "."]), ["x"], ignore="-", declared=True)
    assert result(notations) == [12, 100, None, 3, None]
    fractions = destring(column(spark, ["1.5", "2", "1e2", "-"]), ["x"], ignore="-")
    assert result(fractions) == [1.5, 2.0, 100.0, None]
    assert result(destring(column(spark, ["‡", "3", "‡‡"]), ["x"], ignore="‡")) == [None, 3, None]
    words = destring(column(spark, ["NaN", "1"]), ["x"])
    assert dict(words.dtypes)["x"] == "string"


def test_destring_keeps_ids(spark):
    df = spark.createDataFrame([("0100005", "3")], "LEAID string, n string")
    out = destring(df)
    assert dict(out.dtypes) == {"LEAID": "string", "n": "bigint"}


def test_standard(spark, rows):
    df = spark.createDataFrame([(0, 0), (3, 0), (0, 4), (3, 4)], "M_A_5_X int, M_A_7_X int")
    assert [r[2] for r in detect_standard(df).collect()] == [5, 5, 7, 7]
    assert both_standards(df).count() == 1


def test_flag_and_remark(spark):
    flagged = column(spark, ["Yes", "No", "-5", None]).withColumn("x", C.flag_code("x"))
    assert result(scrub(flagged)) == [1, 0, None, None]
    assert result(column(spark, [None, "Yes", ""]).withColumn("x", C.incomplete_flag("x"))) == [0, 1, 0]


def test_encode_and_recode(spark, rows):
    df = column(spark, ["b", None, "a", "", "c", "a"])
    coded = K.encode(df, "x", "code")
    assert rows(coded, "i", "code") == [(0, 2), (1, None), (2, 1), (3, None), (4, 3), (5, 1)]
    out = K.recode(coded, "code", {None: 0, 2: 1, 3: 1})
    assert rows(out, "i", "code") == [(0, 1), (1, 0), (2, 1), (3, 0), (4, 1), (5, 1)]
    many = spark.range(100_000).select(F.format_string("v%06d", "id").alias("x"), "id")
    assert K.encode(many.repartition(7), "x", "code").filter("code <> id + 1").count() == 0


def test_keys(spark, rows):
    df = spark.createDataFrame([("0100005", "12"), ("0100005", "123456"), ("0100005", None), ("0100005", "x")], "l string, s string")
    out = df.select(C.zero_pad("s").alias("s"), C.school_key("l", "s").alias("k"), C.state_prefix("l").alias("f"))
    assert rows(out) == [(".", "0100005.", "01"), (".", "0100005.", "01"), ("00012", "010000500012", "01"), ("123456", "0100005123456", "01")]


def test_rounding_and_percent(spark, rows):
    df = column(spark, [0, 2, 3, 7, 8, 12, 13, None], "int")
    assert result(df.withColumn("x", M.round_to("x"))) == [0, 0, 5, 5, 10, 10, 15, None]
    pairs = spark.createDataFrame([(0, 10), (5, 10), (1, 0)], "a int, b int")
    assert [r[0] for r in pairs.select(M.percent_or_null("a", "b")).collect()] == [None, 50.0, None]


def test_recodes(spark):
    assert result(column(spark, ["BL", "HP", "MR", None]).withColumn("x", M.other_group("x"))) == ["BL", "OTHER", "OTHER", "OTHER"]
    assert result(column(spark, ["HP", "AS", None]).withColumn("x", M.merge_group("x"))) == ["AI", "AS", None]
    assert result(column(spark, ["2021", "2017"]).withColumn("x", C.rewrite_year("x", 2021, 2020))) == [2020, 2017]
    labels = column(spark, ["AI", "sumrace", "??", None]).withColumn("x", M.group_label("x", "sumrace"))
    assert result(labels) == ["American Indian / Alaskan Native", "All Students", "check", None]
    types = column(spark, ["bl_wh_rr", "bl_hi_rr"]).withColumn("x", M.type_label("x"))
    assert result(types) == ["Black / White Risk Ratio", "other"]
    sizes = column(spark, ["sumrace", "WH", None]).withColumn("x", M.series_class("x", "sumrace"))
    assert result(sizes) == ["all", "not_all", None]


def test_rounding_stays_close(spark):
    df = spark.range(500).select(F.col("id"), M.round_to("id").alias("r"))
    assert df.filter((F.abs(F.col("id") - F.col("r")) > 2.5) | (F.col("r") % 5 != 0)).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, "x", 5)], "b int, A_1 int, A_2 int, t string, c int")
    assert K.expand(df, "A_*", ("A_2", "c"), "b") == ["A_1", "A_2", "t", "c", "b"]
    assert K.keep(df, "c", "*A*").columns == ["A_1", "A_2", "c"]
    assert K.drop(df, ("A_1", "t")).columns == ["b", "c"]
    assert K.order(df, "c", "t").columns == ["c", "t", "b", "A_1", "A_2"]
    assert K.upper_names(df).columns == ["B", "A_1", "A_2", "T", "C"]
    assert K.rename_pairs(df, ["b", "c"], ["c", "b"]).columns == ["c", "A_1", "A_2", "t", "b"]
    assert K.numeric_columns(df) == ["b", "A_1", "A_2", "c"]
    assert list(K.apply_numeric(df, lambda c: c + 1, ["b"]).first()) == [1, 3, 4, "x", 6]
    assert list(K.replace_by(K.constants(df, YEAR=2009), t=F.upper("t")).first()) == [1, 2, 3, "X", 5, 2009]
    with pytest.raises(ValueError, match="not found"):
        K.rename(df, {"nope": "x"})
    with pytest.raises(ValueError, match="not found"):
        K.keep(df, "nope")
    assert K.rename(df, {"nope": "x"}, missing="skip").columns == df.columns


def test_labels(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    labelled = K.label(df, {"a": "District id"})
    assert labelled.schema["a"].metadata["comment"] == "District id"
    assert "comment" not in K.clear_labels(labelled).schema["a"].metadata
