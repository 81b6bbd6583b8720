"""Waves, panels, state tables and series end to end on small data."""

import os

import pytest
from pyspark.sql import functions as F

from stratapanel.functions import vocabulary as V
from stratapanel.operators import crosswalk as X
from stratapanel.plans import panels, series, state_tables, waves
from stratapanel.sources import io

HERE = os.path.dirname(os.path.abspath(__file__))
# The law table (laws.csv) and state codes by name, as the state dimension holds them.
CODES = dict(
    zip(
        open(os.path.join(HERE, "laws.csv")).read().split("\n")[1:52],
        "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split(),
    )
)


def raw_table(spark, disabled, rows, year=2011, standards=("7",)):
    """All-text table with the given cells; the rest is filler."""
    choices = V.table_choices("CORP", disabled)
    columns = [c for pair in choices for c in (pair.five if "5" in standards else None, pair.seven) if c]
    data = [[lea, sch, lea + sch] + [cells.get(c, "-" if year == 2009 else "‡") for c in columns] for lea, sch, cells in rows]
    return spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in ["LEAID", "SCHID", "COMBOKEY", *columns]))


def test_crosswalk_sizes():
    assert len(V.modern_crosswalk("OSS", 2015)) == len(V.modern_crosswalk("OSS", 2017)) == 181
    assert len(V.table_choices("ISS", True)) == 20 and len(V.table_choices("ISS", False)) == 18
    for topic in ("CP", "OSS"):
        for year in V.MODERN_YEARS:
            names = V.modern_crosswalk(topic, year)
            assert len(set(names.values())) == len(names)
            assert all(X.parse_name(t) for t in names.values())
    with pytest.raises(ValueError):
        V.modern_crosswalk("CP", 2014)


def test_crosswalk_oddities():
    published, regular = V.modern_crosswalk("OSS", 2020), V.modern_crosswalk("OSS", 2020, as_published=False)
    changed = {s for s in published if published[s] != regular[s]}
    assert changed == {f"SCH_PSDISC_OOMOOS_{x}_{g}" for x in ("TR", "IDEA") for g in "MF"}
    assert published["SCH_PSDISC_OOMOOS_IDEA_M"] == "OSS_F_IDEA_PS"
    assert regular["SCH_PSDISC_OOMOOS_TR_F"] == "OSS_F_MR_PS"
    assert V.historic_crosswalk("CP")["T_AME_COR"] == "CORP_AI"
    assert V.historic_crosswalk("OSS")["F_LEP_SUS"] == "OSS_F_LEP"


def test_2011_wave(spark, rows):
    raw = raw_table(spark, False, [("01", "1", {"M_BLA_7_CORP_NO_DIS": "4", "F_WHI_7_CORP_NO_DIS": "-9"}), ("01", "2", {"M_BLA_7_CORP_NO_DIS": "3"})])
    raw = raw.withColumn("Incomplete", F.when(F.col("SCHID") == "2", "Yes")).withColumn("JJ", F.lit("No"))
    school = waves.table_2011(raw, "CORP", False)
    assert rows(school, "COMBOKEY", "CORP_M_BL_NODIS", "CORP_F_WH_NODIS", "INCOMPLETE") == [("011", 4, None, 0), ("012", 3, None, 1)]
    assert "JJ" not in school.columns
    lea = waves.to_lea(school)
    assert rows(lea, "LEAID", "CORP_M_BL_NODIS", "CORP_F_WH_NODIS", "YEAR", "RACES_REPORTED") == [("01", 7, 0, 2011, 7)]
    assert "INCOMPLETE" not in lea.columns


def test_2009_wave(spark, rows):
    cells = [
        ("01", "1", {"M_BLA_5_CORP_NO_DIS": "4", "M_BLA_7_CORP_NO_DIS": "0"}),
        ("01", "2", {"M_BLA_7_CORP_NO_DIS": "3", "M_HI_PAC_7_CORP_NO_DIS": "-9"}),
        ("02", "3", {"M_BLA_5_CORP_NO_DIS": "-5"}),
    ]
    raw = raw_table(spark, False, cells, 2009, ("5", "7"))
    for declared in (False, True):
        faithful = waves.table_2009(raw, "CORP", False, declared=declared)
        assert rows(faithful, "COMBOKEY", "RACES_REPORTED", "CORP_M_BL_NODIS", "CORP_M_HP_NODIS") == [
            ("011", 5, 4, None), ("012", 7, 3, 9), ("023", 5, 5, None)]
        strict = waves.table_2009(raw, "CORP", False, mode="strict", declared=declared)
        assert rows(strict, "COMBOKEY", "RACES_REPORTED", "CORP_M_BL_NODIS", "CORP_M_HP_NODIS") == [
            ("011", 5, 4, None), ("012", 7, 3, None), ("023", 5, None, None)]
    unscrubbed = waves.table_2009(raw, "CORP", False, mode="strict", scrubbed=False)
    assert rows(unscrubbed, "CORP_M_BL_NODIS", "CORP_M_HP_NODIS") == [(-5, None), (3, -9), (4, None)]
    district = waves.table_2009(raw.withColumn("YEAR", F.lit("2009")), "CORP", False, level="lea")
    assert district.columns[:3] == ["LEAID", "YEAR", "RACES_REPORTED"]


def modern(spark, topic, year, rows_):
    names = V.modern_crosswalk(topic, year)
    ids = ["LEA_STATE", "LEAID", "SCHID", "COMBOKEY", "SCH_CORPINSTANCES_IND"]
    data = [[*i, *[cells.get(t, "0") for t in names.values()]] for *i, cells in rows_]
    return spark.createDataFrame(data, ", ".join(f"`{c.lower()}` string" for c in [*ids, *names]))


def test_modern_wave(spark, rows):
    raw = modern(spark, "CP", 2015, [("AL", "0100005", "12", "1e11", "Yes", {"CORP_M_BL_IDEA": "6", "CORP_M_BL_PS": "-9"}), ("AL", "0100005", "7", "1e11", "-5", {})])
    school = waves.table_modern(raw.withColumn("jj", F.lit("x")), "CP", 2015)
    assert rows(school, "COMBOKEY", "SCHID", "CORPIND", "CORP_M_BL_IDEA", "CORP_M_BL_PS") == [
        ("010000500007", "00007", None, 0, 0), ("010000500012", "00012", 1, 6, None)]
    assert rows(waves.to_lea(school), "LEAID", "CORPIND", "CORP_M_BL_IDEA", "YEAR") == [("0100005", 1, 6, 2015)]
    with pytest.raises(ValueError, match="not found"):
        waves.table_modern(raw.drop("sch_psdisc_corp_am_m"), "CP", 2015)
    wide = modern(spark, "OSS", 2017, [("AL", "01", "1", "011", "No", {"SINGOSS_M_BL_NODIS": "5"})])
    assert len(waves.measures_of(waves.table_modern(wide, "OSS", 2017))) == 181


def test_fused_totals_equal_panel(spark, rows):
    """The one-shuffle totals against merge by merge: every table, null and overlap case."""
    nodis = waves.table_2011(raw_table(spark, False, [("01", "1", {"M_BLA_7_CORP_NO_DIS": "4"}), ("01", "2", {"F_BLA_7_CORP_NO_DIS": "1"}), ("02", "1", {})]), "CORP", False)
    dis = waves.table_2011(raw_table(spark, True, [("01", "1", {"M_BLA_7_CORP_DIS": "2", "M_504_7_CORP_DIS": "50"}), ("03", "1", {"F_HI_PAC_7_CORP_DIS": "8"})]), "CORP", True)
    new = waves.table_modern(modern(spark, "CP", 2013, [("AL", "01", "1", "011", "Yes", {"CORP_M_WH_NODIS": "3"})]), "CP", 2013)
    old = spark.createDataFrame([("01", "1976", "1", None, "", "3", "4"), ("02", "2011", None, None, None, "77", None)], "LEAID string, YEAR string, T_AME_COR string, T_ASI_COR string, T_HIS_COR string, T_BLA_COR string, T_WHI_COR string")
    historic = waves.historic_lea(old, "CP")
    disabled = spark.createDataFrame([("01", 1980, 3, 4), ("05", 1980, None, None)], "LEAID string, YEAR int, XUSE_68 int, CORP_DS int")
    extra = waves.historic_disabled(disabled.select("LEAID", "YEAR", F.col("XUSE_68").cast("string"), F.col("CORP_DS").cast("string")))
    assert rows(extra, "LEAID", "CORP_DIS") == [("01", 7), ("05", None)]

    # The historic table has a 2011 row, so it takes part in that year's merge.
    lea2011 = [historic, waves.to_lea(nodis), waves.to_lea(dis)]
    panel = panels.lea_panel({2011: lea2011, 2013: [waves.to_lea(new)]}, "CP")
    fused = panels.lea_totals("CP", schools=[nodis, dis, new], historic=[historic])
    names = ["LEAID", "YEAR", *[f"CORP_{r}" for r in V.RACES], "CORP_sumrace"]
    assert rows(fused, *names) == rows(panel, *names)
    got = {(r["LEAID"], r["YEAR"]): r for r in fused.collect()}
    assert got["01", 2011]["CORP_BL"] == 7 and got["01", 2011]["CORP_sumrace"] == 7
    assert got["02", 2011]["CORP_BL"] == 77 and got["02", 2011]["CORP_HP"] == 0
    assert got["01", 1976]["CORP_HP"] is None and got["01", 1976]["CORP_sumrace"] == 8
    assert got["03", 2011]["CORP_HP"] == 8


def test_suspension_totals(spark, rows):
    def district(measure, disabled, cells):
        names = [c.target for c in V.table_choices(measure, disabled)]
        data = [("01", 2009, *[cells.get(n) for n in names])]
        return spark.createDataFrame(data, "LEAID string, YEAR int, " + ", ".join(f"`{n}` bigint" for n in names))

    tables = [
        district("SINGOSS", True, {"SINGOSS_M_BL_IDEA": 1}), district("MULTOSS", True, {"MULTOSS_F_BL_IDEA": 2}),
        district("ISS", True, {"ISS_M_BL_IDEA": 100}), district("SINGOSS", False, {"SINGOSS_M_BL_NODIS": 4}),
    ]
    panel = panels.lea_panel({2009: tables}, "OSS")
    fused = panels.lea_totals("OSS", districts=tables)
    names = ["LEAID", "YEAR", "OSS_BL", "OSS_WH", "OSS_sumrace"]
    assert rows(panel, *names) == rows(fused, *names) == [("01", 2009, 7, None, 7)]


def test_school_panel(spark, rows):
    a = spark.createDataFrame([("s1", 2011, 1)], "COMBOKEY string, YEAR int, x int")
    b = spark.createDataFrame([("s1", 2011, 2), ("s2", 2011, 3)], "COMBOKEY string, YEAR int, y int")
    c = spark.createDataFrame([("s1", 2013, 4)], "COMBOKEY string, YEAR int, x int")
    assert rows(panels.school_panel({2011: [a, b], 2013: [c]}), "COMBOKEY", "YEAR", "x", "y") == [
        ("s1", 2011, 1, 2), ("s1", 2013, 4, None), ("s2", 2011, None, 3)]


def _district_tables(spark, prefix):
    groups = state_tables.GROUPS
    enr = [("0100001", 2011, "AL"), ("0100002", 2011, ""), ("0200001", 2011, "AK"), ("0200002", 2013, None), ("0900001", 2011, None), ("0100003", 2013, "AL")]
    enrolment = spark.createDataFrame([(i, y, s, *[10 * (k + 1) for k, _ in enumerate(groups)]) for i, y, s in enr], "LEAID string, YEAR int, STATE string, " + ", ".join(f"ENR_{g} int" for g in groups))
    out = [("0100001", 2011, 3), ("0100002", 2011, 4), ("0200001", 2011, None), ("0200002", 2013, 0), ("0900001", 2011, 2), ("16SOP01", 2011, 1)]
    panel = spark.createDataFrame([(i, y, *[v for _ in groups]) for i, y, v in out], "LEAID string, YEAR int, " + ", ".join(f"{prefix}_{g} int" for g in groups))
    return enrolment, panel


def test_corporal_punishment_table(spark, rows):
    enrolment, panel = _district_tables(spark, "CORP")
    table = state_tables.corporal_punishment_table(enrolment, panel)
    assert table.count() == 3 * 8
    total = table.filter("race = 'sumrace'")
    # The unreported AK district is out of the sample, and with it the name of its state.
    assert rows(total, "YEAR", "STATE_CODE", "CORP_", "ENR_") == [(2011, None, 0, 80), (2011, "AL", 5, 160), (2013, None, 0, 80)]


def test_suspension_table(spark, rows):
    enrolment, panel = _district_tables(spark, "OSS")
    table = state_tables.suspension_table(enrolment, panel)
    total = table.filter("race = 'total'")
    # Names come from all matched rows here, so AK is known.
    assert rows(total, "YEAR", "STATE_CODE", "OSS_", "ENR_", "pct_") == [
        (2011, None, 2, 80, 2.5), (2011, "AL", 7, 160, 4.375), (2013, "AK", 0, 80, None)]
    everyone = state_tables.suspension_table(enrolment, panel, rule="all")
    assert rows(everyone.filter("race = 'total'"), "YEAR", "STATE_CODE", "ENR_")[1:3] == [(2011, "AK", 80), (2011, "AL", 160)]


def test_state_sums_equal_lookup_join(spark, rows):
    enrolment, panel = _district_tables(spark, "CORP")
    matched = state_tables.attach(enrolment, panel)
    columns = state_tables.outcome_columns("CP")
    by_join = state_tables.collapse(state_tables.fill_state(matched), ["YEAR", "STATE_CODE"], columns)
    assert rows(state_tables.state_sums(matched, columns)) == rows(by_join)
    two = spark.createDataFrame([("0300001", 2011, s, 1) for s in ("", "AZ", "ZZ")], "LEAID string, YEAR int, STATE string, ENR_AI int")
    with pytest.raises(Exception, match="share FIPS 03"):
        state_tables.state_sums(two, ["ENR_AI"]).collect()
    named = spark.createDataFrame([("0300001", 2011, s, 1) for s in ("AZ", "ZZ")], "LEAID string, YEAR int, STATE string, ENR_AI int")
    assert rows(state_tables.state_sums(named, ["ENR_AI"])) == [(2011, "ZZ", 2)]


def _cohort(spark):
    laws = io.read_csv(spark, os.path.join(HERE, "laws.csv"))
    states = spark.createDataFrame([(c, n.split(",")[0]) for n, c in CODES.items()] * 2, "state string, state_name string")
    return series.law_cohort(laws, states)


def test_law_cohort(spark, rows):
    cohort = _cohort(spark)
    assert [r[0] for r in rows(cohort)] == "AL AR AZ CO FL GA ID IN KS KY LA MO MS NC OK SC TN TX WY".split()
    everywhere = spark.createDataFrame([(c,) for c in CODES.values()], "STATE_CODE string")
    assert series.in_cohort(everywhere, "always", cohort).count() == 19
    assert series.in_cohort(everywhere, "sometime", cohort).count() == 30
    tagged = series.tag_cohorts(everywhere, cohort).groupBy("cohort").count()
    assert dict(rows(tagged)) == {"all": 51, "always": 19, "sometime": 30}


def test_null_state_is_kept_by_sometime(spark, rows):
    table = spark.createDataFrame([(None,), ("NJ",), ("AL",), ("NY",)], "STATE_CODE string")
    assert rows(series.in_cohort(table, "sometime", _cohort(spark))) == [(None,), ("NY",)]
    tags = series.tag_cohorts(table, _cohort(spark))
    assert rows(tags.filter("cohort = 'sometime'"), "STATE_CODE") == [(None,), ("NY",)]


def _state_table(spark):
    data = [(2017, "TX", "BL", 10, 100), (2017, "TX", "WH", 5, 100), (2017, "TX", "HP", 1, 10), (2017, "TX", "AI", 1, 10),
            (2017, "TX", "MR", 2, 10), (2017, "TX", "sumrace", 19, 230), (2015, "TX", "BL", 10, 100), (2015, "TX", "WH", 0, 100),
            (1974, "TX", "BL", 1, 1), (2020, "TX", "BL", 1, 1), (2013, "TX", "BL", None, 4), (2013, "NY", "BL", 3, 4)]
    return spark.createDataFrame(data, "YEAR int, STATE_CODE string, race string, CORP_ int, ENR_ int")


def test_rate_series(spark, rows):
    out = series.rate_series(series.without_year(_state_table(spark)))
    got = {(r["YEAR"], r["race_fixed"]): r for r in out.collect()}
    assert set(got) == {(2017, "BL"), (2017, "WH"), (2017, "AI"), (2015, "BL"), (2015, "WH"), (2013, "BL")}
    assert got[2017, "AI"]["cp_rate"] == 0.1 and got[2017, "AI"]["cp_sum"] == 2
    assert got[2013, "BL"]["cp_sum"] is None and got[2013, "BL"]["cp_rate"] is None
    assert got[2017, "BL"]["legend_text"] == "Black / African American" and got[2017, "BL"]["size"] == "not_all"


def test_risk_series(spark, rows):
    out = series.risk_series(series.without_year(_state_table(spark)))
    got = {(r["YEAR"], r["type"]): r["value"] for r in out.collect()}
    assert len(got) == 3 * 12 == out.count()
    assert got[2017, "bl_wh_rr"] == 2.0 and got[2017, "bl_wh_rd"] == 0.05
    assert got[2015, "bl_wh_rr"] is None and got[2015, "bl_wh_rd"] == 0.1
    assert got[2013, "bl_wh_rr"] is None
    assert got[2017, "ot_wh_rr"] == pytest.approx(3 / 20 / 0.05)
    assert (2020, "bl_wh_rr") in {(r["YEAR"], r["type"]) for r in series.risk_series(_state_table(spark)).collect()}
    assert rows(series.universe(out, [2015]).select("YEAR").distinct()) == [(2015,)]
    shown = [tuple(r) for r in series.chart_ready(out).select("legend_text", "YEAR", "value").collect()]
    assert shown == [("American Indian or Alaskan Native / White Risk Ratio", 2017, 2.0), ("Black / White Risk Ratio", 2017, 2.0)]


def test_year_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    _state_table(spark).write.parquet(path)
    plan = series.risk_series(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(YEAR,1975)" in plan and "PartitionFilters" in plan


def test_dictionary(spark, rows):
    d2011 = X.wave_dictionary(spark, V.table_crosswalk("CORP", True))
    d2013 = X.wave_dictionary(spark, V.modern_crosswalk("CP", 2013))
    assert rows(d2011.filter("name = 'M_504_7_CORP_DIS'"), "name_merge", "gender", "race", "status", "DIS", "LEP", "PS") == [
        ("CORP_M_504", "M", None, "504", 1, 0, 0)]
    table = X.availability({"w2011": d2011, "w2013": d2013})
    assert table.count() == 38
    assert rows(table.filter("name_merge = 'CORP_F_BL_IDEA'"), "w2011", "w2013") == [("F_BLA_7_CORP_DIS", "SCH_DISCWDIS_CORP_IDEA_BL_F")]
    assert rows(table.filter("name_merge = 'CORP_F_BL_NODIS'"), "w2011", "w2013") == [(None, "SCH_DISCWODIS_CORP_BL_F")]
