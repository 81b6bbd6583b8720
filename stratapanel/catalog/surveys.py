"""Raw wave extracts cut from the test tables, and their way to district and school panels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import columns as K
from ..operators import crosswalk as X
from ..operators.merge import merge_buckets
from ..plans import panels, waves
from ..sources import io
from . import base as B
from . import expected as E

SUSPENSIONS = ["SINGOSS", "MULTOSS", "ISS"]
# Which survey year stands for which wave in the panels of all waves.
LAYOUTS = [(1996, 2009), (1997, 2011), (1998, 2013), (1999, 2015), (2000, 2017), (2001, 2020)]
CELLS = [f"{g}_{r}_{s}" for s in ("NODIS", "IDEA") for g in V.GENDERS for r in V.RACES]
TOTALS = [f"{g}_{s}" for s in ("NODIS", "IDEA", "LEP") for g in V.GENDERS]


def school_cells(spark: SparkSession, sf: str, years: Column | None = None) -> DataFrame:
    """One row per order: quantity by sex, racial group and status, null where there is none."""
    lines = B.table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("sex"),
        (F.col("l_suppkey") % len(B.RACES)).cast("int").alias("race"),
        F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("status"),
        F.col("l_quantity").cast("bigint").alias("qty"),
    )

    def cell(name: str) -> Column:
        parts = name.split("_")
        test = f"sex = {'MF'.index(parts[0])} AND status = {['NODIS', 'IDEA', 'LEP'].index(parts[-1])}"
        if len(parts) == 3:
            test = f"race = {B.RACES.index(parts[1])} AND {test}"
        return F.expr(f"sum(CASE WHEN {test} THEN qty END) AS {name}")

    sums = lines.groupBy("l_orderkey").agg(*[cell(c) for c in CELLS + TOTALS])
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", B.year_of().alias("SURVEY_YEAR"))
    if years is not None:
        orders = orders.filter(years)
    return sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def cell_text(c: str, filler: str) -> Column:
    """Cell as published: filler where empty, a reserve code where it divides by eleven."""
    return F.expr(f"CASE WHEN {c} IS NULL THEN '{filler}' WHEN {c} % 11 = 0 THEN '-9' ELSE CAST({c} AS STRING) END")


def _ids() -> list[Column]:
    return [
        B.district_id().alias("LEAID"),
        F.col("o_orderkey").cast("string").alias("SCHID"),
        F.concat(B.district_id(), F.format_string("%05d", "o_orderkey")).alias("COMBOKEY"),
    ]


def recent(topic: str, year: int, as_published: bool = True) -> list[E.Name]:
    return E.recent(year) if topic == "CP" else E.recent_suspensions(year, as_published)


def raw_2011(cells: DataFrame, disabled: bool, measure: str = "CORP") -> DataFrame:
    columns = [cell_text(c.cell, "‡").alias(c.source) for c in E.older(measure, disabled)]
    remark = F.when(F.col("o_orderstatus") == "P", "Yes").alias("Incomplete")
    return cells.select(*_ids(), *columns, remark)


def raw_2009(cells: DataFrame, measure: str = "CORP", disabled: bool = False) -> DataFrame:
    """Schools with order status F report five categories, the others seven."""
    five = F.col("o_orderstatus") == "F"
    columns = []
    for c in E.older(measure, disabled):
        text = cell_text(c.cell, "-")
        if c.five:
            columns.append(F.when(five, text).otherwise("-").alias(c.five))
        columns.append(F.when(five, "-").otherwise(text).alias(c.source))
    return cells.select(*_ids(), *columns)


def raw_2009_districts(cells: DataFrame, measure: str, disabled: bool) -> DataFrame:
    """The restricted layout: one row per order stands for a district, which brings its year."""
    return raw_2009(cells, measure, disabled).withColumn("LEAID", F.col("SCHID")).withColumn("YEAR", F.lit("2009"))


def raw_modern(cells: DataFrame, year: int = 2013, topic: str = "CP") -> DataFrame:
    """One wide extract, lower-case names, with the instances flag."""
    columns = [cell_text(c.cell, "").alias(c.source.lower()) for c in recent(topic, year)]
    said = F.col("o_orderstatus")
    flag = F.when(said == "F", "Yes").when(said == "O", "No").otherwise("-5").alias(waves.INDICATOR.lower())
    return cells.select(*_ids(), *columns, flag)


def raw_historic(spark: SparkSession, sf: str, years: Column, topic: str = "CP") -> DataFrame:
    """District-year extract: five groups, text counts, blank where there are none."""
    leas = B.lea_years(spark, sf).filter(years)
    columns = []
    for source, target in V.historic_crosswalk(topic).items():
        group = X.parse_name(target)["race"] or "sumrace"
        columns.append(F.expr(f"CASE WHEN CORP_{group} > 0 THEN CAST(CORP_{group} AS STRING) ELSE '' END AS {source}"))
    return leas.select(B.district_id().alias("LEAID"), F.col("YEAR").cast("string").alias("YEAR"), *columns)


# ---- queries -------------------------------------------------------------------------------


def wave_ingest_to_lea(spark, sf):
    school = waves.table_2011(raw_2011(school_cells(spark, sf), False), "CORP", False, declared=True)
    return waves.to_lea(school)


def workbook_wave_to_lea(spark, sf):
    """The extract as the sheets of workbooks, read by name with every cell as text."""
    path = io.shared_dir(spark, "workbooks")
    io.write_sheet(raw_2011(school_cells(spark, sf), False), path, sheet="Suppressed Data", partRows=20_000)
    school = waves.table_2011(io.read_sheet(spark, path, "Suppressed Data"), "CORP", False, declared=True)
    return waves.to_lea(school)


def workbook_export(spark, sf):
    """The state table as a workbook and back: counts as numbers again, a missing count an empty cell."""
    table = B.state_long(spark, sf).withColumn("CORP_", F.nullif("CORP_", F.lit(0)))
    path = io.shared_dir(spark, "workbook")
    io.write_sheet(table, path, sheet="by state")
    return X.destring(io.read_sheet(spark, path), ["YEAR", "CORP_", "ENR_"], declared=True)


def wave_ingest_data_decided(spark, sf):
    """As above, but the extract itself decides which columns are numbers."""
    school = waves.table_2011(raw_2011(school_cells(spark, sf), True), "CORP", True)
    return waves.to_lea(school)


def standard_detect_select(spark, sf):
    school = waves.table_2009(raw_2009(school_cells(spark, sf)), "CORP", False, declared=True)
    return school.drop("SCHID", "LEAID")


def modern_wave_to_lea(spark, sf):
    school = waves.table_modern(raw_modern(school_cells(spark, sf)), "CP", 2013, declared=True)
    return waves.to_lea(school)


def preschool_wave_to_lea(spark, sf):
    """2015 layout: preschool block, school number without zeros, key rebuilt."""
    raw = raw_modern(school_cells(spark, sf), 2015)
    school = waves.table_modern(raw, "CP", 2015, declared=True)
    return school.drop("LEAID", "SCHID")


def recent_wave_to_lea(topic: str, year: int, as_published: bool = True):
    """District sums of a 2015, 2017 or 2020 wave, every measure of it."""

    def run(spark, sf):
        raw = raw_modern(school_cells(spark, sf), year, topic)
        return waves.to_lea(waves.table_modern(raw, topic, year, declared=True, as_published=as_published))

    return run


def lea_2009(scrubbed: bool, measure: str = "CORP", disabled: bool = False):
    """A table of the restricted district layout of 2009."""

    def run(spark, sf):
        raw = raw_2009_districts(school_cells(spark, sf), measure, disabled)
        return waves.table_2009(raw, measure, disabled, level="lea", declared=True, scrubbed=scrubbed)

    return run


def destring_decimal_text(spark, sf):
    """Counts written as 12, 12.0 or 1.2e1, declared as counts."""
    lines = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    text = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.col("q").cast("string"), F.lit(".0")))
        .when(F.col("l_linenumber") == 2, F.concat(F.col("q").cast("string"), F.lit("e0")))
        .when(F.col("l_linenumber") == 3, F.lit("-"))
        .otherwise(F.col("q").cast("string"))
    )
    return X.destring(lines.select("l_orderkey", "l_linenumber", text.alias("count")), ["count"], ignore="-", declared=True)


def historic_lea_ingest(spark, sf):
    """District extract of the early years with the counts for students with disabilities merged in."""
    every = F.col("YEAR") > 0
    reported = waves.historic_lea(raw_historic(spark, sf, every), "CP")
    leas = B.lea_years(spark, sf)
    disabled = waves.historic_disabled(
        leas.select(
            B.district_id().alias("LEAID"), "YEAR",
            F.when(F.col("YEAR") < 1998, F.col("CORP_HP").cast("string")).alias("XUSE_68"),
            F.when(F.col("YEAR") % 2 == 0, F.col("CORP_MR").cast("string")).alias("CORP_DS"),
        )
    )
    return panels.stack_panel({1973: [reported, disabled]}, V.DISTRICT_KEY)


def _panel_tables(spark, sf):
    early, middle, late = F.col("SURVEY_YEAR") <= 1997, F.col("SURVEY_YEAR").between(1998, 1999), F.col("SURVEY_YEAR") >= 2000
    historic = waves.historic_lea(raw_historic(spark, sf, F.col("YEAR") <= 1997), "CP")
    cells = io.materialize(spark, io.shared_dir(spark, "cells"), lambda: school_cells(spark, sf, middle | late))
    mid = cells.filter(middle)
    nodis = waves.table_2011(raw_2011(mid, False), "CORP", False, declared=True)
    dis = waves.table_2011(raw_2011(mid, True), "CORP", True, declared=True)
    modern = waves.table_modern(raw_modern(cells.filter(late)), "CP", 2013, declared=True)
    return historic, nodis, dis, modern


def lea_panel_totals(spark, sf):
    """Race totals per district and year over three layouts, in one shuffle of partial sums."""
    historic, nodis, dis, modern = _panel_tables(spark, sf)
    return panels.lea_totals("CP", schools=[nodis, dis, modern], historic=[historic])


def lea_panel_wide(spark, sf):
    """The district panel with all its columns: reported counts and those for students with disabilities early on, then two
    tables of one wave merged, then one wide table."""
    reported, nodis, dis, modern = _panel_tables(spark, sf)
    leas = B.lea_years(spark, sf).filter("YEAR <= 1997")
    disabled = waves.historic_disabled(
        leas.select(B.district_id().alias("LEAID"), "YEAR", F.col("CORP_HP").cast("string").alias("XUSE_68"), F.lit(None).cast("string").alias("CORP_DS"))
    )
    by_year = {1973: [reported, disabled], 2011: [waves.to_lea(nodis), waves.to_lea(dis)], 2013: [waves.to_lea(modern)]}
    return panels.lea_panel(by_year, "CP")


def race_totals(spark, sf):
    """Totals of a stacked panel: a reported total goes before the sum of its cells, and all missing stays missing."""
    leas = B.lea_years(spark, sf)
    cells = leas.select(
        B.district_id().alias("LEAID"), "YEAR", F.nullif("CORP_BL", F.lit(0)).alias("CORP_M_BL_NODIS"), F.nullif("CORP_WH", F.lit(0)).alias("CORP_F_BL_IDEA"),
        F.when(F.col("YEAR") < 1998, F.col("ENR_BL")).alias("CORP_BL"), F.nullif("CORP_AS", F.lit(0)).alias("CORP_M_AS_NODIS"),
    )
    return panels.add_race_totals(cells, "CP").select("LEAID", "YEAR", "CORP_BL", "CORP_AS", "CORP_HP", "CORP_sumrace")


def oss_panel_totals(spark, sf):
    """Suspension totals: reported early on, later single and multiple ones added up, in-school ones not."""
    historic = waves.historic_lea(raw_historic(spark, sf, F.col("YEAR") <= 1997, "OSS"), "OSS")
    cells = io.materialize(spark, io.shared_dir(spark, "cells"), lambda: school_cells(spark, sf, F.col("SURVEY_YEAR") >= 1998))
    mid = cells.filter("SURVEY_YEAR <= 1999")
    tables = [
        waves.table_2011(raw_2011(mid, disabled, measure), measure, disabled, declared=True)
        for measure, disabled in (("SINGOSS", False), ("MULTOSS", True), ("ISS", False))
    ]
    late = cells.filter("SURVEY_YEAR >= 2000")
    modern = waves.table_modern(raw_modern(late, 2013, "OSS"), "OSS", 2013, declared=True)
    return panels.lea_totals("OSS", schools=[*tables, modern], historic=[historic])


def panel_all_waves(topic: str):
    """Race totals over every layout of the panel, a survey year each: districts until 1995, then 2009, 2011, 2013, 2015, 2017 and 2020.

    Suspensions of 2009 come from six restricted district tables, those of 2011 from six school tables.
    """

    def run(spark, sf):
        historic = waves.historic_lea(raw_historic(spark, sf, F.col("YEAR") <= 1995, topic), topic)
        cells = io.materialize(spark, io.shared_dir(spark, "cells"), lambda: school_cells(spark, sf, F.col("SURVEY_YEAR") >= 1996))
        pairs = [(m, d) for m in (["CORP"] if topic == "CP" else SUSPENSIONS) for d in (False, True)]
        first, second = cells.filter("SURVEY_YEAR = 1996"), cells.filter("SURVEY_YEAR = 1997")
        schools = [waves.table_2011(raw_2011(second, d, m), m, d, declared=True) for m, d in pairs]
        for survey, year in LAYOUTS[2:]:
            schools.append(waves.table_modern(raw_modern(cells.filter(F.col("SURVEY_YEAR") == survey), year, topic), topic, year, declared=True))
        if topic == "CP":
            schools += [waves.table_2009(raw_2009(first, m, d), m, d, declared=True) for m, d in pairs]
            return panels.lea_totals(topic, schools=schools, historic=[historic])
        districts = [waves.table_2009(raw_2009_districts(first, m, d), m, d, level="lea", declared=True, scrubbed=False) for m, d in pairs]
        return panels.lea_totals(topic, schools=schools, districts=districts, historic=[historic])

    return run


def oss_school_panel(spark, sf):
    """Suspensions of schools: the six tables of 2011 merged 1:1, the wide table of 2013 below."""
    cells = io.materialize(spark, io.shared_dir(spark, "cells"), lambda: school_cells(spark, sf))
    older, newer = cells.filter("SURVEY_YEAR <= 1999"), cells.filter("SURVEY_YEAR >= 2000")
    tables = [waves.table_2011(raw_2011(older, d, m), m, d, declared=True).drop("SCHID") for m in SUSPENSIONS for d in (False, True)]
    modern = waves.table_modern(raw_modern(newer, 2013, "OSS"), "OSS", 2013, declared=True).drop("SCHID")
    return panels.school_panel({2011: tables, 2013: [modern]})


def school_panel(spark, sf):
    """Schools of two layouts: one year's two tables merged 1:1, the other year's table below."""
    cells = io.materialize(spark, io.shared_dir(spark, "cells"), lambda: school_cells(spark, sf))
    older, newer = cells.filter("SURVEY_YEAR <= 1999"), cells.filter("SURVEY_YEAR >= 2000")
    nodis = waves.table_2011(raw_2011(older, False), "CORP", False, declared=True)
    dis = waves.table_2011(raw_2011(older, True), "CORP", True, declared=True)
    modern = waves.table_modern(raw_modern(newer), "CP", 2013, declared=True)
    return panels.school_panel({2011: [nodis, dis], 2013: [modern]}).drop("SCHID")


def school_panel_by_wave(spark, sf):
    """The same panel built a wave at a time: a wave that came too early is replaced, the other year's files stay."""
    cells = io.materialize(spark, io.shared_dir(spark, "cells"), lambda: school_cells(spark, sf))
    older, newer = cells.filter("SURVEY_YEAR <= 1999"), cells.filter("SURVEY_YEAR >= 2000")
    nodis = waves.table_2011(raw_2011(older, False), "CORP", False, declared=True)
    dis = waves.table_2011(raw_2011(older, True), "CORP", True, declared=True)
    modern = waves.table_modern(raw_modern(newer), "CP", 2013, declared=True)
    path = io.shared_dir(spark, "panel")
    panels.add_wave(spark, path, 2013, [modern.filter("CORPIND = 1")], V.SCHOOL_KEY)
    panels.add_wave(spark, path, 2011, [nodis, dis], V.SCHOOL_KEY)
    return panels.add_wave(spark, path, 2013, [modern], V.SCHOOL_KEY).drop("SCHID")


def bucketed_merge(spark, sf):
    """District-year sums of two measures kept in buckets by their key and merged without moving a row."""
    path = io.shared_dir(spark, "buckets")
    leas = io.materialize(spark, f"{path}/leas", lambda: B.lea_years(spark, sf).withColumn("LEAID", B.district_id()))
    name = f"panel_{uuid.uuid4().hex}"
    enr = leas.filter("ENR_sumrace % 7 > 0").select(*V.DISTRICT_KEY, "ENR_BL", "ENR_WH")
    corp = leas.filter("CORP_sumrace > 0").select(*V.DISTRICT_KEY, "CORP_BL", "CORP_WH", F.lit(-1).cast("bigint").alias("ENR_WH"))
    kept = [io.write_bucketed(t, f"{name}_{i}", V.DISTRICT_KEY, 16, f"{path}/{i}") for i, t in enumerate((enr, corp))]
    return merge_buckets(*kept, V.DISTRICT_KEY, "_merge")


def long_fact_rollup(spark, sf):
    """District sums as a long fact by parsed attributes; unpivoted after the roll-up, not before."""
    school = waves.table_2011(raw_2011(school_cells(spark, sf), False), "CORP", False, declared=True)
    return waves.lea_fact(school)


def crosswalk_rename(spark, sf):
    """Lower-case names of the extract to upper case, then to the vocabulary, ids in front."""
    raw = K.upper_names(raw_modern(school_cells(spark, sf)))
    named = K.rename(raw, V.modern_crosswalk("CP", 2013))
    return K.order(K.keep(named, "COMBOKEY", "LEAID", "CORP_M_*_IDEA"), "LEAID", "COMBOKEY")


def wave_dictionary(spark, sf):
    """Attributes of every column of the wave, with the number of schools that report it."""
    school = waves.table_2011(raw_2011(school_cells(spark, sf), True), "CORP", True, declared=True)
    cells = waves.measures_of(school)
    reported = school.agg(*[F.count(c).alias(c) for c in cells]).unpivot([], cells, "name_merge", "schools")
    dictionary = X.wave_dictionary(spark, V.table_crosswalk("CORP", True))
    return dictionary.join(reported, "name_merge", "left")


def dictionary_2009(spark, sf):
    """What the columns of a 2009 table say, both standards, with the number of schools that fill each; the remark column stays unread."""
    raw = raw_2009(school_cells(spark, sf), "CORP", True).withColumn("JJ", F.lit("x"))
    dictionary = X.column_dictionary(raw)
    cells = [c for c in raw.columns if c not in V.ID_COLUMNS]
    filled = raw.agg(*[F.count_if(F.col(c) != "-").alias(c) for c in cells]).unpivot([], cells, "name", "schools")
    return dictionary.join(filled, "name", "left")


def availability_all_waves(spark, sf):
    """Which column carries each variable of corporal punishment in each wave, read from the extracts' own names; 2009 has both standards."""
    cells = school_cells(spark, sf)
    extracts = {"wave_2009": raw_2009(cells, "CORP", True), "wave_2011": raw_2011(cells, True)}
    extracts |= {f"wave_{y}": K.upper_names(raw_modern(cells, y)) for y in V.MODERN_YEARS}
    told = {w: X.column_dictionary(df).dropna(subset=["name_merge"]) for w, df in extracts.items()}
    table = X.availability(told, ("name_merge", "DSO", "instances", "races_reported"))
    districts = cells.agg(F.count_if(F.col("M_IDEA").isNotNull()).alias("reporting"))
    return table.crossJoin(F.broadcast(districts))


def variable_availability(spark, sf):
    """Which variable each wave carries, counted over the schools of both."""
    wave = {
        "wave_2011": V.table_crosswalk("CORP", True),
        "wave_2013": V.modern_crosswalk("CP", 2013),
    }
    table = X.availability({w: X.wave_dictionary(spark, cw) for w, cw in wave.items()})
    school = waves.table_modern(raw_modern(school_cells(spark, sf)), "CP", 2013, declared=True)
    cells = waves.measures_of(school)
    reported = school.agg(*[F.count(c).alias(c) for c in cells]).unpivot([], cells, "name_merge", "schools")
    return table.join(reported, "name_merge", "left").select("name_merge", "wave_2011", "wave_2013", "schools")


# ---- SQL -----------------------------------------------------------------------------------


def _cells_sql(where: str = "TRUE") -> str:
    sums = []
    for name in CELLS + TOTALS:
        parts = name.split("_")
        test = f"sex = '{parts[0]}' AND status = '{parts[-1]}'" + (f" AND race = '{parts[1]}'" if len(parts) == 3 else "")
        sums.append(f'CAST(sum(CASE WHEN {test} THEN qty END) AS BIGINT) AS "{name}"')
    return f"""cells AS (SELECT s.*, o_orderkey, o_custkey, o_orderstatus, year(o_orderdate) AS survey_year,
    lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS leaid, printf('%07d%05d', o_custkey, o_orderkey) AS combokey
  FROM (SELECT l_orderkey, {", ".join(sums)} FROM (SELECT l_orderkey, CASE l_linestatus WHEN 'O' THEN 'M' ELSE 'F' END AS sex,
      {B.RACE_SQL} AS race, CASE l_returnflag WHEN 'N' THEN 'NODIS' WHEN 'R' THEN 'IDEA' ELSE 'LEP' END AS status,
      CAST(l_quantity AS BIGINT) AS qty FROM lineitem) GROUP BY l_orderkey) s
  JOIN orders ON s.l_orderkey = o_orderkey WHERE {where})"""


def _text_sql(cell: str, filler: str) -> str:
    return f"""CASE WHEN "{cell}" IS NULL THEN '{filler}' WHEN "{cell}" % 11 = 0 THEN '-9' ELSE CAST("{cell}" AS VARCHAR) END"""


def _number_sql(text: str, ignore: str) -> str:
    cleaned = f"replace({text}, '{ignore}', '')" if ignore else text
    return f"TRY_CAST(nullif({cleaned}, '') AS BIGINT)"


def _clean_sql(cell: str, filler: str, ignore: str) -> str:
    number = _number_sql(_text_sql(cell, filler), ignore)
    return f"(CASE WHEN {number} >= 0 THEN {number} END)"


def _sum0(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


def _choices(disabled: bool):
    return [(c.target, c.cell) for c in E.older("CORP", disabled)]


def _modern(year: int = 2013):
    return [(c.target, c.cell) for c in E.recent(year)]


def _lea_2011_sql(disabled: bool) -> str:
    sums = ", ".join(f'{_sum0(_clean_sql(cell, "‡", "‡"))} AS "{target}"' for target, cell in _choices(disabled))
    return f"""WITH {_cells_sql()} SELECT leaid AS "LEAID", {sums}, 2011 AS "YEAR", 7 AS "RACES_REPORTED" FROM cells GROUP BY leaid"""


def _standard_sql(measure: str = "CORP", disabled: bool = False, scrubbed: bool = True, key: str = 'combokey AS "COMBOKEY"', where: str = "TRUE") -> str:
    choices = E.older(measure, disabled)

    def picked(choice: E.Name) -> str:
        value = _clean_sql(choice.cell, "-", "-") if scrubbed else _number_sql(_text_sql(choice.cell, "-"), "-")
        if choice.five:
            return f'CASE WHEN five AND standard = 5 OR NOT five AND standard = 7 THEN {value} END AS "{choice.target}"'
        return f'CASE WHEN NOT five THEN {value} END AS "{choice.target}"'

    sums = " + ".join(
        f"(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE coalesce({_number_sql(_text_sql(c.cell, '-'), '-')}, 0) END)" for c in choices
    )
    return f"""WITH {_cells_sql(where)} SELECT {key}, 2009 AS "YEAR", standard AS "RACES_REPORTED", {", ".join(picked(c) for c in choices)}
    FROM (SELECT *, o_orderstatus = 'F' AS five, CASE WHEN {sums} <> 0 THEN 7 ELSE 5 END AS standard FROM cells)"""


def _modern_sql() -> str:
    sums = ", ".join(f'{_sum0(_clean_sql(cell, "", ""))} AS "{target}"' for target, cell in _modern())
    return f"""WITH {_cells_sql()} SELECT leaid AS "LEAID", {sums}, 2013 AS "YEAR", 7 AS "RACES_REPORTED",
    max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END) AS "CORPIND" FROM cells GROUP BY leaid"""


def _preschool_sql() -> str:
    columns = ", ".join(f'{_clean_sql(cell, "", "")} AS "{target}"' for target, cell in _recent_names("CP", 2015))
    return f"""WITH {_cells_sql()} SELECT combokey AS "COMBOKEY", CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS "CORPIND",
    2015 AS "YEAR", 7 AS "RACES_REPORTED", {columns} FROM cells"""


def _recent_names(topic: str, year: int, as_published: bool = True) -> list[tuple[str, str]]:
    """(target name, cell) of every measure column of a wave."""
    return [(c.target, c.cell) for c in recent(topic, year, as_published)]


def _recent_sql(topic: str, year: int, as_published: bool = True) -> str:
    sums = ", ".join(f'{_sum0(_clean_sql(cell, "", ""))} AS "{target}"' for target, cell in _recent_names(topic, year, as_published))
    flag = ', max(CASE o_orderstatus WHEN \'F\' THEN 1 WHEN \'O\' THEN 0 END) AS "CORPIND"' if topic == "CP" else ""
    return f"""WITH {_cells_sql()} SELECT leaid AS "LEAID", {sums}, {year} AS "YEAR", 7 AS "RACES_REPORTED"{flag} FROM cells GROUP BY leaid"""


def _lea_2009_sql(scrubbed: bool, measure: str = "CORP", disabled: bool = False) -> str:
    return _standard_sql(measure, disabled, scrubbed, 'CAST(o_orderkey AS VARCHAR) AS "LEAID"')


def _wide_panel_sql() -> str:
    older = {t: c for disabled in (False, True) for t, c in _choices(disabled)}
    newer = dict(_modern())
    names = list({**older, **newer})
    races = ("AI", "AS", "BL", "HI", "HP", "MR", "WH")
    historic = ("AI", "AS", "BL", "HI", "WH")
    null = "CAST(NULL AS BIGINT)"

    def part(cells: dict[str, str], filler: str, where: str, year: int, flag: str) -> str:
        sums = ", ".join(f'{_sum0(_clean_sql(cells[n], filler, filler))} AS "{n}"' if n in cells else f'{null} AS "{n}"' for n in names)
        totals = ", ".join(f'"CORP_M_{r}_NODIS" + "CORP_F_{r}_NODIS" + "CORP_M_{r}_IDEA" + "CORP_F_{r}_IDEA" AS "CORP_{r}"' for r in races)
        return f"""SELECT *, {totals}, {null} AS "CORP_DIS" FROM (SELECT leaid AS "LEAID", {year} AS "YEAR", 7 AS "RACES_REPORTED", {flag} AS "CORPIND",
            {sums} FROM cells WHERE {where} GROUP BY leaid)"""

    early = ", ".join(f'nullif({B.group_sum("corp", r)}, 0) AS "CORP_{r}"' if r in historic else f'{null} AS "CORP_{r}"' for r in races)
    none = ", ".join(f'{null} AS "{n}"' for n in names)
    total = " + ".join(f'coalesce("CORP_{r}", 0)' for r in races)
    some = ", ".join(f'"CORP_{r}"' for r in races)
    return f"""WITH {B.FACT}, {_cells_sql()}, parts AS (
    SELECT lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS "LEAID", "YEAR", CAST(NULL AS INTEGER) AS "RACES_REPORTED", CAST(NULL AS INTEGER) AS "CORPIND",
      {none}, {early}, {B.group_sum("corp", "HP")} AS "CORP_DIS" FROM fact WHERE "YEAR" <= 1997 GROUP BY o_custkey, "YEAR"
    UNION ALL BY NAME {part(older, "‡", "survey_year BETWEEN 1998 AND 1999", 2011, "CAST(NULL AS INTEGER)")}
    UNION ALL BY NAME {part(newer, "", "survey_year >= 2000", 2013, "max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END)")})
    SELECT *, CASE WHEN coalesce({some}) IS NOT NULL THEN {total} END AS "CORP_sumrace" FROM parts"""


RACE_TOTALS_SQL = f"""WITH {B.FACT}, leas AS (SELECT o_custkey, "YEAR", {B.WIDE_SUMS} FROM fact GROUP BY 1, 2),
totals AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS "LEAID", "YEAR",
  CASE WHEN "YEAR" < 1998 THEN ENR_BL WHEN CORP_BL > 0 OR CORP_WH > 0 THEN CORP_BL + CORP_WH END AS "CORP_BL", nullif(CORP_AS, 0) AS "CORP_AS",
  CAST(NULL AS BIGINT) AS "CORP_HP" FROM leas)
SELECT *, CASE WHEN coalesce("CORP_BL", "CORP_AS") IS NOT NULL THEN coalesce("CORP_BL", 0) + coalesce("CORP_AS", 0) END AS "CORP_sumrace" FROM totals"""
DECIMAL_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS BIGINT) END AS "count" FROM lineitem"""


def _historic_sql() -> str:
    races = ", ".join(f'nullif({B.group_sum("corp", r)}, 0) AS "CORP_{r}"' for r in V.HISTORIC_RACES)
    hp, mr = f'CASE WHEN "YEAR" < 1998 THEN {B.group_sum("corp", "HP")} END', f'CASE WHEN "YEAR" % 2 = 0 THEN {B.group_sum("corp", "MR")} END'
    return f"""WITH {B.FACT} SELECT lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS "LEAID", "YEAR", {races},
    CASE WHEN coalesce({hp}, {mr}) IS NOT NULL THEN coalesce({hp}, 0) + coalesce({mr}, 0) END AS "CORP_DIS" FROM fact GROUP BY o_custkey, "YEAR\""""


def _totals_sql(prefix: str, middle: tuple[str, ...], times: int) -> str:
    names = [f"{prefix}_{r}" for r in V.RACES]
    early = ", ".join(
        f'nullif({B.group_sum("corp", r)}, 0) AS "{prefix}_{r}"' if r in V.HISTORIC_RACES else f'CAST(NULL AS BIGINT) AS "{prefix}_{r}"'
        for r in V.RACES
    )

    def later(filler: str, ignore: str, statuses: tuple[str, ...], times: int = 1) -> str:
        out = []
        for r in V.RACES:
            cells = [f"{g}_{r}_{s}" for g in V.GENDERS for s in statuses]
            total = " + ".join(f"coalesce({_clean_sql(c, filler, ignore)}, 0)" for c in cells)
            out.append(f'{times} * {_sum0(total)} AS "{prefix}_{r}"')
        return ", ".join(out)

    both = " + ".join(f'coalesce("{n}", 0)' for n in names)
    any_ = ", ".join(f'"{n}"' for n in names)
    return f"""WITH {B.FACT}, {_cells_sql()}, totals AS (
    SELECT "YEAR", lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS "LEAID", {early} FROM fact WHERE "YEAR" <= 1997 GROUP BY o_custkey, "YEAR"
    UNION ALL SELECT 2011, leaid, {later("‡", "‡", middle)} FROM cells WHERE survey_year BETWEEN 1998 AND 1999 GROUP BY leaid
    UNION ALL SELECT 2013, leaid, {later("", "", ("NODIS", "IDEA"), times)} FROM cells WHERE survey_year >= 2000 GROUP BY leaid)
    SELECT *, CASE WHEN coalesce({any_}) IS NOT NULL THEN {both} END AS "{prefix}_sumrace" FROM totals"""


def _all_waves_sql(topic: str) -> str:
    prefix = "CORP" if topic == "CP" else "OSS"
    races = ("AI", "AS", "HI", "BL", "WH", "HP", "MR")
    measures = ["CORP"] if topic == "CP" else ["SINGOSS", "MULTOSS"]
    historic = ("AI", "AS", "HI", "BL", "WH")
    early = ", ".join(f'{f"nullif({B.group_sum('corp', r)}, 0)" if r in historic else "CAST(NULL AS BIGINT)"} AS "{prefix}_{r}"' for r in races)
    parts = [f"""SELECT "YEAR", lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS "LEAID", {early} FROM fact WHERE "YEAR" <= 1995 GROUP BY o_custkey, "YEAR\""""]

    def sums(value) -> str:
        return ", ".join(_sum0(" + ".join(f"coalesce({value(s, r, g)}, 0)" for s in "MF" for g in ("NODIS", "IDEA"))) for r in races)

    for survey, year in LAYOUTS[1:]:
        filler = "‡" if year == 2011 else ""
        times = len(measures)
        each = sums(lambda s, r, g, filler=filler: f"{times} * {_clean_sql(f'{s}_{r}_{g}', filler, filler)}")
        parts.append(f"SELECT {year}, leaid, {each} FROM cells WHERE survey_year = {survey} GROUP BY leaid")

    # 2009: each table has a standard of its own, five categories unless a cell of seven was counted
    tables = {}
    for disabled, group in ((False, "NODIS"), (True, "IDEA")):
        total = " + ".join(f"coalesce({_number_sql(_text_sql(c.cell, '-'), '-')}, 0)" for c in E.older("CORP", disabled))
        tables[group] = f"(o_orderstatus = 'F' OR {total} <> 0)"

    def cell(s: str, r: str, g: str) -> str:
        value = _clean_sql(f"{s}_{r}_{g}", "-", "-") if topic == "CP" else _number_sql(_text_sql(f"{s}_{r}_{g}", "-"), "-")
        shown = "o_orderstatus <> 'F'" if r in ("HP", "MR") else tables[g]
        return f"(CASE WHEN {shown} THEN {len(measures)} * {value} END)"

    if topic == "CP":
        parts.append(f"SELECT 2009, leaid, {sums(cell)} FROM cells WHERE survey_year = 1996 GROUP BY leaid")
    else:
        some = []
        for r in races:
            own = [cell(s, r, g) for s in "MF" for g in ("NODIS", "IDEA")]
            some.append(f"CASE WHEN coalesce({', '.join(own)}) IS NOT NULL THEN {' + '.join(f'coalesce({c}, 0)' for c in own)} END")
        parts.append(f"SELECT 2009, CAST(o_orderkey AS VARCHAR), {', '.join(some)} FROM cells WHERE survey_year = 1996")
    names = [f'"{prefix}_{r}"' for r in races]
    union = " UNION ALL ".join(parts)
    return f"""WITH {B.FACT}, {_cells_sql()}, totals AS ({union})
    SELECT *, CASE WHEN coalesce({", ".join(names)}) IS NOT NULL THEN {" + ".join(f"coalesce({n}, 0)" for n in names)} END AS "{prefix}_sumrace" FROM totals"""


def _school_sql(topic: str = "CP") -> str:
    # the older layout's names, written out: races by sex, the totals, and what only one of its tables has
    measures = ["CORP"] if topic == "CP" else SUSPENSIONS
    older = {c.target: c.cell for m in measures for disabled in (False, True) for c in E.older(m, disabled)}
    newer = dict(_recent_names(topic, 2013))
    names = list({**older, **newer})

    def part(cells: dict[str, str], filler: str) -> str:
        return ", ".join(f'{_clean_sql(cells[n], filler, filler)} AS "{n}"' if n in cells else f'CAST(NULL AS BIGINT) AS "{n}"' for n in names)

    return f"""WITH {_cells_sql()}
    SELECT combokey AS "COMBOKEY", 2011 AS "YEAR", 7 AS "RACES_REPORTED", leaid AS "LEAID", CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS "INCOMPLETE",
      {'CAST(NULL AS INTEGER) AS "CORPIND",' if topic == "CP" else ""} {part(older, "‡")} FROM cells WHERE survey_year <= 1999
    UNION ALL SELECT combokey, 2013, 7, leaid, NULL, {"CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END," if topic == "CP" else ""}
      {part(newer, "")} FROM cells WHERE survey_year >= 2000"""


def _literal(value) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def _fact_sql() -> str:
    rows = []
    for target, cell in _choices(False):
        measure, sex, race, status = E.attributes(target)
        rows.append(
            f"""SELECT leaid AS "LEAID", 2011 AS "YEAR", '{measure}' AS measure, {_literal(sex)} AS gender, {_literal(race)} AS race,
            {_literal(status)} AS status, {_sum0(_clean_sql(cell, "‡", "‡"))} AS value FROM cells GROUP BY leaid"""
        )
    return f"WITH {_cells_sql()}\n" + "\nUNION ALL ".join(rows)


def _rename_sql() -> str:
    wanted = [(t, c) for t, c in _modern() if t.startswith("CORP_M_") and t.endswith("_IDEA") and t != "CORP_M_IDEA"]
    columns = ", ".join(f'{_text_sql(c, "")} AS "{t}"' for t, c in wanted)
    return f"""WITH {_cells_sql()} SELECT leaid AS "LEAID", combokey AS "COMBOKEY", {columns} FROM cells"""


def _dictionary_sql() -> str:
    rows = []
    for c in E.older("CORP", True):
        measure, sex, race, status = E.attributes(c.target)
        dis = int(status in ("DIS", "IDEA", "504", "DIS_LEP"))
        lep = int("LEP" in status)
        rows.append(
            f"""SELECT '{c.source}' AS name, '{c.target}' AS name_merge, {_literal(sex)} AS gender, {_literal(race)} AS race,
            '{measure}' AS measure, {_literal(status)} AS status, {dis} AS "DIS", {lep} AS "LEP", 0 AS "PS", {int(status == "504")} AS "DSO", 0 AS instances, 0 AS suspension,
            7 AS races_reported, count({_clean_sql(c.cell, "‡", "‡")}) AS schools FROM cells"""
        )
    return f"WITH {_cells_sql()}\n" + "\nUNION ALL ".join(rows)


def _availability_sql() -> str:
    older = {c.target: c.source for c in E.older("CORP", True)}
    newer = {c.target: c.source for c in E.recent(2013)}
    cells = dict(_modern())
    rows = [
        f"""SELECT '{t}' AS name_merge, {_literal(older.get(t))} AS wave_2011, {_literal(newer.get(t))} AS wave_2013,
        {f'count({_clean_sql(cells[t], "", "")})' if t in cells else 'CAST(NULL AS BIGINT)'} AS schools FROM cells"""
        for t in {**older, **newer}
    ]
    return f"WITH {_cells_sql()}\n" + "\nUNION ALL ".join(rows)


def _dictionary_2009_sql() -> str:
    rows = ["""SELECT 'JJ' AS name, NULL AS name_merge, NULL AS measure, NULL AS gender, NULL AS race, NULL AS status, CAST(NULL AS INTEGER) AS "DIS", CAST(NULL AS INTEGER) AS "LEP",
        CAST(NULL AS INTEGER) AS "PS", CAST(NULL AS INTEGER) AS "DSO", CAST(NULL AS INTEGER) AS instances, CAST(NULL AS INTEGER) AS suspension, CAST(NULL AS INTEGER) AS races_reported,
        count(*) AS schools FROM cells"""]
    for c in E.older("CORP", True):
        measure, sex, race, status = E.attributes(c.target)
        for name, standard, test in ((c.five, 5, "o_orderstatus = 'F'"), (c.source, 7, "o_orderstatus <> 'F'")):
            if name:
                rows.append(
                    f"""SELECT '{name}', '{c.target}', '{measure}', {_literal(sex)}, {_literal(race)}, {_literal(status)}, {int(status in ("IDEA", "504", "DIS_LEP"))},
                    {int("LEP" in status)}, 0, {int(status == "504")}, 0, 0, {standard}, count(*) FILTER ({test} AND "{c.cell}" IS NOT NULL) FROM cells"""
                )
    return f"WITH {_cells_sql()}\n" + "\nUNION ALL ".join(rows)


def _availability_all_sql() -> str:
    found: dict[tuple[str, int], dict[str, str]] = {}
    for c in E.older("CORP", True):
        if c.five:
            found.setdefault((c.target, 5), {})["wave_2009"] = c.five
        found.setdefault((c.target, 7), {}).update(wave_2009=c.source, wave_2011=c.source)
    for year in (2013, 2015, 2017, 2020):
        for c in E.recent(year):
            found.setdefault((c.target, 7), {})[f"wave_{year}"] = c.source
    waves_of = [f"wave_{y}" for y in (2009, 2011, 2013, 2015, 2017, 2020)]
    rows = [
        f"""SELECT '{target}' AS name_merge, {int(target.endswith("_504"))} AS "DSO", {int(target.startswith("CORPINST"))} AS instances, {standard} AS races_reported,
        {", ".join(f"{_literal(names.get(w))} AS {w}" for w in waves_of)}, count("M_IDEA") AS reporting FROM cells"""
        for (target, standard), names in found.items()
    ]
    return f"WITH {_cells_sql()}\n" + "\nUNION ALL ".join(rows)


QUERIES = {
    "wave_ingest_to_lea": (wave_ingest_to_lea, _lea_2011_sql(False)),
    "workbook_wave_to_lea": (workbook_wave_to_lea, _lea_2011_sql(False)),
    "workbook_export": (
        workbook_export,
        f"""{B.STATE} SELECT CAST("YEAR" AS BIGINT) AS "YEAR", STATE_CODE, race, nullif(CORP_, 0) AS CORP_, ENR_ FROM state_long""",
    ),
    "wave_ingest_data_decided": (wave_ingest_data_decided, _lea_2011_sql(True)),
    "standard_detect_select": (standard_detect_select, _standard_sql()),
    "modern_wave_to_lea": (modern_wave_to_lea, _modern_sql()),
    "preschool_wave_to_lea": (preschool_wave_to_lea, _preschool_sql()),
    "historic_lea_ingest": (historic_lea_ingest, _historic_sql()),
    "lea_panel_totals": (lea_panel_totals, _totals_sql("CORP", ("NODIS", "IDEA"), 1)),
    "oss_panel_totals": (oss_panel_totals, _totals_sql("OSS", ("NODIS", "IDEA"), 2)),
    "school_panel": (school_panel, _school_sql()),
    "school_panel_by_wave": (school_panel_by_wave, _school_sql()),
    "bucketed_merge": (
        bucketed_merge,
        f"""WITH {B.FACT}, leas AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS "LEAID", "YEAR", {B.WIDE_SUMS} FROM fact GROUP BY o_custkey, "YEAR")
        SELECT "LEAID", "YEAR", CASE WHEN ENR_sumrace % 7 > 0 THEN ENR_BL END AS "ENR_BL", CASE WHEN ENR_sumrace % 7 > 0 THEN ENR_WH ELSE -1 END AS "ENR_WH",
        CASE WHEN CORP_sumrace > 0 THEN CORP_BL END AS "CORP_BL", CASE WHEN CORP_sumrace > 0 THEN CORP_WH END AS "CORP_WH",
        CASE WHEN ENR_sumrace % 7 > 0 AND CORP_sumrace > 0 THEN 3 WHEN ENR_sumrace % 7 > 0 THEN 1 ELSE 2 END AS _merge
        FROM leas WHERE ENR_sumrace % 7 > 0 OR CORP_sumrace > 0""",
    ),
    "long_fact_rollup": (long_fact_rollup, _fact_sql()),
    "crosswalk_rename": (crosswalk_rename, _rename_sql()),
    "wave_dictionary": (wave_dictionary, _dictionary_sql()),
    "dictionary_2009": (dictionary_2009, _dictionary_2009_sql()),
    "availability_all_waves": (availability_all_waves, _availability_all_sql()),
    "variable_availability": (variable_availability, _availability_sql()),
    "modern_2015_to_lea": (recent_wave_to_lea("CP", 2015), _recent_sql("CP", 2015)),
    "modern_2017_to_lea": (recent_wave_to_lea("CP", 2017), _recent_sql("CP", 2017)),
    "modern_2020_to_lea": (recent_wave_to_lea("CP", 2020), _recent_sql("CP", 2020)),
    "oss_2015_to_lea": (recent_wave_to_lea("OSS", 2015), _recent_sql("OSS", 2015)),
    "oss_2017_to_lea": (recent_wave_to_lea("OSS", 2017), _recent_sql("OSS", 2017)),
    "oss_2020_to_lea": (recent_wave_to_lea("OSS", 2020), _recent_sql("OSS", 2020)),
    "oss_2020_corrected": (recent_wave_to_lea("OSS", 2020, as_published=False), _recent_sql("OSS", 2020, as_published=False)),
    "lea_2009_scrubbed": (lea_2009(True), _lea_2009_sql(True)),
    "lea_2009_unscrubbed": (lea_2009(False), _lea_2009_sql(False)),
    **{
        f"lea_2009_{m.lower()}_{'dis' if d else 'nodis'}": (lea_2009(m == "CORP", m, d), _lea_2009_sql(m == "CORP", m, d))
        for m in ["CORP", *SUSPENSIONS] for d in (False, True) if (m, d) != ("CORP", False)
    },
    "cp_panel_all_waves": (panel_all_waves("CP"), _all_waves_sql("CP")),
    "oss_panel_all_waves": (panel_all_waves("OSS"), _all_waves_sql("OSS")),
    "oss_school_panel": (oss_school_panel, _school_sql("OSS")),
    "lea_panel_wide": (lea_panel_wide, _wide_panel_sql()),
    "race_totals": (race_totals, RACE_TOTALS_SQL),
    "destring_decimal_text": (destring_decimal_text, DECIMAL_SQL),
}
