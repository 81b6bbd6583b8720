"""One raw wave extract to a harmonised school or district table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as C
from ..functions import vocabulary as V
from ..functions.nulls import rowtotal, rowtotal_missing
from ..operators import columns as K
from ..operators.crosswalk import destring, detect_standard, fact_cells, scrub, select_by_standard
from ..operators.merge import merge_one
from ..operators.rollup import collapse

INDICATOR = "SCH_CORPINSTANCES_IND"


def _ids(df: DataFrame) -> list[str]:
    return [c for c in V.ID_COLUMNS if c in df.columns]


def _longs(df: DataFrame, names: dict[str, str]) -> list[str]:
    """Measure columns that are whole numbers, which ``destring`` has scrubbed."""
    return [c for c in names.values() if isinstance(df.schema[c].dataType, T.LongType)]


def table_2009(
    raw: DataFrame, measure: str, disabled: bool, level: str = "school",
    mode: str = "faithful", declared: bool = False, scrubbed: bool = True,
) -> DataFrame:
    """2009 table: filler ``-``, five- or seven-category standard per row.

    ``level="lea"`` is the restricted district file, which brings its own YEAR.  Its suspension
    tables are not scrubbed of reserve codes in the published panel (``scrubbed=False``).
    """
    df = K.upper_names(raw)
    choices = V.table_choices(measure, disabled)
    cells = [c for pair in choices for c in (pair.five, pair.seven) if c]
    others = [c for c in cells if c not in df.columns]
    if others:
        raise ValueError(f"columns not found: {others}")
    extra = [c for c in K.expand(df, "*_5_*", "*_7_*") if c not in cells]
    df = destring(df, cells, ignore="-", mode=mode, declared=declared)
    df = destring(df, extra, ignore="-", mode=mode)
    if level == "school":
        df = K.constants(df, YEAR=2009)
    else:
        df = df.withColumn("YEAR", C.text_to_long("YEAR").cast("int"))
    df = detect_standard(df)
    ids = _ids(df) if level == "school" else [c for c in ("LEAID", "LEA_STATE") if c in df.columns]
    df = select_by_standard(df, choices, [*ids, "YEAR", "RACES_REPORTED"])
    return scrub(df) if scrubbed else df


def table_2011(
    raw: DataFrame, measure: str, disabled: bool, mode: str = "faithful", declared: bool = False
) -> DataFrame:
    """2011 table: filler ``‡``, seven categories everywhere, a remark column for incomplete schools."""
    df = raw.withColumnRenamed("Incomplete", "INCOMPLETE") if "Incomplete" in raw.columns else raw
    names = V.table_crosswalk(measure, disabled)
    df = destring(df, list(names), ignore="‡", mode=mode, declared=declared, scrubbed=True)
    df = K.rename(K.constants(df, YEAR=2011, RACES_REPORTED=7), names)
    df = df.select(
        *_ids(df), "YEAR", "RACES_REPORTED", *names.values(),
        *([C.incomplete_flag("INCOMPLETE").alias("INCOMPLETE")] if "INCOMPLETE" in df.columns else []),
    )
    return scrub(df, exclude=_longs(df, names))


def table_modern(
    raw: DataFrame, topic: str, year: int, declared: bool = False, as_published: bool = True
) -> DataFrame:
    """2013-2020 extract: one wide table per topic; 2015 ids are rebuilt from the school number."""
    df = K.upper_names(raw)
    names = V.modern_crosswalk(topic, year, as_published)
    flagged = topic == "CP" and INDICATOR in df.columns
    df = df.select(*_ids(df), *([INDICATOR] if flagged else []), *_required(df, names))
    df = destring(df, list(names), declared=declared, scrubbed=True)
    df = K.rename(K.constants(df, YEAR=year, RACES_REPORTED=7), names)
    if year == 2015:
        df = K.replace_by(df, SCHID=C.zero_pad("SCHID"), COMBOKEY=C.school_key(F.col("LEAID"), F.col("SCHID")))
    if flagged:
        df = df.withColumn("CORPIND", C.flag_code(INDICATOR)).drop(INDICATOR)
    return scrub(df, exclude=_longs(df, names))


def _required(df: DataFrame, names: dict[str, str]) -> list[str]:
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")
    return list(names)


def historic_lea(raw: DataFrame, topic: str) -> DataFrame:
    """District extract of 1973-2006: reported race counts, text to numbers."""
    names = V.historic_crosswalk(topic)
    df = K.rename(raw, names).select("LEAID", "YEAR", *names.values())
    return destring(df, ["YEAR", *names.values()]).withColumn("YEAR", F.col("YEAR").cast("int"))


def historic_disabled(raw: DataFrame) -> DataFrame:
    """Counts for students with disabilities of 1980-82 and 1994-97, asked under two names."""
    df = destring(raw.select("LEAID", "YEAR", "XUSE_68", "CORP_DS"), ["YEAR", "XUSE_68", "CORP_DS"])
    total = rowtotal_missing(["XUSE_68", "CORP_DS"]).alias("CORP_DIS")
    return df.select("LEAID", F.col("YEAR").cast("int").alias("YEAR"), total)


def measures_of(df: DataFrame) -> list[str]:
    """Measure columns of a harmonised table."""
    fixed = {*V.ID_COLUMNS, "YEAR", "RACES_REPORTED", "CORPIND", "INCOMPLETE"}
    return [c for c in df.columns if c not in fixed]


def to_lea(school: DataFrame) -> DataFrame:
    """District table of a school table: sums with suppressed cells as 0, maxima of the codes."""
    maxima = [c for c in ("YEAR", "RACES_REPORTED", "CORPIND") if c in school.columns]
    return collapse(school, ["LEAID"], measures_of(school), maxima, dealt=True)


def lea_fact(school: DataFrame) -> DataFrame:
    """District sums of a school table as long rows (LEAID, YEAR, measure, gender, race, status, value).

    The roll-up comes first: unpivoting schools would send one row per school and cell into the
    shuffle instead of one per school.
    """
    lea = to_lea(school)
    return fact_cells(lea, V.DISTRICT_KEY, measures_of(lea))


def race_partials(table: DataFrame, topic: str, suppressed_as_zero: bool) -> DataFrame:
    """Per row, the part of each race total this table holds.

    School rows count a suppressed cell as 0; restricted district rows stay null when every cell
    is.  A table without the cells of a total (in-school suspensions, say) gives null.
    """
    total = rowtotal if suppressed_as_zero else rowtotal_missing
    present, out = set(table.columns), []
    for race in V.RACES:
        cells = [c for c in V.total_cells(topic, race) if c in present]
        value = total(cells) if cells else F.lit(None)
        out.append(value.cast("bigint").alias(f"summed_{race}"))
    return table.select("LEAID", "YEAR", *out)


def reported_partials(table: DataFrame, topic: str) -> DataFrame:
    """Race totals that a historic district extract reports itself."""
    prefix, present = V.outcome(topic), set(table.columns)
    reported = [r for r in V.RACES if f"{prefix}_{r}" in present]
    return table.selectExpr("LEAID", "YEAR", *[f"CAST({prefix}_{r} AS BIGINT) AS reported_{r}" for r in reported])


def ingest_lea(tables: Sequence[DataFrame]) -> DataFrame:
    """District tables of one wave, merged 1:1 on district and year."""
    leas = [to_lea(t) for t in tables]
    return leas[0] if len(leas) == 1 else merge_one(leas, V.DISTRICT_KEY)
