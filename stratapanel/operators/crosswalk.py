"""From a raw wave layout to the target vocabulary: text cells to numbers, then names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as C
from ..functions import source_names as SN
from ..functions import vocabulary as V
from ..functions.nulls import quote, rowtotal
from . import cells
from . import columns as K
from .guards import guard


def convertible(df: DataFrame, columns: Sequence[str], ignore: str = "", mode: str = "faithful") -> dict[str, str]:
    """Type each text column can take: ``bigint``, ``double`` or ``string``.

    One aggregate over the data, whatever the number of columns: per column the worst cell, 0 for
    a whole number, 1 for another number, 2 for text.
    """
    if not columns:
        return {}
    graded = cells.gather(df, columns).select(cells.grades(ignore=ignore, mode=mode).alias(cells.CELLS))
    worst = graded.agg(*[F.max(c).alias(f"_{i}") for i, c in enumerate(cells.unpacked(columns).values())]).first()
    return {c: ("bigint", "double", "string")[worst[i] or 0] for i, c in enumerate(columns)}


def destring(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    ignore: str = "",
    mode: str = "faithful",
    keys: Iterable[str] = V.ID_COLUMNS,
    declared: bool = False,
    scrubbed: bool = False,
) -> DataFrame:
    """Text columns to numbers, all or nothing per column.

    A column that holds any cell which is no number after cleaning stays text, unchanged.  Finding
    that out takes one pass over the data.  With ``declared=True`` the columns are known to be
    counts, so the pass is skipped, and a cell that is no whole number in any notation stops the
    job.  Ids in ``keys`` never turn into numbers, or they would lose their leading zeros.
    ``scrubbed`` makes the reserve codes among whole numbers null on the way.

    All columns of one type are gathered and read as one array, so a table takes the same few
    expressions whatever its width.
    """
    protected = set(keys)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    wanted = text if columns is None else [c for c in columns if c in text]
    wanted = [c for c in wanted if c not in protected]
    types = dict.fromkeys(wanted, "bigint") if declared else convertible(df, wanted, ignore, mode)
    read, names = df, {}
    for kind in ("bigint", "double"):
        own = [c for c in wanted if types[c] == kind]
        if not own:
            continue
        into = f"_{kind}s"
        longs = kind == "bigint"
        value = cells.to_longs(into, ignore, mode, scrubbed) if longs else cells.to_doubles(into, ignore, mode)
        read = cells.gather(read, own, into).withColumn(into, value)
        names |= cells.unpacked(own, into)
    return read.select(*[names[c].alias(c) if c in names else F.col(quote(c)) for c in df.columns])


def scrub(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Negative reserve codes to null in every numeric column."""
    skip = set(exclude)
    return K.replace_by(df, **{c: C.scrub_reserve(c) for c in K.numeric_columns(df) if c not in skip})


def detect_standard(df: DataFrame, into: str = "RACES_REPORTED") -> DataFrame:
    """5 or 7, from the sum of the numeric cells whose names carry ``_7_``; text columns have no sum."""
    numbers = set(K.numeric_columns(df))
    seven = [c for c in K.expand(df, "*_7_*") if c in numbers]
    return df.withColumn(into, C.reporting_standard(rowtotal(seven)))


def both_standards(df: DataFrame) -> DataFrame:
    """Rows that report non-zero counts under both standards (there should be none)."""
    numbers = set(K.numeric_columns(df))
    five, seven = ([c for c in K.expand(df, p) if c in numbers] for p in ("*_5_*", "*_7_*"))
    return df.filter((rowtotal(five) != 0) & (rowtotal(seven) != 0))


def select_by_standard(
    df: DataFrame, choices: Sequence[V.Choice], others: Sequence[str], standard: str = "RACES_REPORTED"
) -> DataFrame:
    """The target cells, each from the source column of the standard its row reports under."""
    picked = [C.by_standard(standard, c.five, c.seven).alias(c.target) for c in choices]
    return df.select(*others, *picked)


def fact_cells(df: DataFrame, ids: Sequence[str], cells: Sequence[str], value: str = "value") -> DataFrame:
    """Wide measure columns as long rows ``(ids, measure, gender, race, status, value)``.

    Names are parsed here, once, so no row is matched against a pattern at run time.
    """
    def row(cell: str) -> str:
        texts = ["CAST(NULL AS STRING)" if p is None else f"'{p}'" for p in parse_name(cell).values()]
        return ", ".join([*texts, f"CAST({quote(cell)} AS BIGINT)"])

    stacked = f"stack({len(cells)}, {', '.join(row(c) for c in cells)}) AS (measure, gender, race, status, {value})"
    return df.select(*ids, F.expr(stacked))


def parse_name(target: str) -> dict[str, str | None]:
    """Measure, gender, race and status of a target column name."""
    m = re.match(V.TARGET_PATTERN, target)
    if not m:
        raise ValueError(f"{target} is not a name of the vocabulary")
    return dict(zip(("measure", "gender", "race", "status"), m.groups()))


def name_attributes(name) -> dict:
    """Attribute columns of a column of target names, by the same grammar."""

    def part(i: int):
        return F.nullif(F.regexp_extract(name, V.TARGET_PATTERN, i), F.lit(""))

    status = part(4)

    def flag(*codes):
        return F.coalesce(status.isin(*codes), F.lit(False)).cast("int")

    return {
        "measure": part(1),
        "gender": part(2),
        "race": part(3),
        "status": status,
        "DIS": flag("DIS", "IDEA", "504", "DIS_LEP", "IDEA_PS"),
        "LEP": flag("LEP", "NODIS_LEP", "DIS_LEP", "LEP_PS"),
        "PS": flag("PS", "LEP_PS", "IDEA_PS"),
        "DSO": flag("504"),
        "instances": F.coalesce(part(1).isin("CORPINST", "OSSINSTANCES"), F.lit(False)).cast("int"),
        "suspension": F.coalesce(part(1).isin("SINGOSS", "MULTOSS", "ISS", "OSS"), F.lit(False)).cast("int"),
    }


ATTRIBUTES = ["measure", "gender", "race", "status", "DIS", "LEP", "PS", "DSO", "instances", "suspension"]


def wave_dictionary(spark: SparkSession, crosswalk: dict[str, str], races_reported: int | None = 7) -> DataFrame:
    """One row per source column of a wave: its name, its target and the attributes of the target."""
    rows = spark.createDataFrame(list(crosswalk.items()), "name string, name_merge string")
    attrs = name_attributes(F.col("name_merge"))
    return rows.select(
        "name", "name_merge", *[c.alias(k) for k, c in attrs.items()], F.lit(races_reported).alias("races_reported")
    )


def column_dictionary(df: DataFrame, ignore: Iterable[str] = V.ID_COLUMNS) -> DataFrame:
    """One row per column of a source table but those to ignore: its name and what the name says, null where no era has such a name."""
    known = {c.upper() for c in ignore}
    rows = [(c, *(SN.read(c) or (None,) * len(SN.Meaning._fields))) for c in df.columns if c.upper() not in known]
    kinds = {f: "string" if i < 5 else "int" for i, f in enumerate(SN.Meaning._fields)}
    return df.sparkSession.createDataFrame(rows, "name string, " + ", ".join(f"{f} {kind}" for f, kind in kinds.items()))


def unread(df: DataFrame, ignore: Iterable[str] = V.ID_COLUMNS) -> list[str]:
    """Columns whose names no era has."""
    known = {c.upper() for c in ignore}
    return [c for c in df.columns if c.upper() not in known and SN.read(c) is None]


def availability(dictionaries: dict[str, DataFrame], on: Sequence[str] = ("name_merge", *ATTRIBUTES)) -> DataFrame:
    """Which source column carries each variable in each wave: one row per variable, one column per wave.

    A variable that two columns of one wave claim stops the job.
    """
    tagged = [d.select(*on, F.lit(w).alias("_wave"), "name") for w, d in dictionaries.items()]
    stacked = reduce(DataFrame.unionByName, tagged)
    names = [F.max(F.when(F.col("_wave") == w, F.col("name"))).alias(w) for w in dictionaries]
    counts = [F.count_if(F.col("_wave") == w) for w in dictionaries]
    table = stacked.groupBy(*on).agg(*names, F.greatest(*counts, F.lit(0)).alias("_n"))
    message = F.concat(F.lit("not unique in a wave: "), F.coalesce(F.col(on[0]).cast("string"), F.lit("null")))
    return guard(table, F.col("_n") <= 1, message).drop("_n")

