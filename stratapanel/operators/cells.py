"""Many cells of a row as one array column.

A wave has up to 181 count columns and each is cleaned in the same way.  Written out column by column that is more code than one
generated method may hold, and more expressions than the analysis of the plan can go through quickly.  Here the cells of a row are
gathered once, worked on by one ``transform``, summed or graded by position, and only given back as columns at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.nulls import quote

CELLS = "_cells"


def gather(df: DataFrame, columns: Sequence[str], into: str = CELLS, kind: str = "STRING") -> DataFrame:
    """The cells of the columns, in their order, as one array."""
    items = ", ".join(f"CAST({quote(c)} AS {kind})" for c in columns)
    return df.withColumn(into, F.expr(f"array({items})"))


def to_longs(cells: str = CELLS, ignore: str = "", mode: str = "faithful", scrubbed: bool = False) -> Column:
    """Whole numbers of an array of text cells, by the rule of ``cleaning.text_to_long``; ``scrubbed`` makes reserve codes null."""
    texts = f"transform({quote(cells)}, x -> nullif({C.without_filler_sql('x', ignore, mode)}, ''))"
    longs = f"transform({texts}, x -> CASE WHEN x IS NOT NULL THEN {C.whole_number_sql('x')} END)"
    return F.expr(f"transform({longs}, x -> CASE WHEN x >= 0 THEN x END)" if scrubbed else longs)


def to_doubles(cells: str = CELLS, ignore: str = "", mode: str = "faithful") -> Column:
    """Numbers of an array of text cells, by the rule of ``cleaning.text_to_double``."""
    return F.transform(F.col(quote(cells)), lambda x: C.text_to_double(x, ignore, mode))


def grades(cells: str = CELLS, ignore: str = "", mode: str = "faithful") -> Column:
    """For each text cell 0 if it is empty or a whole number, 1 for another number, 2 for text."""

    def grade(x: Column) -> Column:
        text = C.strip_filler(x, ignore, mode)
        return F.when(text.isNull() | text.rlike(C.INTEGER_TEXT), 0).when(text.rlike(C.NUMBER_TEXT), 1).otherwise(2)

    return F.transform(F.col(quote(cells)), grade)


def unpacked(columns: Sequence[str], cells: str = CELLS) -> dict[str, Column]:
    """The cells of an array as columns."""
    return {c: F.expr(f"{quote(cells)}[{i}]") for i, c in enumerate(columns)}
