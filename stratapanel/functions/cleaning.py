"""Text and code cleaning of survey cells; every function returns a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import _col, quote

# What counts as a number in a text cell.  More than 18 digits do not fit a whole
# number for sure and are read as a double.
INTEGER_TEXT = r"^[+-]?[0-9]{1,18}$"
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

STRIP_MODES = ("faithful", "strict")


def strip_filler(c: Column | str, ignore: str = "", mode: str = "faithful") -> Column:
    """Cell text without filler; empty cells and the missing mark ``.`` become null.

    ``faithful`` removes the ignored characters wherever they stand, so the text code ``-9`` with
    ``-`` ignored becomes 9.  ``strict`` only empties cells made of nothing but filler, so signed
    numbers keep their sign.
    """
    if mode not in STRIP_MODES:
        raise ValueError(f"mode must be one of {STRIP_MODES}, not {mode!r}")
    text = F.trim(_col(c).cast("string"))
    if ignore and mode == "faithful":
        text = F.trim(F.translate(text, ignore, ""))
    elif ignore:
        only_filler = f"^[{re.escape(ignore)}]+$"
        text = F.when(~text.rlike(only_filler), text)
    return F.when(~text.isin("", "."), text)


def without_filler_sql(text: str, ignore: str = "", mode: str = "faithful") -> str:
    """SQL of a text without the ignored characters, before it is read as a whole number."""
    if ignore and mode == "strict":
        return f"regexp_replace({text}, r'^\\s*[{re.escape(ignore)}]+\\s*$', '')"
    if ignore:
        return f"replace({text}, '{ignore}', '')" if len(ignore) == 1 else f"translate({text}, '{ignore}', '')"
    return text


def whole_number_sql(text: str) -> str:
    """SQL of the whole number that a text holds; plain digits take the first, cheap way."""
    number = f"try_cast({text} AS DECIMAL(38, 10))"
    other = (
        f"CASE WHEN nullif(nullif(trim({text}), ''), '.') IS NULL THEN NULL "
        f"WHEN {number} % 1 = 0 THEN CAST({number} AS BIGINT) ELSE CAST(raise_error(concat('no whole number: ', {text})) AS BIGINT) END"
    )
    return f"coalesce(try_cast({text} AS BIGINT), {other})"


def text_to_long(column: str, ignore: str = "", mode: str = "faithful") -> Column:
    """Whole number in the cells of a column, in any notation (``12``, ``12.0``, ``1e2``).

    Empty cells and a lone dot are null once filler is gone; any other text that is no whole number
    stops the job, so a count is never lost.
    """
    text = f"nullif({without_filler_sql(f'CAST({quote(column)} AS STRING)', ignore, mode)}, '')"
    return F.expr(whole_number_sql(text))


def text_to_double(c: Column | str, ignore: str = "", mode: str = "faithful") -> Column:
    """Number in the cell, null when the cleaned text is not one."""
    text = strip_filler(c, ignore, mode)
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def scrub_reserve(column: str) -> Column:
    """Negative values are reserve codes and become null."""
    c = quote(column)
    return F.expr(f"CASE WHEN {c} >= 0 THEN {c} END")


def flag_code(c: Column | str) -> Column:
    """Yes/No/-5 text to 1/0/-5; anything else is null."""
    c = _col(c)
    return F.when(c == "Yes", 1).when(c == "No", 0).when(c == "-5", -5)


def incomplete_flag(c: Column | str) -> Column:
    """1 when the cell holds any remark, 0 when it is blank or null."""
    c = _col(c)
    return F.when(c.isNull() | (F.trim(c) == ""), 0).otherwise(1)


def zero_pad(c: Column | str, width: int = 5) -> Column:
    """Numeric text padded with zeros to ``width``; longer numbers are kept whole, and what is no number becomes a dot."""
    number = F.round(text_to_double(c)).cast("bigint")
    return F.when(number.isNotNull(), F.format_string(f"%0{width}d", number)).otherwise(".")


def school_key(leaid: Column | str, schid: Column | str, width: int = 5) -> Column:
    """District id followed by the zero-padded school number."""
    return F.concat(_col(leaid), zero_pad(schid, width))


def state_prefix(leaid: Column | str) -> Column:
    """First two characters of the district id."""
    return F.substring(_col(leaid), 1, 2)


def rewrite_year(c: Column | str, old: int, new: int) -> Column:
    """Year read as text, ``old`` replaced by ``new`` wherever it occurs, and read back."""
    return F.regexp_replace(_col(c).cast("string"), str(old), str(new)).try_cast("int")


def reporting_standard(total7: Column | str) -> Column:
    """7 when any seven-category cell was counted, else 5."""
    t7 = _col(total7)
    return F.when(t7.isNotNull() & (t7 != 0), 7).otherwise(5)


def by_standard(standard: str, five: str | None, seven: str) -> Column:
    """Cell of the reported standard; groups that only exist under seven are taken as they are."""
    if five is None:
        return F.col(quote(seven))
    return F.expr(f"CASE {quote(standard)} WHEN 5 THEN {quote(five)} WHEN 7 THEN {quote(seven)} END")
