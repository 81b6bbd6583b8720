"""The missing-value rules the panel work needs, each spelled out as a Column builder.

Spark's own rule (``sum`` of nothing is null, ``NOT IN`` drops nulls, comparisons with null are
null) differs from all three source rules, so no transformation relies on it implicitly.

Rules that are applied to many columns at once take column names and build one SQL expression
each: on a table with hundreds of columns, composing them call by call takes longer than the job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote(name: str) -> str:
    """Column name for use inside a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def sum0(c: Column | str) -> Column:
    """Aggregate: nulls count as 0 and an all-null group sums to 0 (``collapse (sum)``)."""
    if isinstance(c, str):
        return F.expr(f"coalesce(sum({quote(c)}), 0)")
    return F.coalesce(F.sum(c), F.lit(0))


def sum_na(c: Column | str) -> Column:
    """Aggregate: one null makes the whole group null (``sum`` without ``na.rm``)."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def sum_na_where(column: str, value: str, c: str) -> Column:
    """``sum_na`` of ``c`` over the rows whose ``column`` is ``value``; null when there is none."""
    test, c = f"{quote(column)} = '{value}'", quote(c)
    return F.expr(f"CASE WHEN count_if({test} AND {c} IS NULL) = 0 THEN sum(CASE WHEN {test} THEN {c} END) END")


def rowtotal(columns: Iterable[str]) -> Column:
    """Row-wise sum with nulls as 0; an all-null row gives 0."""
    return F.expr(" + ".join(f"coalesce({quote(c)}, 0)" for c in columns))


def rowtotal_missing(columns: Sequence[str]) -> Column:
    """Row-wise sum with nulls as 0, but null when every input is null."""
    names = ", ".join(quote(c) for c in columns)
    total = " + ".join(f"coalesce({quote(c)}, 0)" for c in columns)
    return F.expr(f"CASE WHEN coalesce({names}) IS NOT NULL THEN {total} END")


def in_(c: Column | str, values: Iterable) -> Column:
    """Membership that is never null: a null matches only when None is listed."""
    return _membership(_col(c), list(values))


def not_in(c: Column | str, values: Iterable) -> Column:
    """Negated membership that is never null: null rows are kept unless None is listed."""
    return ~_membership(_col(c), list(values))


def _membership(c: Column, values: list) -> Column:
    named = [v for v in values if v is not None]
    hit = F.coalesce(c.isin(named), F.lit(False)) if named else F.lit(False)
    return hit | c.isNull() if len(named) < len(values) else hit


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """Three-argument conditional in which a null test gives null."""
    return F.when(test, yes).when(~test, no)


def below(c: Column | str, bound) -> Column:
    """``x < bound`` where a missing x ranks above every number, hence false."""
    return F.coalesce(_col(c) < F.lit(bound), F.lit(False))


def differs(c: Column | str, value) -> Column:
    """``x != value`` where a missing x differs from every number, hence true."""
    return F.coalesce(_col(c) != F.lit(value), F.lit(True))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division; a zero or null denominator gives null (never Inf, NaN or an error)."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))
