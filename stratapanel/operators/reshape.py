"""Wide to long, long to wide, and stacking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import in_, quote
from .guards import guard


def reshape_long(
    df: DataFrame, stubs: Sequence[str], j: str, suffixes: Sequence[str] | None = None
) -> DataFrame:
    """Columns ``<stub><suffix>`` become one row per suffix with one value column per stub.

    Other columns stay.  A missing ``<stub><suffix>`` column gives nulls.  No shuffle.
    """
    if suffixes is None:
        found = {c[len(s) :] for s in stubs for c in df.columns if c.startswith(s) and c != s}
        suffixes = sorted(found)
    wide = {s + x for s in stubs for x in suffixes}
    rest = [c for c in df.columns if c not in wide]
    present = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = {s: next(present[s + x] for x in suffixes if s + x in present) for s in stubs}

    def cell(stub: str, suffix: str) -> str:
        c = quote(stub + suffix) if stub + suffix in present else "NULL"
        return f"CAST({c} AS {types[stub]})"

    rows = ", ".join(f"'{x}', " + ", ".join(cell(s, x) for s in stubs) for x in suffixes)
    names = ", ".join(quote(n) for n in (j, *stubs))
    return df.select(*[quote(c) for c in rest], F.expr(f"stack({len(suffixes)}, {rows}) AS ({names})"))


def pivot_wider(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """One row per ``ids``, one column ``<value>_<name>`` per value and name.

    Names are listed, so no job is needed to find them; a row with another name fails.  The input
    holds at most one row per id and name, or the job stops.  An absent combination is null.
    """
    known = guard(df, in_(names_from, names), F.concat(F.lit("unlisted name: "), F.col(names_from).cast("string")))
    cells = [
        F.expr(f"max(CASE WHEN {quote(names_from)} = '{n}' THEN {quote(v)} END) AS {quote(f'{v}_{n}')}")
        for v in values_from
        for n in names
    ]
    counts = [f"count_if({quote(names_from)} = '{n}')" for n in names]
    most = F.expr(f"greatest({', '.join(counts)}, 0)").alias("_most")
    wide = known.groupBy(*ids).agg(*cells, most)
    where = F.concat_ws(", ", *[F.coalesce(F.col(quote(i)).cast("string"), F.lit("null")) for i in ids])
    return guard(wide, F.col("_most") <= 1, F.concat(F.lit("several rows of one name: "), where)).drop("_most")


def pivot_longer(
    df: DataFrame, columns: Sequence[str], names_to: str = "type", values_to: str = "value"
) -> DataFrame:
    """The listed columns become rows of (name, value); all other columns stay."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, list(columns), names_to, values_to)


def append(*tables: DataFrame) -> DataFrame:
    """Tables under one another by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def append_distinct(*tables: DataFrame) -> DataFrame:
    return append(*tables).distinct()
