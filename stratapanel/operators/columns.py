"""Choosing, naming, ordering, deriving and labelling columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import quote
from .ranges import running

Spec = str | tuple[str, str]

# As many value labels as one column of a Stata table may have.
MOST_LABELS = 65_536


def expand(df: DataFrame, *specs: Spec) -> list[str]:
    """Column names for a list of specs, in the order asked for and without repeats.

    A spec is a name, a wildcard (``CORP_*``, ``*corp*``) or a pair ``(first, last)`` for every
    column from one to the other by position.
    """
    columns = df.columns
    out: list[str] = []
    for spec in specs:
        if isinstance(spec, tuple):
            first, last = (columns.index(_known(columns, s)) for s in spec)
            if first > last:
                raise ValueError(f"{spec[0]} comes after {spec[1]}")
            found = columns[first : last + 1]
        elif "*" in spec or "?" in spec:
            found = [c for c in columns if fnmatchcase(c, spec)]
        else:
            found = [_known(columns, spec)]
        out += [c for c in found if c not in out]
    return out


def _known(columns: Sequence[str], wanted: str) -> str:
    if wanted not in columns:
        raise ValueError(f"column {wanted} not found")
    return wanted


def keep(df: DataFrame, *specs: Spec) -> DataFrame:
    """Only the columns matched, in table order."""
    chosen = set(expand(df, *specs))
    return df.select([quote(c) for c in df.columns if c in chosen])


def drop(df: DataFrame, *specs: Spec) -> DataFrame:
    """Everything but the columns matched."""
    return df.drop(*expand(df, *specs))


def order(df: DataFrame, *specs: Spec) -> DataFrame:
    """Matched columns first, the rest after them in table order."""
    front = expand(df, *specs)
    return df.select([quote(c) for c in front + [c for c in df.columns if c not in front]])


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def rename(df: DataFrame, names: dict[str, str], missing: str = "error") -> DataFrame:
    """Rename by a crosswalk, all names at once; a source column that is not there is an error unless ``missing="skip"``."""
    absent = [c for c in names if c not in df.columns]
    if absent and missing == "error":
        raise ValueError(f"columns not found: {absent}")
    return df.toDF(*[names.get(c, c) for c in df.columns])


def rename_pairs(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return rename(df, dict(zip(old, new)))


def constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({n: F.lit(v) for n, v in values.items()})


def replace_by(df: DataFrame, **derived: Column) -> DataFrame:
    """Existing columns replaced, in place, by expressions over the old row."""
    for c in derived:
        _known(df.columns, c)
    return df.withColumns(derived) if derived else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def apply_to(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """``fn`` over each of the columns, in one projection."""
    return replace_by(df, **{c: fn(F.col(quote(c))) for c in columns})


def apply_numeric(df: DataFrame, fn: Callable[[Column], Column], exclude: Iterable[str] = ()) -> DataFrame:
    """``fn`` over every column whose type is numeric."""
    skip = set(exclude)
    return apply_to(df, [c for c in numeric_columns(df) if c not in skip], fn)


def _with_metadata(df: DataFrame, metadata: dict[str, dict]) -> DataFrame:
    """One projection, whatever the number of columns."""
    if not metadata:
        return df
    return df.select([F.col(quote(c)).alias(c, metadata=metadata[c]) if c in metadata else F.col(quote(c)) for c in df.columns])


def label(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Attach display labels as column comments, keeping other metadata."""
    known = {_known(df.columns, c): text for c, text in labels.items()}
    held = {f.name: f.metadata for f in df.schema.fields}
    return _with_metadata(df, {c: {**held[c], "comment": text} for c, text in known.items()})


def clear_labels(df: DataFrame) -> DataFrame:
    held = {f.name: f.metadata for f in df.schema.fields if "comment" in f.metadata}
    return _with_metadata(df, {c: {k: v for k, v in meta.items() if k != "comment"} for c, meta in held.items()})


def label_values(df: DataFrame, column: str, labels: dict[int, str]) -> DataFrame:
    """Attach the texts that a column's codes stand for; a table written as Parquet or Stata file keeps them."""
    if len(labels) > MOST_LABELS:
        raise ValueError(f"{len(labels)} labels for {column}, more than {MOST_LABELS}")
    held = df.schema[_known(df.columns, column)].metadata
    return _with_metadata(df, {column: {**held, "labels": {str(code): text for code, text in labels.items()}}})


def value_labels(df: DataFrame, column: str) -> dict[int, str]:
    """Texts by code, as attached to the column."""
    return {int(code): text for code, text in df.schema[_known(df.columns, column)].metadata.get("labels", {}).items()}


def label_list(df: DataFrame) -> DataFrame:
    """Every label of the table: rows (column, label, code, text), a column without value labels once."""
    rows = []
    for f in df.schema.fields:
        texts = value_labels(df, f.name) or {None: None}
        if f.metadata.get("comment") or f.metadata.get("labels"):
            rows += [(f.name, f.metadata.get("comment"), code, text) for code, text in texts.items()]
    return df.sparkSession.createDataFrame(rows, "column string, label string, code bigint, text string")


def decode(df: DataFrame, column: str, into: str) -> DataFrame:
    """The texts of a labelled column's codes; a code without a label becomes its number, as a table would show it, and null stays null."""
    labels = list(value_labels(df, column).items())
    # at most MOST_LABELS rows
    texts = F.broadcast(df.sparkSession.createDataFrame(labels, "_code bigint, _text string"))
    joined = df.join(texts, F.col(quote(column)) == F.col("_code"), "left")
    kept = [F.col(quote(c)) for c in df.columns if c != into]
    return joined.select(*kept, F.coalesce("_text", F.col(quote(column)).cast("string")).alias(into))


def merge_labels(df: DataFrame, column: str, *tables: DataFrame) -> DataFrame:
    """Give a column the labels it has in any of the tables, as when waves are put under one another; one code with two texts is an error."""
    merged: dict[int, str] = {}
    for table in (df, *tables):
        for code, text in value_labels(table, column).items():
            if merged.setdefault(code, text) != text:
                raise ValueError(f"code {code} of {column} is both {merged[code]!r} and {text!r}")
    return label_values(df, column, merged)


def encode(df: DataFrame, column: str, into: str, labelled: bool = False) -> DataFrame:
    """Text categories to the codes 1..k in alphabetical order; blank and null stay null.

    ``labelled`` attaches the categories to the codes, which brings them to the driver; more than ``MOST_LABELS`` are an error.
    """
    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    labels = df.select(text.alias("_label")).dropna().distinct().withColumn("_one", F.lit(1))
    codes = running(labels, "_label", "_one", into, "_all").select("_label", F.col(into).cast("int").alias(into))
    joined = df.withColumn("_label", text).join(codes, "_label", "left")
    coded = joined.select(*[df_col for df_col in df.columns if df_col != into], into)
    if not labelled:
        return coded
    return label_values(coded, into, {code: text for text, code in codes.limit(MOST_LABELS + 1).collect()})


def recode(df: DataFrame, column: str, rules: dict, otherwise: str = "keep") -> DataFrame:
    """Values replaced by rule; the key None stands for null."""
    c = F.col(column)
    out = None
    for old, new in rules.items():
        hit = c.isNull() if old is None else c == old
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return replace_by(df, **{column: out.otherwise(c) if otherwise == "keep" else out})
