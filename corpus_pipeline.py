"""From raw documents to packed training sequences: five stages, each an operator of stratapanel.llm.

Each stage takes all rows that the one before it kept, as written and read again, and all but the last return the columns of
`documents`. Empty tables, nulls in any column, repeated rows and further columns pass as the operators' docstrings say: texts
without words go at the first stage, and of rows repeated as a whole one stays after the second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratapanel.llm import compression_rules, decontamination, near_dups, packing, pii, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    store.ready(spark)
    return compression_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more): the one of the smallest doc_id."""
    return near_dups.keep(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontamination.keep(docs, store.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; every other column, n_chars among them, stays as it was given."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("personal data", personal_data),
    ("best-fit packing", pack),
]

#: Compression ratios, alignments and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
