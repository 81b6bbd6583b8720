"""Asking the whole table about many hashes: chunks of rows, buckets of hashes.

A chunk's distinct hashes go to their buckets as one binary value each, so that a hash costs about eight bytes on the way and a
hash that every row holds costs a bucket one entry for a chunk. Both numbers follow from the bytes of text.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm import store
from stratapanel.llm.words import U64

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20


def sizes(text_bytes: int) -> tuple[int, int]:
    """Numbers of chunks and buckets."""
    return store.parts(text_bytes, CHUNK_BYTES), store.parts(text_bytes, BUCKET_BYTES)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number that each read of them gives alike, and its column: from their place in their file, so that rows that repeat each
    other are told apart. Rows that come from no Parquet file are written to one first."""
    name = f"_row_key_{len(docs.columns)}"
    key = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        return docs.withColumn(name, key), name
    except AnalysisException:
        return store.written(docs, "numbered").withColumn(name, key), name


def chunk_of(chunks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("int")


def to_planes(sorted_hashes: np.ndarray) -> bytes:
    """Eight byte planes; the leading ones of sorted values are nearly constant and compress well."""
    return sorted_hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(U64)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The used buckets, each with the places of its entries in their order."""
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    return list(zip(used.tolist(), np.split(order, first[1:]), strict=True)) if len(used) else []
