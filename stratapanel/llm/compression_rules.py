"""Quality rules by compression (operator 4).

Repetitive text compresses far better than prose of its length, and random bytes or encoded data hardly at all. A text's
zstandard ratio (compressed bytes / bytes) is held against limits for its length, as a whole and for each fixed chunk of it.
A text fails as a whole outside its limits, or if chunks outside theirs hold more than half of its bytes: a long text can hide a
repetitive half from the ratio of the whole.

Every text is judged in its own task in one pass; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import store
from stratapanel.llm.words import SPACE, U64, Words, byte_column, hashed, mix, slices

LEVEL = 3
CHUNK = 4096
#: From so many bytes on: lowest and highest ratio. The frame's own bytes weigh on short texts, below 64 they decide and no limit holds.
#: From 512 bytes on the highest is below base64 in lines (0.826 at 639 bytes, 0.797 at 1023, 0.754 at 80,000) and above prose of any
#: script (Chinese, the densest in UTF-8, 0.80 at 512, 0.74 at 640); below that the two meet. Hexadecimal (0.62 to 0.50) is within prose.
BANDS = (
    (64, 0.35, 1.25), (256, 0.32, 0.95), (512, 0.28, 0.82), (640, 0.28, 0.79), (1024, 0.25, 0.75), (4096, 0.20, 0.70), (16384, 0.15, 0.65), (65536, 0.12, 0.65),
)
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunk_bytes long, base_failed boolean, kept boolean"


def in_band(size: int, ratio: float) -> bool:
    for least, low, high in reversed(BANDS):
        if size >= least:
            return low <= ratio <= high
    return True


def compression(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, bool]:
    """Ratio of the whole (1 for an empty text), bytes in chunks outside their limits, and the verdict."""
    size = len(text)
    if not size:
        return 1.0, 0, True
    ratio = len(packer.compress(text)) / size
    bad = 0
    for at in range(0, size if size > CHUNK else 0, CHUNK):
        part = text[at : at + CHUNK]
        if not in_band(len(part), len(packer.compress(part)) / len(part)):
            bad += len(part)
    return ratio, bad, in_band(size, ratio) and 2 * bad <= size


def measured(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of some texts."""
    words = Words(texts)
    n, data, owner = len(texts), words.data, words.owner()
    cuts = np.concatenate(([0], np.cumsum(words.size + 1)))

    def bytes_with(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[cuts[1:] - 1] - sums[cuts[:-1]]

    chars = bytes_with(((data & 0xC0) != 0x80) & ~SPACE[data])
    symbols = bytes_with(SYMBOL[data])

    start, end, line = hashed(data, NEWLINE)
    inked = np.concatenate(([0], np.cumsum(~SPACE[data], dtype=np.int64)))
    real = inked[end] > inked[start]
    line_owner = (np.searchsorted(cuts, start, side="right") - 1)[real]
    _, first = np.unique(mix(line[real] + mix(line_owner.astype(U64))), return_index=True)
    dup_lines = np.bincount(line_owner, minlength=n) - np.bincount(line_owner[first], minlength=n)

    hashes, at = words.windows(WINDOW)
    _, back, counts = np.unique(mix(hashes + mix(owner[at].astype(U64))), return_inverse=True, return_counts=True)
    repeat = words.per_text(words.covered(at[counts[back] > 1], WINDOW))

    packer = zstandard.ZstdCompressor(level=LEVEL)
    zstd = [compression(text, packer) for text in texts]
    failed = (words.count < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * words.count)
    return {
        "n_words": words.count, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
        "ratio": np.array([r for r, _, _ in zstd], dtype=float), "bad_chunk_bytes": np.array([b for _, b, _ in zstd], dtype=np.int64),
        "base_failed": failed, "kept": ~failed & np.array([k for _, _, k in zstd], dtype=bool),
    }


def all_measures(column: pa.Array) -> dict[str, np.ndarray]:
    texts = byte_column(column)
    found = [measured(texts[low:high]) for low, high in slices(texts)]
    return {k: np.concatenate([x[k] for x in found]) for k in found[0]}


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id and the measures; `kept` is false where a rule fails.

    base_failed: fewer than 10 words, or over 20 % of the words in 5-word windows that occur twice or more in the text. Otherwise
    the compression limits decide. Null and empty texts have no words and fail; their ratio is 1. Repeated rows are judged
    each; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = all_measures(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in found.values())], names=["doc_id", *found])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {MEASURES}")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with all their columns as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(all_measures(batch.column(at))["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op4_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(store.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunk_bytes"
    )
