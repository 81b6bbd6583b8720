"""Language of texts by the nearest of several centroids per language (operator 5).

A text is a TF-IDF vector over hashed byte trigrams of its letters (A-Z lower-cased, runs of other characters as one space),
with sublinear counts, scaled to length one. Each language's labelled texts are clustered into up to `CENTROIDS` spherical
k-means centroids, so that a language may have several kinds of text. A text takes the language of the centroid with the highest
cosine; if even that one is farther than all but a few of the language's own training texts, the text is marked as rejected.

The classifier is fitted on at most `SAMPLE` labelled texts per language, those with the smallest hash of their id, which is
the documented bound on what reaches one task: a vector of `SIZE` numbers each. Everything else covers the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.llm import store
from stratapanel.llm.words import FOLD, byte_column, slices

SIZE = 4096
SAMPLE = 400
CENTROIDS = 4
ROUNDS = 12
REJECT_SHARE = 0.01
UNKNOWN = "und"
TEXTS_AT_ONCE = 256

#: Letters of ASCII and all bytes of longer characters; everything else separates.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
SPELL = np.where(LETTER, FOLD, 32).astype(np.uint8)


def counts(texts: list[bytes]) -> np.ndarray:
    """Sublinear counts of hashed trigrams, a row for each text."""
    data = np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    spelled = SPELL[data].astype(np.uint32)
    solid = (spelled[1:] != 32) | (spelled[:-1] != 32)
    solid = np.concatenate(([True], solid))
    spelled, owner = spelled[solid], owner[solid]
    if len(spelled) < 3:
        return np.zeros((len(texts), SIZE), np.float32)
    code = (spelled[:-2] << 16) | (spelled[1:-1] << 8) | spelled[2:]
    feature = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    keep = (owner[:-2] == owner[2:]) & (spelled[1:-1] != 32)
    table = np.bincount(owner[:-2][keep] * SIZE + feature[keep], minlength=len(texts) * SIZE)
    return np.log1p(table.reshape(len(texts), SIZE).astype(np.float32))


def scaled(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


def clustered(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from spread-out starts; the same rows in the same order give the same centroids."""
    centres = [scaled(vectors.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(vectors)):
        centres.append(vectors[int((vectors @ np.array(centres).T).max(axis=1).argmin())])
    centres = np.array(centres)
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        centres = scaled(np.array([vectors[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))]))
    return centres


@dataclass
class Classifier:
    names: list[str]  # the language of each centroid
    weights: np.ndarray
    centroids: np.ndarray
    least: dict[str, float]  # cosine below which a text is too far from the language

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine with its nearest centroid, and whether that is too far away. A text without a letter is `und`, 0."""
        names, scores, rejected = [], [], []
        for low in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[low : low + TEXTS_AT_ONCE]
            vectors = scaled(counts(part) * self.weights)
            near = vectors @ self.centroids.T if self.names else np.zeros((len(part), 1), np.float32)
            for text, row, best in zip(part, near, near.argmax(axis=1), strict=True):
                lettered = has_letter(text)
                name = self.names[best] if lettered and self.names else UNKNOWN
                score = float(min(1.0, max(0.0, row[best]))) if lettered else 0.0
                names.append(name)
                scores.append(score)
                rejected.append(score < self.least.get(name, 0.0) or name == UNKNOWN)
        return names, scores, rejected


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter in Unicode's sense."""
    return any(c.isalpha() for c in text[:64].decode(errors="ignore")) or any(c.isalpha() for c in text.decode())


def vectorised(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(1))
            for low in range(0, len(texts), TEXTS_AT_ONCE):
                rows = [row.tobytes() for row in counts(texts[low : low + TEXTS_AT_ONCE])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(rows)), pa.array(rows, pa.binary())], names=["lang", "vector"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, vector binary")


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: number of vectors, and in how many of them each feature occurs."""
    n, seen = 0, np.zeros(SIZE, np.int64)
    for batch in batches:
        for vector in batch.column(0).to_pylist():
            n += 1
            seen += np.frombuffer(vector, np.float32) > 0
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([seen.tobytes()], pa.binary())], names=["n", "seen"])


def clusterer(weights: np.ndarray, centroids: int):
    def cluster(rows: pa.Table) -> pa.Table:
        table = np.array([np.frombuffer(v, np.float32) for v in sorted(rows["vector"].to_pylist())])
        vectors = scaled(table * weights)
        centres = clustered(vectors, centroids)
        least = float(np.quantile((vectors @ centres.T).max(axis=1), REJECT_SHARE))
        n, name = len(centres), rows["lang"][0].as_py()
        return pa.table({"lang": [name] * n, "k": pa.array(range(n), pa.int32()), "centroid": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary()), "least": [least] * n})

    return cluster


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Classifier:
    """From rows of key, text and lang; rows without a language or a letter teach nothing, and rows alike count once.

    A language's sample is its texts with the smallest hashes. The languages are counted first, so that only texts below a hash that
    twice the sample is expected to reach move, however many rows a language has. A language's sample is clustered in one task; what comes
    to the driver is a count and the centroids of each language and a sum of features for each task.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("key", "text"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("hash")).collect()
    if not sizes:
        return Classifier([], np.ones(SIZE, np.float32), np.zeros((0, SIZE), np.float32), {})
    highest = {name: min(2**63 - 1, -(2**63) + 2**64 * 2 * sample // max(n, 1)) for name, n in sizes}
    limits = F.create_map(*[F.lit(x) for pair in highest.items() for x in pair])
    near = labelled.filter(F.col("hash") <= limits[F.col("lang")])
    once = near.groupBy("lang", "key", "hash").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "key"))
    chosen = once.withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "text")
    rows = store.written(vectorised(chosen), "sample")
    parts = rows.select("vector").mapInArrow(document_counts, "n long, seen binary").toArrow()
    n = sum(parts["n"].to_pylist())
    seen = sum(np.frombuffer(x, np.int64) for x in parts["seen"].to_pylist())
    weights = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    found = rows.groupBy("lang").applyInArrow(clusterer(weights, centroids), "lang string, k int, centroid binary, least double").toArrow()
    found = sorted(zip(*(found[c].to_pylist() for c in ("lang", "k", "centroid", "least")), strict=True))
    table = np.array([np.frombuffer(c, np.float32) for _, _, c, _ in found])
    return Classifier([name for name, _, _, _ in found], weights, table, {name: least for name, _, _, least in found})


def predict(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, lang_pred, score, rejected; nothing but the text decides.

    Null texts and texts without a letter are `und` with score 0 and rejected; so is every text if nothing was learnt. Ties go to
    the centroid that comes first, languages being in order of name. Repeated rows are judged each; other columns are ignored;
    an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(1))
            found = [shared.value.predict(texts[low:high]) for low, high in slices(texts)]
            columns = [pa.array([x for f in found for x in f[k]], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def op5_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
