"""Near-duplicate texts by MinHash with sequential Bayesian verification (operator 2).

A text's set is its distinct 5-word shingles. Texts with one and the same set form a class and are linked without comparing.
MinHash signatures of the classes are cut into bands; classes that agree on a band are candidates, and the candidate graph's
components are the groups to look into. The number of bands follows from the threshold and the chosen miss probability.

Within a group, the signatures of a pair are compared a batch at a time. With m of n positions equal, similarity has the
posterior Beta(m + 1, n - m + 1); the pair is dropped as soon as the probability that it reaches the threshold falls below the
miss probability. The others are checked exactly on their full sets. Pairs already joined through others are left out, so a
large group of copies costs about one comparison a member and no pair is ever written out.

A group of more than `BLOCK` classes is first looked into in blocks, twice, with blocks drawn anew; then those of its classes
that are not in its largest component meet all others, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import store
from stratapanel.llm.components import components
from stratapanel.llm.words import FOLD, U64, Words, byte_column, mix, slices

SHINGLE = 5
ROWS = 6
BATCH = 30
MISS = 1e-6
BLOCK = 4096
BLOCK_BYTES = 32 << 20
LEFT_BLOCK = 512


def bands_for(percent: int) -> int:
    """Bands of ROWS hashes so that a pair at the threshold shares none with at most the miss probability."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def signature_length(percent: int) -> int:
    """Hashes in a signature: all bands, in whole batches."""
    return -(-bands_for(percent) * ROWS // BATCH) * BATCH


def log_chance(k: int, n: int, p: float) -> float:
    """Log of the probability of k successes in n draws."""
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)


@lru_cache(maxsize=8)
def hopeless(percent: int, length: int) -> tuple[tuple[int, int], ...]:
    """After n positions, the most matches at which similarity reaches the threshold with less than the miss probability."""
    t, out = percent / 100, []
    for n in range(BATCH, length + 1, BATCH):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, -1
        while (tail := tail + math.exp(log_chance(m + 1, n + 1, t))) < MISS:
            m += 1
        out.append((n, m))
    return tuple(out)


@lru_cache(maxsize=4)
def factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64), 17) | U64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words has one for all of them."""
    found = []
    for low, high in slices(texts):
        words = Words(texts[low:high], fold=FOLD)
        hashes, at = words.windows(SHINGLE)
        cuts = np.searchsorted(at, words.first)
        for i, n in enumerate(words.count):
            if n >= SHINGLE or not n:
                found.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
            else:
                own = words.hash[words.first[i] : words.first[i + 1]]
                found.append(mix(np.array([sum(int(x) for x in mix(own + np.arange(n, dtype=U64) * U64(0x9E37), 19)) % 2**64], U64), 23))
    return found


def signature(shingles: np.ndarray, length: int) -> np.ndarray:
    least = np.full(length, 2**64 - 1, U64)
    scale = factors(length)[:, None]
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (scale * shingles[None, at : at + 2048]).min(axis=1), out=least)
    return (least >> U64(32)).astype("<u4")


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit number that stands for the set."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(shingles, 29)), mix(shingles, 31).sum()], U64)).sum().astype(np.int64))


def featured(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(2))
            for low, high in slices(texts):
                n, key, sign = [], [], []
                for own in shingle_sets(texts[low:high]):
                    n.append(len(own))
                    key.append(fingerprint(own) if len(own) else None)
                    sign.append(signature(own, length).tobytes() if len(own) else None)
                columns = [*(batch.column(c).slice(low, high - low) for c in (0, 1)), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(sign, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "set_key", "signature"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key long, signature binary")


def candidates(features: DataFrame, bands: int) -> DataFrame:
    """Links between set keys that share a band, each to the smallest of the bucket."""
    width = 4 * ROWS
    key = f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(signature, i * {width} + 1, {width})))"
    rows = features.filter("n_shingles > 0").select("set_key", F.explode(F.expr(key)).alias("band"))
    buckets = rows.groupBy("band").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).filter("least <> most")
    return rows.join(buckets.select("band", "least"), "band").filter("set_key <> least").select("set_key", "least").distinct()


class Links:
    """Which members are joined so far; `find` for all members at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> None:
        old = np.unique(self.label[others])
        self.label[np.isin(self.label, old)] = self.label[x]


def linked(texts: list[bytes], percent: int, first: int | None = None) -> np.ndarray:
    """A label for each text; texts are linked if and only if they have one label. With `first`, only pairs with one of the
    first so many texts are looked at."""
    sets = shingle_sets(texts)
    length = signature_length(percent)
    signatures = np.array([signature(s, length) for s in sets])
    size = np.array([len(s) for s in sets])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(len(ids), bool)
    links = Links(len(texts))
    batches = hopeless(percent, length)
    for x in range(len(texts) if first is None else first):
        y = np.flatnonzero(links.label != links.label[x])
        y = y[(y > x) if first is None else (y > x) | (y >= first)]
        y = y[(100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
        equal, done = np.zeros(len(y), np.int64), 0
        for n, most in batches:
            if not len(y):
                break
            equal = equal + (signatures[y, done:n] == signatures[x, done:n]).sum(axis=1)
            y, equal, done = y[equal > most], equal[equal > most], n
        if not len(y):
            continue
        mark[flat[start[x] : start[x + 1]]] = True
        held = np.concatenate([flat[start[i] : start[i + 1]] for i in y])
        both = np.add.reduceat(mark[held].astype(np.int64), np.concatenate(([0], np.cumsum(size[y])[:-1])))
        mark[flat[start[x] : start[x + 1]]] = False
        if (yes := 100 * both >= percent * (size[x] + size[y] - both)).any():
            links.join(x, y[yes])
    return links.label


def verifier(percent: int, rest: bool = False):
    def verify(members: pa.Table) -> pa.Table:
        if rest:
            members = members.sort_by([("asks", "descending"), ("set_key", "ascending")])
        keys = members["set_key"].to_numpy()
        first = int(np.sum(members["asks"].to_numpy(zero_copy_only=False))) if rest else None
        label = linked(byte_column(members["text"]), percent, first)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, label, keys)
        least = least[label]
        joined = least != keys
        return pa.table({"u": pa.array(keys[joined]), "v": pa.array(least[joined])})

    return verify


def verified(members: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that hold the same components as all pairs at the threshold. Members: component, set_key, text."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    dealt = members.join(sizes, "component")

    def in_blocks(rows: DataFrame, salt: int) -> DataFrame:
        block = F.pmod(F.xxhash64("set_key", F.lit(salt)), F.col("blocks"))
        return rows.withColumn("block", block).select("component", "block", "set_key", "text").groupBy("component", "block").applyInArrow(verifier(percent), "u long, v long")

    links = store.written(in_blocks(dealt, 1), "pairs")
    large = sizes.filter("blocks > 1")
    if large.isEmpty():
        return links
    split = store.written(dealt.filter("blocks > 1"), "split")
    links = links.union(store.written(in_blocks(split, 2), "pairs"))
    # members outside the largest component of their group meet all others
    label = components(links)
    labelled = split.join(label, split["set_key"] == label["node"], "left").withColumn("least", F.coalesce("least", "set_key")).drop("node")
    weight = labelled.groupBy("component", "least").agg(F.count("*").alias("n"))
    top = weight.groupBy("component").agg(F.max_by("least", F.struct("n", "least")).alias("top"))
    labelled = labelled.join(top, "component").withColumn("asks", F.col("least") != F.col("top"))
    left = labelled.filter("asks").groupBy("component").agg(F.count("*").alias("n_left"))
    labelled = labelled.join(left, "component").withColumn("rows", F.ceil(F.col("n_left") / LEFT_BLOCK))
    row = F.pmod(F.xxhash64("set_key", F.lit(3)), F.col("rows"))
    column = F.pmod(F.xxhash64("set_key", F.lit(4)), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("rows") - 1))
    # an asking member goes to all columns of its row, every member to all rows of its column
    asking = labelled.filter("asks").withColumn("row", row).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = labelled.withColumn("column", column).withColumn("row", every).filter(~F.col("asks") | (row != F.col("row")))
    names = ["component", "row", "column", "set_key", "text"]
    grid = asking.select(*names, F.lit(True).alias("asks")).union(asked.select(*names, F.lit(False).alias("asks")))
    return links.union(store.written(grid.groupBy("component", "row", "column").applyInArrow(verifier(percent, rest=True), "u long, v long"), "pairs"))


def classified(docs: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, n_shingles, keeper (the first row of the component by doc_id, nulls last) for every row."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    features = store.written(featured(base, signature_length(percent)), "features")
    groups = components(candidates(features, bands_for(percent)))
    nodes = groups.select(F.col("node").alias("set_key"), F.col("least").alias("component"))
    nodes = nodes.union(groups.select(F.col("least").alias("set_key"), F.col("least").alias("component"))).distinct()

    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = store.written(features.filter("n_shingles > 0").groupBy("set_key").agg(F.min(row).alias("first")), "classes")
    chosen = classes.join(nodes, "set_key").select("set_key", "component", F.col("first.doc_id").alias("at_id"), F.col("first.text_key").alias("at_key"))
    texts = base.join(chosen, base["doc_id"].eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")))
    members = texts.select("component", "set_key", "text").dropDuplicates(["set_key"])
    joined = components(verified(store.written(members, "members"), percent))

    classes = classes.join(joined, classes["set_key"] == joined["node"], "left").withColumn("least", F.coalesce("least", "set_key"))
    keepers = classes.groupBy("least").agg(F.min("first").alias("keeper"))
    keepers = classes.select("set_key", "least").join(keepers, "least").select("set_key", "keeper")
    found = features.select("doc_id", "text_key", "n_shingles", "set_key").join(keepers, "set_key", "left")
    return found.select("doc_id", "text_key", "n_shingles", F.coalesce("keeper", row).alias("keeper"))


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Rows are linked if 100 x intersection >= percent x union of their shingle sets; component_id is the smallest doc_id
    reachable. Null, empty and wordless texts are linked with nothing and are kept. Repeated rows share one component. Rows
    without a doc_id take part; a component of such rows only has a null component_id. `kept` is whether doc_id and
    component_id are the same, nulls included. Other columns are ignored; an empty table gives an empty result.
    """
    found = classified(docs, percent, doc_id, text)
    component = F.col("keeper.doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest doc_id. Wordless rows stay, repeated ones once."""
    found = classified(docs, percent, doc_id, text)
    firsts = found.filter(F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.text_key") == F.col("text_key")))
    firsts = firsts.select(F.col("doc_id").alias("at_id"), F.col("text_key").alias("at_key")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    same = keyed["id"].eqNullSafe(firsts["at_id"]) & (keyed["key"] == firsts["at_key"])
    return keyed.join(firsts, same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.table(spark, sf_dir, "documents"), percent=85)


ORACLE = r"""
with recursive docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w
    from documents
),
shingles as (
    select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from docs where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * common >= 85 * (x.n + y.n - common)),
reach as (select doc_id, doc_id as other from docs union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, min(r.other) as component_id, d.doc_id = min(r.other) as kept
from docs d join reach r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id
group by d.doc_id, s.n
"""
