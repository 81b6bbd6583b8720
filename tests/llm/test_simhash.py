"""Fingerprints bit by bit, BK-trees and links against all pairs, on random values, awkward rows and the given documents."""

import random
from collections import defaultdict

import text_cases as cases
import xxhash

from stratapanel.llm import simhash


def brute_fingerprint(text):
    w = cases.words(text, fold=True)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    values, label = sorted(set(values)), {}
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    for v in values:
        label[v] = root(v)
    return label


def brute(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    ids = defaultdict(list)
    for (key, _), value in zip(rows, prints, strict=True):
        ids[label[value]].append(key)
    least = {c: min((k for k in keys if k is not None), default=None) for c, keys in ids.items()}
    return sorted(((key, f"{value:016x}", least[label[value]]) for (key, _), value in zip(rows, prints, strict=True)), key=repr)


def flipped(rng, value, n):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


def clusters(rng, centres, each):
    found = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        found |= {centre} | {flipped(rng, centre, rng.randint(1, 5)) for _ in range(each)}
    return sorted(found)


def grouped(links, values):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        assert (u ^ v).bit_count() <= 3
        parent[root(u)] = root(v)
    by = defaultdict(set)
    for v in values:
        by[root(v)].add(v)
    return sorted(map(sorted, by.values()))


def expected(values):
    by = defaultdict(set)
    for v, c in brute_components(values).items():
        by[c].add(v)
    return sorted(map(sorted, by.values()))


def test_spark_hash_of_a_string_is_the_same(spark):
    got = spark.sql("select xxhash64('to be or') as h").first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"to be or", 42)


def test_fingerprints_bit_by_bit_and_over_pieces(monkeypatch):
    texts = [t.encode() for t in ("", " ", "A", "a b", "A b C", "é É 日 a B", cases.PROSE, "x y " * 700, cases.long_text(900, 5))]
    want = [brute_fingerprint(t.decode()) for t in texts]
    assert simhash.fingerprints_of(texts).tolist() == want
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprints_of(texts).tolist() == want


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(2)
    values = clusters(rng, 30, 12)
    rng.shuffle(values)
    tree = simhash.Tree()
    for v in values:
        assert tree.add(v) == len(tree.values) - 1
    for query in values[::7] + [rng.getrandbits(64) for _ in range(20)]:
        for radius in (0, 3, 10, 64):
            assert sorted(tree.near(query, radius)) == [i for i, v in enumerate(values) if (v ^ query).bit_count() <= radius]
    links = simhash.linked(values)
    assert len(links) < len(values) and grouped(links, values) == expected(values)


def test_large_shards_are_dealt_again(spark, monkeypatch):
    rng = random.Random(4)
    values = clusters(rng, 12, 25) + [v & ~0xFFFF for v in clusters(rng, 8, 25)] + [1 << b for b in range(64)] + [0]
    values = sorted(set(values))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    for most in (4096, 40, 2):
        monkeypatch.setattr(simhash, "MOST", most)
        monkeypatch.setattr(simhash, "TASK_ROWS", 200)
        found = [(u % 2**64, v % 2**64) for u, v in simhash.links(spark.createDataFrame(signed, "fingerprint long")).collect()]
        assert grouped(found, values) == expected(values)


def test_rows_of_awkward_tables(spark):
    docs = cases.edge_docs(spark)
    extra = docs.select("*", *(docs["source"].alias(c) for c in ("fingerprint", "key", "rest", "first", "least", "node", "component_id")))
    got = sorted((tuple(r) for r in simhash.near_duplicates(extra).collect()), key=repr)
    assert got == brute(cases.rows_of(docs))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    renamed = docs.withColumnsRenamed({"doc_id": "k", "text": "t"})
    assert sorted((tuple(r) for r in simhash.near_duplicates(renamed, "k", "t").collect()), key=repr) == got


def test_rows_without_any_id_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "q r s"), (7, "q r s"), (9, None), (8, " ")]
    got = sorted((tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_query_against_all_pairs(spark):
    got = sorted((tuple(r) for r in simhash.op11_simhash(spark, cases.SF).collect()), key=repr)
    assert got == brute(cases.rows_of(cases.given_docs(spark)))
    assert any(key != least for key, _, least in got)
