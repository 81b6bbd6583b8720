"""Periodic runs against a plain search of every period, on random words, awkward rows and the given documents."""

import hashlib
import random
import zlib

import text_cases as cases

from stratapanel.llm import periodic_runs
from stratapanel.llm.words import Words


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start = i - q
            if j - start >= max(6, 4 * q) and j > i and not any(all(w[k] == w[k - p] for k in range(start + p, j)) for p in range(1, q)):
                found.append((start, j - start, q))
            i = j + 1
    return sorted(found)


def brute_kept(w, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rng):
    letters, w = "abcdefghij"[: rng.choice([1, 2, 3, 10])], []
    for _ in range(rng.randint(0, 6)):
        block = [rng.choice(letters) for _ in range(rng.randint(1, 25))]
        w += block * rng.randint(1, 7) + block[: rng.randint(0, len(block))]
    return w


def test_runs_of_random_words_side_by_side():
    rng = random.Random(1)
    for _ in range(200):
        texts = [" ".join(random_words(rng)).encode() for _ in range(rng.randint(1, 8))]
        held = Words(texts)
        found = periodic_runs.runs_of(held.hash, held.first)
        for i, text in enumerate(texts):
            assert found.get(i, []) == brute_runs(text.split()), text


def test_runs_within_runs_and_overlaps():
    inner = "a a a a a a b ".encode() * 5
    assert brute_runs(inner.split())[:2] == [(0, 6, 1), (0, 35, 7)]
    held = Words([inner, b"a b a b a b a b b b b b b b"])
    found = periodic_runs.runs_of(held.hash, held.first)
    assert found[0] == brute_runs(inner.split()) and found[1] == brute_runs(b"a b a b a b a b b b b b b b".split()) == [(0, 8, 2), (7, 7, 1)]


def test_one_word_repeated_throughout_takes_no_square():
    held = Words([b"a " * 300_000])
    assert periodic_runs.runs_of(held.hash, held.first) == {0: [(0, 300_000, 1)]}


def test_collapsed_keeps_the_first_period():
    assert periodic_runs.collapsed(b"x a b a b a b a b y".split(), [(1, 8, 2)]) == b"x a b y"


def test_rows_of_awkward_tables(spark):
    docs = cases.edge_docs(spark)
    got = periodic_runs.find(docs.select("*", *(docs["source"].alias(c) for c in ("runs", "collapsed", "w", "n", "a", "p", "g")))).collect()
    want = []
    for key, text in cases.rows_of(docs):
        w = cases.words(text)
        runs = brute_runs(w) if len(w) < 1000 else []
        want.append((key, len(w), runs, brute_kept(w, runs).decode()))
    assert sorted([(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got], key=repr) == sorted(want, key=repr)
    assert periodic_runs.find(docs.limit(0)).count() == 0
    renamed = docs.withColumnsRenamed({"doc_id": "k", "text": "t"})
    assert periodic_runs.find(renamed, "k", "t").count() == docs.count()


def test_query_against_plain_python(spark):
    found = {r["doc_id"]: r for r in periodic_runs.op13_periodic_runs(spark, cases.SF).collect()}
    rows = cases.rows_of(cases.given_docs(spark))
    assert len(found) == len(rows)
    changed = 0
    for key, text in rows:
        w, h = cases.words(text), zlib.crc32(str(key).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
            changed += 1
        if n > 2500:
            continue
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want = (key, len(runs), *first, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(brute_kept(w, runs)).hexdigest())
        assert tuple(found[key]) == want
    assert changed > 5


def test_no_words_and_no_id(spark):
    rows = spark.createDataFrame([(None, "a b"), (2, None), (3, " \n")], "doc_id long, text string")
    assert {r[0]: r[1] for r in periodic_runs.with_planted_runs(rows).collect()}[None] == "a b"
    assert all(r["runs"] == [] for r in periodic_runs.find(rows).collect())
