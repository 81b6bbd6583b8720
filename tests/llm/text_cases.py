"""Small tables for the text operators, and plain Python versions of what they must return."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use on their way.
CLASHES = ("chunk", "bucket", "set_key", "text_key", "component", "key", "id", "row", "spans", "m_email", "reach", "heads", "ends", "u", "v", "kept", "rank")

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank and say nothing at all about it"


def long_text(n: int, seed: int) -> str:
    """Prose-like words without repeats."""
    return " ".join(hashlib.sha256(f"{seed}-{i}".encode()).hexdigest()[: 3 + i % 7] for i in range(n))


def edge_rows() -> list[tuple]:
    texts = [
        None, "", " \t\n ", "a", "Hello", "one two three", PROSE, PROSE, PROSE.upper(), PROSE.replace("owls", "cats"), long_text(30_000, 1), long_text(400, 2),
        long_text(400, 2) + " tail", "x" * 50_000, "spam " * 300, PROSE + "\n" + long_text(60, 3), long_text(60, 3) + "\n" + PROSE, "é ñ ß 日本 語\u00a0x 😀",
        "mail a.b@example.org or +1 (499) 555-6503, card 4111 1111 1111 1111, ip 10.0.0.1, iban GB82 WEST 1234 5698 7654 32",
    ]
    rows = [(i, t, ("en", None, "fr")[i % 3], None if i % 4 == 0 else "s", None) for i, t in enumerate(texts)]
    return [*rows, (None, "no id here " + long_text(40, 4), "en", "s", 1), (None, None, None, None, None), rows[11], rows[11]]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def given_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(docs) -> list[tuple[int | None, str]]:
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


def words(text: str | None, fold: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if fold else raw)


def brute_removal(rows, k=35):
    split = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for (key, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k=5):
    w = words(text, fold=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute_components(rows, percent):
    """For each row, its set size and the places of its component."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    return [(len(sets[i]), members[root(i)]) for i in range(len(rows))]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def brute_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def brute_measures(text):
    w = words(text)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    repeat = len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)})
    seen, dup = set(), 0
    for line in (text or "").encode().split(b"\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, repeat, len(w) < 10 or 100 * repeat > 20 * len(w)


def held_out(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == 1


def brute_base_scores(rows):
    counts: Counter = Counter()
    for key, text in rows:
        if not held_out(key, 5):
            counts.update([*words(text, fold=True), b"\n"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for key, text in rows:
        tokens = [*words(text, fold=True), b"\n"]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out.append((key, held_out(key, 5), len(tokens), sum(counts[t] > 0 for t in tokens), n, base))
    return out


def brute_tree_scores(rows, depth, short, least, beyond, weight):
    """log10 probability of each row's text under a suffix tree that is kept in a dictionary."""
    counts: dict[bytes, Counter] = defaultdict(Counter)

    def spelled(text):
        return b"\n" * depth + b" ".join([*words(text, fold=True), b""]) + b"\n"

    for key, text in rows:
        if not held_out(key, 5):
            s = spelled(text)
            for i in range(depth, len(s)):
                for k in range(depth + 1):
                    counts[s[i - k : i]][s[i]] += 1
    total = {c: sum(f.values()) for c, f in counts.items()}
    kept = {b""}
    for c, f in counts.items():
        if c:
            wide = counts[c[1:]]
            gain = sum(n * math.log(n * total[c[1:]] / (total[c] * wide[x])) for x, n in f.items())
            free = len(wide) - 1
            # the quantile of chi-square by Wilson and Hilferty
            if total[c] < least or not free or 2 * gain < free * (1 - 2 / (9 * free) + beyond * math.sqrt(2 / (9 * free))) ** 3:
                continue
        kept |= {c} | {c[j:] for j in range(len(c) - short)}

    def p(context, symbol):
        if context and context not in kept:
            return p(context[1:], symbol)
        wider = p(context[1:], symbol) if context else 1 / 256
        return (counts[context][symbol] + weight * wider) / (total.get(context, 0) + weight) if context in counts else wider

    return [sum(math.log10(p(s[i - depth : i], s[i])) for i in range(depth, len(s))) for s in (spelled(text) for _, text in rows)]
