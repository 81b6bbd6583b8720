"""Cheapest edits against a plain table over rows and states, on random codes, long conversations and awkward rows."""

import hashlib
import random
import zlib

import pytest
import text_cases as cases

from stratapanel.llm import conversation_repair as repair

WHITE = " \t\n\x0b\x0c\r"


def brute(codes, state=0, ends=repair.ENDS):
    """Least (cost, audit), from the end backwards; three insertions in a row are more than any path needs."""
    after = {s: (0, "") if s in ends else None for s in range(4)}

    def best(options):
        return min((o for o in options if o is not None), default=None)

    def add(path, cost, letter):
        return path and (path[0] + cost, letter + path[1])

    def inserting(now):
        for _ in range(3):
            now = {s: best([now[s], add(now[repair.NEXT[s]], 2, "I")]) for s in range(4)}
        return now

    after = inserting(after)
    for code in reversed(codes):
        now = {}
        for s in range(4):
            options = [add(after[s], 3, "D")]
            if code != "-":
                cut = code != code.lower()
                options.append(add(after[repair.NEXT[s]], 2 + cut, "R"))
                if (s, code.lower()) in repair.KEEPS:
                    options.append(add(after[repair.KEEPS[s, code.lower()]], cut, "K"))
            now[s] = best(options)
        after = inserting(now)
    return after[state]


def brute_conversation(rows):
    """rows: (turn, role, text) as they are; nulls only among turns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, codes, faults, illegal = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}, 0
    for i, (_, role, text) in enumerate(rows):
        code = role[:1] if role[:1] in "sua" and role else "x"
        fault = None
        if not text.strip(WHITE):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(WHITE)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        codes.append({"blank": "-", "duplicate": "-", "truncated": code.upper(), None: code}[fault])
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = brute("".join(codes))
    left = repair.repaired(audit, 0, "".join(codes), [(r, t) for _, r, t in rows])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


def test_cheapest_edits_of_random_codes():
    rng = random.Random(3)
    for _ in range(1500):
        codes = "".join(rng.choice(rng.choice(["suaxSUAX-", "ua", "uaUA-", "-", "xX"])) for _ in range(rng.randint(0, 9)))
        assert repair.cheapest(codes, 0, repair.ENDS) == brute(codes), codes
        entry, goal = rng.randrange(4), rng.randrange(4)
        assert repair.cheapest(codes, entry, (goal,)) == brute(codes, entry, (goal,)), (codes, entry, goal)


def test_audits_of_the_contract():
    assert repair.cheapest("sua", 0, repair.ENDS) == (0, "KKK")
    assert repair.cheapest("s", 0, repair.ENDS) == (3, "D")
    assert repair.cheapest("u", 0, repair.ENDS) == (2, "KI")
    assert repair.cheapest("a", 0, repair.ENDS) == (2, "IK")
    assert repair.cheapest("uua", 0, repair.ENDS) == (2, "KIKK")
    assert repair.cheapest("", 0, repair.ENDS) == (0, "")


@pytest.mark.parametrize("letters", ["ua", "uaUA-sx", "-", "x", "u"])
def test_segments_fold_to_the_whole(letters, monkeypatch):
    rng = random.Random(letters)
    monkeypatch.setattr(repair, "SEGMENT", 7)
    for n in (1, 6, 7, 8, 14, 60, 300):
        codes = "".join(rng.choice(letters) for _ in range(n))
        rows = [("user", f"text {i}") for i in range(n)]
        held = repair.Conversation(1)
        for (role, text), code in zip(rows, codes, strict=True):
            held.add(0, role, text, "", code)
        got = held.result()
        cost, audit = brute(codes)
        assert (got["cost"], got["audit"]) == (cost, audit)
        left = repair.repaired(audit, 0, codes, rows)
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


def odd_rows():
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes"), (1, 2, "assistant", "Yes"), (1, 4, "user", " \t"), (1, 9, None, "Odd."),
        (2, None, "user", "A?"), (2, None, "assistant", "B!"), (2, None, "assistant", "B!"), (3, 0, "assistant", None), (4, 5, "", "No role."), (4, 6, "moderator", "x."),
        (None, 0, "user", "no conversation."), (None, None, None, None), (None, 1, "assistant", "é  "),
    ]
    return rows + [(7, i, ("user", "assistant")[i % 2], f"t{i % 40}." if i % 9 else "") for i in range(700)]


def want_of(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: brute_conversation(own) for conv, own in by.items()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_odd_rows_and_clashing_names(spark):
    given = spark.createDataFrame(odd_rows(), SCHEMA)
    extra = given.select("*", *(given["role"].alias(c) for c in ("there", "seen", "fault", "code", "at", "place", "i", "edit", "of", "opens")))
    got = {r[0]: tuple(r)[1:] for r in repair.audits(repair.plain(extra)).collect()}
    assert got == want_of(odd_rows())
    left = {}
    for r in repair.repair(extra).orderBy("conv_id", "place").collect():
        left.setdefault(r[0], []).append(f"{r[2]}:{r[3]}")
    assert all(hashlib.sha256("\n".join(left.get(conv, [])).encode()).hexdigest() == row[-1] for conv, row in got.items())
    assert repair.audits(repair.plain(given.limit(0))).count() == 0 and repair.repair(given.limit(0)).count() == 0


def test_query_against_plain_python(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt, every = [], {r[0] for r in given}
    for conv, turn, role, text in given:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        hurt += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv in every} | want_of(hurt)
    got = {r[0]: tuple(r)[1:] for r in repair.op12_conversation_repair(spark, cases.SF).collect()}
    assert got == want


def test_a_conversation_without_rows_keeps_its_name(spark):
    rows = spark.createDataFrame([(5, 0, "user", "", False), (5, 1, "user", "", False)], SCHEMA + ", there boolean")
    assert [tuple(r) for r in repair.audits(rows).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
