"""Repair of conversations by cheapest edits (operator 12): bidirectional Dijkstra over the edit lattice.

A repaired conversation has role initials `(s?(ua)+)?`. A node of the lattice is how many rows are used up and which state the
pattern is in; edges keep, rerole or delete a row, or insert an empty one. A search from the start and one from the end advance by
cost, and stop once their fronts cost more together than the best path. Every equal-cost crossing is then known from both sides, and
the one whose two audits read least in ASCII is taken. Two equally cheap audits to one node are never the beginning of
one another (the rest would be insertions, which cost), so each side may keep the least audit of a node.

Faults and repeated rows are found by Spark. A conversation is read in order, a segment of rows at a time: for a long one, each
segment is solved from each state to each, and only the best history of each state is carried on, with the running hash of its
rows, so that no conversation is ever held whole. What the histories share is settled and dropped. All rows of one conversation pass
through one task, as a hash over them in order asks for; the sorts before it spill.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.llm import store
from stratapanel.llm.periodic_runs import CRC32

#: States: nothing yet, after s, after u, after a. A conversation may end in ENDS.
ENDS = (0, 3)
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state that a reroled or inserted row leads to, and its role.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
GONE = "-"
SEGMENT = 256
WHITE = "' \\t\\n\\u000b\\u000c\\r'"
LEGAL = {"su", "ua", "au"}
Node = tuple[int, int]
Path = tuple[int, str]


def onward(codes: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    """Edges from a node. A row's code is its role's initial (x: none of s, u, a), in capitals if truncated, or GONE."""
    i, state = node
    yield (i, NEXT[state]), INSERT, "I"
    if i < len(codes):
        yield (i + 1, state), DELETE, "D"
        if (code := codes[i]) != GONE:
            more = TRUNCATED if code.isupper() else 0
            yield (i + 1, NEXT[state]), REROLE + more, "R"
            if (state, code.lower()) in KEEPS:
                yield (i + 1, KEEPS[state, code.lower()]), KEEP + more, "K"


def backward(codes: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    """Edges into a node."""
    i, state = node
    near = [(i, s) for s in range(4) if NEXT[s] == state]
    if i:
        near += [(i - 1, s) for s in range(4)]
    for before in near:
        for after, cost, letter in onward(codes, before):
            if after == node:
                yield before, cost, letter


class Front:
    """One direction of the search. `step` is 1 or -1: of equal costs, nodes nearer the front's own end come first, as free edges lead on."""

    def __init__(self, codes: str, starts: list[Node], step: int):
        self.codes, self.step = codes, step
        self.best: dict[Node, Path] = {node: (0, "") for node in starts}
        self.settled: set[Node] = set()
        self.heap = [(0, step * i, s) for i, s in starts]
        heapq.heapify(self.heap)

    def least(self) -> float:
        return self.heap[0][0] if self.heap else float("inf")

    def advance(self, other: Front, total: float) -> float:
        """Settles the cheapest node; returns the cost of the cheapest path seen so far."""
        cost, i, state = heapq.heappop(self.heap)
        node = (self.step * i, state)
        if node in self.settled:
            return total
        self.settled.add(node)
        audit = self.best[node][1]
        for near, edge, letter in (onward if self.step == 1 else backward)(self.codes, node):
            path = (cost + edge, audit + letter if self.step == 1 else letter + audit)
            known = self.best.get(near)
            if known is None or path < known:
                self.best[near] = path
                if known is None or path[0] < known[0]:
                    heapq.heappush(self.heap, (path[0], self.step * near[0], near[1]))
            if near in other.best:
                total = min(total, path[0] + other.best[near][0])
        return total


@lru_cache(maxsize=1 << 15)
def cheapest(codes: str, entry: int, goals: tuple[int, ...]) -> Path | None:
    """Cost and audit of the cheapest edits from a state before the rows to one of the goals after them; the least audit of equal ones."""
    ahead, back = Front(codes, [(0, entry)], 1), Front(codes, [(len(codes), s) for s in goals], -1)
    total = 0.0 if not codes and entry in goals else float("inf")
    while ahead.least() + back.least() <= total and (ahead.heap or back.heap):
        total = ahead.advance(back, total) if ahead.least() <= back.least() else back.advance(ahead, total)
    crossings = [ahead.best[n] for n in ahead.settled if n[0] == len(codes) and n[1] in goals]
    crossings += [back.best[n] for n in back.settled if n == (0, entry)]
    for node in ahead.settled:
        cost, audit = ahead.best[node]
        for near, edge, letter in onward(codes, node):
            if near in back.settled:
                rest, suffix = back.best[near]
                if cost + edge + rest == total:
                    crossings.append((total, audit + letter + suffix))
    return min(crossings, default=None)


def repaired(audit: str, state: int, codes: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Role and text of the rows that an audit leaves."""
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append((ROLE[state], ""))
            continue
        if letter == "K":
            state = KEEPS[state, codes[i].lower()]
            out.append(rows[i])
        elif letter == "R":
            state = NEXT[state]
            out.append((ROLE[state], rows[i][1]))
        i += 1
    return out


def reads_less(one: list[str], two: list[str]) -> bool:
    """Whether the joined parts of `one` come before those of `two`; looks no further than the first difference."""
    x, y = chain.from_iterable(one), chain.from_iterable(two)
    for a in x:
        b = next(y, "")
        if a != b:
            return a < b
    return next(y, "") != ""


class History:
    """The cheapest edits up to a state: cost, audit in parts, running hash of the rows left."""

    def __init__(self) -> None:
        self.cost, self.parts, self.hash, self.empty = 0, [], hashlib.sha256(), True

    def copy(self) -> History:
        twin = History.__new__(History)
        twin.cost, twin.parts, twin.hash, twin.empty = self.cost, list(self.parts), self.hash.copy(), self.empty
        return twin

    def extend(self, path: Path, state: int, codes: str, rows: list[tuple[str, str]]) -> None:
        self.cost += path[0]
        self.parts.append(path[1])
        if left := repaired(path[1], state, codes, rows):
            self.hash.update(("" if self.empty else "\n").encode() + "\n".join(f"{r}:{t}" for r, t in left).encode())
            self.empty = False


class Conversation:
    """One conversation, row by row in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.histories = {0: History()}
        self.settled: list[str] = []
        self.codes: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, role: str, text: str, fault: str, code: str) -> None:
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        if turn is not None and (self.last is None or turn != self.last):
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        self.codes.append(code)
        self.rows.append((role, text))
        if len(self.codes) == SEGMENT:
            self.fold([(s,) for s in range(4)])

    def fold(self, goals: list[tuple[int, ...]]) -> None:
        """Takes the best history to each goal through the rows held."""
        codes, rows = "".join(self.codes), self.rows
        chosen: dict[int, tuple[int, Path]] = {}
        for goal in goals:
            for entry, history in self.histories.items():
                path = cheapest(codes, entry, goal)
                if path is None:
                    continue
                held = chosen.get(goal[0])
                cost = history.cost + path[0]
                if held is not None:
                    other = self.histories[held[0]]
                    rival = other.cost + held[1][0]
                    if rival < cost or rival == cost and not reads_less([*history.parts, path[1]], [*other.parts, held[1][1]]):
                        continue
                chosen[goal[0]] = (entry, path)
        used = [entry for entry, _ in chosen.values()]
        if len(set(used)) == 1:
            self.settled += self.histories[used[0]].parts
            self.histories[used[0]].parts = []
        after = {}
        for n, (goal, (entry, path)) in enumerate(chosen.items(), 1):
            history = self.histories[entry] if entry not in used[n:] else self.histories[entry].copy()
            after[goal] = (history, path, entry)
        for history, path, entry in after.values():
            history.extend(path, entry, codes, rows)
        self.histories = {goal: history for goal, (history, _, _) in after.items()}
        self.codes, self.rows = [], []

    def result(self) -> dict:
        self.fold([ENDS])
        history = self.histories[ENDS[0]]
        gaps = self.last - self.first + 1 - self.turns if self.first is not None else 0
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": history.cost, "audit": "".join(self.settled + history.parts), "repaired_sha256": history.hash.hexdigest(),
        }


RESULT = {"conv_id": pa.int64(), **{c: pa.int64() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, "audit": pa.string(), "repaired_sha256": pa.string()}
RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order in, a row for each conversation out. Of a row without a code only the conversation counts."""
    now: Conversation | None = None
    for batch in batches:
        done = []
        for conv_id, turn, role, text, fault, code in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = Conversation(conv_id)
            if code is not None:
                now.add(turn, role, text, fault, code)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(RESULT))
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema=pa.schema(RESULT))


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, code, all rows of a conversation in one partition and in order.

    Rows: conv_id, turn, role, text, there (false: only the conversation's name counts). The first fault of a row counts: blank,
    duplicate (role and text seen earlier in the conversation), truncated (does not end in . ! or ?)."""
    seen = Window.partitionBy("conv_id", "there", "role", "text").orderBy("turn")
    last = f"right(trim(TRAILING {WHITE} FROM text), 1)"
    fault = f"case when not there then null when {last} = '' then 'blank' when seen > 1 then 'duplicate' when {last} not in ('.', '!', '?') then 'truncated' end"
    initial = "if(left(role, 1) in ('s', 'u', 'a'), left(role, 1), 'x')"
    code = f"case when not there then null when fault in ('blank', 'duplicate') then '{GONE}' when fault = 'truncated' then upper({initial}) else {initial} end"
    dealt = rows.repartition("conv_id").withColumn("seen", F.row_number().over(seen)).withColumn("fault", F.expr(fault))
    dealt = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")
    return dealt.select("conv_id", "turn", "role", "text", "fault", F.expr(code).alias("code"))


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, nulls of the texts as one space."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts, F.lit(True).alias("there"))


def audits(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `rows` (as `plain` gives them): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    the SHA-256 of the repaired rows.

    A conversation is read by turn, nulls first; rows of one turn by role, then text, so that repeated rows stand side by side and all
    but the first are duplicates. Rows without a conv_id are one conversation. A conversation without rows that are there has zeros, an
    empty audit and the hash of nothing. Texts and conversations may be of any length. An empty table gives an empty result.
    """
    return judged(rows).mapInArrow(solved, RESULT_DDL)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), role, text. Further columns are ignored, whatever their names; a conversation of which
    no row is left has no row here."""
    rows = plain(conversations)
    told = audits(rows).select("conv_id", F.posexplode(F.expr("split(audit, '')")).alias("at", "edit")).filter("edit <> ''")
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edits = told.withColumn("i", F.sum(F.expr("cast(edit <> 'I' as int)")).over(before)).withColumn("place", F.sum(F.expr("cast(edit <> 'D' as int)")).over(before) - 1)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    numbered = rows.select(F.col("conv_id").alias("of"), "role", "text", F.row_number().over(order).alias("number"))
    joined = edits.filter("edit <> 'D'").join(numbered, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("i") == F.col("number")) & (F.col("edit") != "I"), "left")
    # the pattern leaves no choice of role: u and a take turns, after an s if the first row left is a kept one
    opens = F.max(F.expr("cast(place = 0 and edit = 'K' and left(role, 1) = 's' as int)")).over(Window.partitionBy("conv_id"))
    joined = joined.withColumn("opens", opens)
    role = F.expr("if(edit = 'K', role, if((place - opens) % 2 = 0, 'user', 'assistant'))")
    return joined.select("conv_id", "place", role.alias("role"), F.expr("if(edit = 'I', '', text)").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that a crc32 of conversation and turn deals out: dropped, emptied, without . ! ?, repeated, or of role user."""
    rows = plain(conversations)
    kind = "crc32(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))) % 20"
    rows = rows.withColumn("kind", F.expr(kind)).withColumn("copy", F.explode(F.expr("sequence(1, if(kind = 3, 2, 1))")))
    text = F.expr("case kind when 0 then '' when 1 then '' when 2 then translate(text, '.!?', '') else text end")
    return rows.select("conv_id", "turn", F.expr("if(kind = 4, 'user', role)").alias("role"), text.alias("text"), F.expr("kind <> 0").alias("there"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(damaged(store.table(spark, sf_dir, "conversations")))


def _more(path: str, cost: int | str, letters: str) -> str:
    """SQL of a path (nine digits of cost, then the audit) with an edit more."""
    return f"lpad(cast(cast(left({path}, 9) as bigint) + {cost} as varchar), 9, '0') || substr({path}, 10) || '{letters}'"


def _inserted(path: str) -> str:
    """SQL of the four states' best paths, insertions included."""
    at = [f"{path}[{s}]" for s in range(1, 5)]
    one, two = [_more(x, INSERT, "I") for x in at], [_more(x, 2 * INSERT, "II") for x in at]
    return f"[{at[0]}, {at[1]}, least({at[2]}, {one[0]}, {one[1]}, {one[3]}), least({at[3]}, {one[2]}, {two[0]}, {two[1]})]"


def _used(path: str, row: str) -> str:
    """SQL of the four states' best paths once a row is used up."""
    code, at = f"{row}[1]", [f"{path}[{s}]" for s in range(1, 5)]
    more = f"case when {code} between 'A' and 'Z' then {TRUNCATED} else 0 end"
    gone = [_more(x, DELETE, "D") for x in at]
    rerole = [f"case when {code} <> '{GONE}' then {_more(x, f'{REROLE} + {more}', 'R')} end" for x in at]

    def keep(kind: str, state: int) -> str:
        return f"case when lower({code}) = '{kind}' then {_more(at[state], f'{KEEP} + {more}', 'K')} end"

    return (
        f"[{gone[0]}, least({gone[1]}, {keep('s', 0)}), least({gone[2]}, {rerole[0]}, {rerole[1]}, {rerole[3]}, {keep('u', 0)}, {keep('u', 1)}, {keep('u', 3)}), "
        f"least({gone[3]}, {rerole[2]}, {keep('a', 2)})]"
    )


ORACLE = rf"""
with given as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {CRC32.format("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind
    from conversations
),
rows as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, copy
    from (select *, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from given where kind <> 0)
),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
        row_number() over (partition by conv_id, role, text order by turn nulls first) as seen,
        regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as last
    from rows
),
judged as (
    select *, case when last = '' then 'blank' when i > min(i) over (partition by conv_id, role, text) then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end as fault,
        case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as initial,
        lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
    from placed
),
counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (pair not in ('su', 'ua', 'au')) as illegal,
        list(case when fault in ('blank', 'duplicate') then '{GONE}' when fault = 'truncated' then upper(initial) else initial end order by i) as codes
    from judged group by conv_id
),
paths as (
    select *, list_reduce(list_prepend({_inserted("['000000000', null, null, null]")}, list_transform(codes, lambda c: [c, null, null, null])),
        lambda p, c: list_transform([{_used("p", "c")}], lambda q: {_inserted("q")})[1]) as p
    from counted
),
chosen as (select *, least(p[1], p[4]) as path from paths),
audits as (select * exclude (path), cast(left(path, 9) as bigint) as cost, substr(path, 10) as audit from chosen),
edits as (
    select conv_id, spot, edit, count(*) filter (edit <> 'I') over w as i, count(*) filter (edit <> 'D') over w - 1 as place
    from (select conv_id, unnest(string_split(audit, '')) as edit, unnest(range(len(audit))) as spot from audits where audit <> '') window w as (partition by conv_id order by spot)
),
left_over as (
    select e.conv_id, e.edit, e.place, r.role, r.text, max(case when e.place = 0 and e.edit = 'K' and left(r.role, 1) = 's' then 1 else 0 end) over (partition by e.conv_id) as opens
    from edits e left join judged r on r.conv_id is not distinct from e.conv_id and r.i = e.i and e.edit <> 'I' where e.edit <> 'D'
),
said as (
    select conv_id, string_agg(case when edit = 'K' then role when (place - opens) % 2 = 0 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by place) as text
    from left_over group by conv_id
),
every as (select distinct conv_id from given)
select e.conv_id, cast(coalesce(a.gaps, 0) as bigint) as gaps, cast(coalesce(a.blank, 0) as bigint) as blank, cast(coalesce(a.duplicate, 0) as bigint) as duplicate,
    cast(coalesce(a.truncated, 0) as bigint) as truncated, cast(coalesce(a.illegal, 0) as bigint) as illegal, cast(coalesce(a.cost, 0) as bigint) as cost,
    coalesce(a.audit, '') as audit, sha256(coalesce(s.text, '')) as repaired_sha256
from every e left join audits a on a.conv_id is not distinct from e.conv_id left join said s on s.conv_id is not distinct from e.conv_id
"""
