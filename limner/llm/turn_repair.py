"""Repair of conversations whose turns are lost, blank, repeated, cut off or given to the wrong role.

A repaired conversation is nothing at all, or a system turn if there is one, then user and assistant in alternation
with an assistant at the end. Four states suffice: at the start, after a system, user or assistant turn.
Each row is kept (0), given to the other role (2) or deleted (3; blank and duplicate rows have to be); empty turns
may be inserted (2); a truncated row that stays adds 1. The cheapest edits are found by divide and conquer: the costs of
reaching each state from the left and of leaving it to the right meet in the middle, the best crossing is fixed, and both
halves are solved alone, so that only two vectors of four costs are held at a time. Equal crossings are decided by the rank
of the left half's edits: as sequences of letters (``D``, ``I``, ``K``, ``R``) that end with the same row, none is the
beginning of another, so the smaller left half is the smaller whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.llm.conversations import LONG_CHARS, LONG_ROWS, by_conversation, ordered_conversations, record_batches
from limner.plans.staging import stage

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
SPACES = " \t\n\x0b\x0c\r"
#: state after the one role that may be inserted, or given, in each state
_NEXT = (USER, USER, ASSISTANT, USER)
#: state after a row that is kept, by its initial and the state before
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: turns to insert behind the last row
_CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_LEGAL = {"su", "ua", "au"}

#: ways from a state to a state over some rows: (from, to, cost, place among the ways of equal origin)
Moves = tuple[tuple[int, int, int, object], ...]


@lru_cache(None)
def row_moves(initial: str, must_go: bool, truncated: bool) -> Moves:
    """The cheapest and least edits of one row, with the insertions before it, for each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for origin in range(4):
        at, spent = origin, 0
        for inserted in range(3):
            ways = [(at, DELETE, "D")]
            if not must_go:
                ways.append((_NEXT[at], REROLE + truncated * TRUNCATED, "R"))
                if at in _KEPT.get(initial, {}):
                    ways.append((_KEPT[initial][at], truncated * TRUNCATED, "K"))
            for to, cost, letter in ways:
                new = spent + cost, "I" * inserted + letter
                best[origin, to] = min(best.get((origin, to), new), new)
            at, spent = _NEXT[at], spent + INSERT
    return tuple((a, b, cost, letters) for (a, b), (cost, letters) in sorted(best.items()))


def forward(moves: Sequence[Moves], origin: int) -> list[tuple[int, int] | None]:
    """For each state, the least cost of reaching it from ``origin`` and the rank of its least edits among all states."""
    at: list[tuple[int, int] | None] = [None] * 4
    at[origin] = (0, 0)
    for options in moves:
        new: list = [None] * 4
        for a, b, cost, letters in options:
            if at[a] is not None:
                way = at[a][0] + cost, at[a][1], letters
                if new[b] is None or way < new[b]:
                    new[b] = way
        order = sorted((x[1:], b) for b, x in enumerate(new) if x is not None)
        at = [None] * 4
        for rank, (_, b) in enumerate(order):
            at[b] = new[b][0], rank
    return at


def backward(moves: Sequence[Moves], goal: int) -> list[int | None]:
    """For each state, the least cost of reaching ``goal`` from it."""
    left: list[int | None] = [None] * 4
    left[goal] = 0
    for options in reversed(moves):
        new: list[int | None] = [None] * 4
        for a, b, cost, _ in options:
            if left[b] is not None and (new[a] is None or cost + left[b] < new[a]):
                new[a] = cost + left[b]
        left = new
    return left


def end_state(reached: Sequence[tuple[int, int] | None]) -> int:
    """Where to be behind the last row, so that closing the conversation is cheapest and its edits are the least."""
    return min((cost + INSERT * _CLOSING[q], rank, q) for q, (cost, rank) in ((q, x) for q, x in enumerate(reached) if x is not None))[2]


def crossings(moves: Sequence[Moves], origin: int, goal: int) -> list[int]:
    """The states before and after each row on the best way from ``origin`` to ``goal``."""
    states = [origin]
    todo = [(0, len(moves), origin, goal)]
    while todo:
        low, high, a, b = todo.pop()
        if high - low <= 1:
            if high > low:
                states.append(b)
            continue
        middle = (low + high) // 2
        reached, left = forward(moves[low:middle], a), backward(moves[middle:high], b)
        q = min((x[0] + y, x[1], q) for q, (x, y) in enumerate(zip(reached, left, strict=True)) if x is not None and y is not None)[2]
        todo += [(middle, high, q, b), (low, middle, a, q)]
    return states


def fault(text: str, seen: bool) -> str:
    """The first of blank, duplicate and truncated that holds, or an empty string."""
    text = text.strip(SPACES)
    return "blank" if not text else "duplicate" if seen else "truncated" if text[-1] not in ".!?" else ""


def _role_from(state: int) -> str:
    return "assistant" if state == USER else "user"


class _Rows:
    """Rows of a conversation, or of a piece of one, in order."""

    def __init__(self, rows: Iterator[dict]):
        self.rows: list[tuple[str, str]] = []
        self.moves: list[Moves] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.turns = 0, []
        self.ends: tuple[str | None, str | None] = (None, None)
        seen: set[tuple[str, str]] = set()
        for r in rows:
            if not r["present"]:
                continue
            role, text, turn = r["role"], r["text"], r["turn"]
            known = r["seen"] if "seen" in r else (role, r["digest"]) in seen
            seen.add((role, r["digest"]))
            kind = fault(text, known)
            self.counts[kind] += 1
            self.moves.append(row_moves(role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
            self.rows.append((role, text))
            if self.ends[1] is not None:
                self.illegal += self.ends[1] + role[:1] not in _LEGAL
            self.ends = (role[:1] if self.ends[0] is None else self.ends[0], role[:1])
            if turn is not None:
                if not self.turns:
                    self.turns = [turn, turn, 1]
                elif turn != self.turns[1]:
                    self.turns = [self.turns[0], turn, self.turns[2] + 1]

    def edited(self, origin: int, goal: int, last: bool) -> tuple[int, str, list[dict]]:
        """Cost, edits and repaired turns of the best way between two states, with the closing turns behind the last row."""
        states = crossings(self.moves, origin, goal)
        total, audit, turns = 0, [], []
        for (role, text), options, a, b in zip(self.rows, self.moves, states, states[1:], strict=False):
            cost, letters = next((c, x) for p, q, c, x in options if (p, q) == (a, b))
            total += cost
            audit.append(letters)
            for letter in letters:
                if letter == "K":
                    turns.append({"role": role, "text": text})
                elif letter != "D":
                    turns.append({"role": _role_from(a), "text": text if letter == "R" else ""})
                    a = _NEXT[a]
        if last:
            for _ in range(_CLOSING[goal]):
                total += INSERT
                audit.append("I")
                turns.append({"role": _role_from(goal), "text": ""})
                goal = _NEXT[goal]
        return total, "".join(audit), turns


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32())]
    + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost", "first_turn", "last_turn", "turns")]
    + [("first_role", pa.string()), ("last_role", pa.string()), ("audit", pa.string()), ("repaired", pa.list_(_TURN))]
)
_COLUMNS = (
    "conv_id long, part int, blank long, duplicate long, truncated long, illegal long, cost long, first_turn long, last_turn long, turns long, "
    "first_role string, last_role string, audit string, repaired array<struct<role:string,text:string>>"
)


def _repaired(conversations, ends: dict | None) -> Iterator[dict]:
    for key, own in conversations:
        rows = _Rows(own)
        origin, goal, last = (START, end_state(forward(rows.moves, START)), True) if ends is None else ends[key]
        cost, audit, turns = rows.edited(origin, goal, last)
        first_turn, last_turn, n_turns = rows.turns or (None, None, 0)
        counts = {k: rows.counts[k] for k in ("blank", "duplicate", "truncated")}
        span = {"first_turn": first_turn, "last_turn": last_turn, "turns": n_turns, "first_role": rows.ends[0], "last_role": rows.ends[1]}
        yield {"conv_id": key[0], "part": key[1] if ends is not None else 0, **counts, "illegal": rows.illegal, "cost": cost, **span, "audit": audit, "repaired": turns}


def _size(row: dict) -> int:
    return sum(len(t["text"]) + 16 for t in row["repaired"])


def _repair(ends: dict | None):
    def run(batches):
        conversations = by_conversation(batches) if ends is None else by_conversation(batches, "part")
        yield from record_batches(_repaired(conversations, ends), _REPAIRED, _size)

    return run


_WAYS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("ways", pa.list_(pa.list_(pa.int64())))])


def _ways(batches):
    """For each piece, cost and rank of the best way from each state to each."""

    def found():
        for (conv_id, part), own in by_conversation(batches, "part"):
            moves = _Rows(own).moves
            ways = [[a, b, *x] for a in range(4) for b, x in enumerate(forward(moves, a)) if x is not None]
            yield {"conv_id": conv_id, "part": part, "ways": ways}

    yield from record_batches(found(), _WAYS, lambda r: 1)


def repair_conversations(rows: DataFrame, present: str | None = None, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """Edits and repaired turns of the conversations of ``rows`` (``conv_id, turn, role, text``), one row or some pieces for each.

    ``conv_id, part, whole, blank, duplicate, truncated, illegal, cost, first_turn, last_turn, turns, first_role, last_role, audit, repaired``:
    faults by kind, adjacent initials out of order, costs, smallest, largest and number of distinct turns, initials of the first
    and last role, the edits' letters and the repaired turns. A conversation is ``whole`` in one row; only those beyond
    ``long_rows`` or ``long_chars`` are in pieces, in the order of ``part``, whose edits and turns follow one another.
    ``present`` names a boolean column: a row where it is false only tells that its conversation exists.

    A null role or text is one space; such a role and an empty one fit nowhere and are given up or deleted. A null turn comes
    first, rows of one turn go by role and the digest of the text, rows without a ``conv_id`` are one conversation.
    An empty table gives an empty one; other columns are ignored.
    """
    here = F.col(present) if present else F.lit(True)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), here.alias("present"))
    short, ranges = ordered_conversations(rows, long_rows, long_chars)
    out = short.mapInArrow(_repair(None), _COLUMNS).withColumn("whole", F.lit(True))
    return out if ranges is None else out.unionByName(_repair_long(ranges))


def _repair_long(ranges: DataFrame) -> DataFrame:
    """Conversations in ranges: each range gives its ways between the states, the crossings between ranges are chosen, then each is solved alone.

    The driver sees a row for each range and long conversation.
    """
    placed = stage(ranges.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "turn-ranges")
    firsts = placed.where("present").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    # every row has a place of its own, so the join has no hot key
    marked = placed.join(firsts, "place", "left").select("conv_id", "turn", "role", "text", "digest", "present", F.col("first").isNull().alias("seen"), "part", "place")
    marked = stage(marked, "turn-faults")
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionById(parts, "part").sortWithinPartitions("part", "place").drop("place")
    pieces: dict[int | None, list[tuple[int, Moves]]] = {}
    for r in dealt.mapInArrow(_ways, "conv_id long, part int, ways array<array<long>>").collect():
        pieces.setdefault(r.conv_id, []).append((r.part, tuple(map(tuple, r.ways))))
    ends = {}
    for conv_id, own in pieces.items():
        own.sort()
        moves = [x for _, x in own]
        states = crossings(moves, START, end_state(forward(moves, START)))
        for k, (part, _) in enumerate(own):
            ends[conv_id, part] = (states[k], states[k + 1], k + 1 == len(own))
    return dealt.mapInArrow(_repair(ends), _COLUMNS).withColumn("whole", F.lit(False))


_REPORT = pa.schema(
    [("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_REPORTED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reported(batches):
    def found():
        for (conv_id,), own in by_conversation(batches):
            sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            digest, audit, first, last, role, distinct, begun = hashlib.sha256(), [], None, None, None, 0, False
            for r in own:
                for k in sums:
                    sums[k] += r[k]
                if r["first_role"] is not None:
                    sums["illegal"] += role is not None and role + r["first_role"] not in _LEGAL
                    role = r["last_role"]
                if r["first_turn"] is not None:
                    distinct += r["turns"] - (last == r["first_turn"])
                    first, last = r["first_turn"] if first is None else first, r["last_turn"]
                audit.append(r["audit"])
                for turn in r["repaired"]:
                    digest.update(f"{chr(10) if begun else ''}{turn['role']}:{turn['text']}".encode())
                    begun = True
            gaps = last - first + 1 - distinct if first is not None else 0
            yield {"conv_id": conv_id, "gaps": gaps, **sums, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from record_batches(found(), _REPORT, lambda r: len(r["audit"]))


def repair_report(repaired: DataFrame) -> DataFrame:
    """Per conversation, faults, cost, edits and the digest of the repaired turns (``role:text``, joined by newlines).

    Whole conversations are digested where they lie; the pieces of others are streamed in order, one in memory at a
    time, through one task for each conversation.
    """
    line = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    one = repaired.where("whole").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(line, 256).alias("repaired_sha256"))
    more = repaired.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return one.unionByName(more.mapInArrow(_reported, _REPORTED))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20, nulls being one space, and ``present``, false for lost rows.

    0 loses the row, 1 empties its text, 2 takes full stops, exclamation and question marks from it, 3 repeats it, 4 gives it to the user.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    present = F.explode(F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), present.alias("present"))
