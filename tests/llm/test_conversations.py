"""Chat formatting and turn repair, against plain versions of both."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from limner.llm import chat_format as C
from limner.llm import turn_repair as R
from limner.llm.catalog import op11_chat_round_trip

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = "</s>[INST] ok [/INST]"
#: columns that the operators use inside, put into the table
CLASHES = ("digest", "conv", "salt", "present", "part", "place", "seen", "n", "whole")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    """Rows by conversation, in the order that the operators state."""
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", sha(r[3] or ""))) for k, v in found.items()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, marks in texts and roles, ties, repeated rows, a long conversation, further columns."""
    rows = [
        (1, 0, "user", MARKS), (1, 1, "assistant", MARKS), (1, 2, "user", None), (1, 3, "assistant", ""),
        (2, None, None, None), (2, 0, "tool", "<\\s> and <\\\\/s> [INST"), (2, 0, "tool", "x"), (2, 0, "system", "y."),
        (None, 3, "assistant", "no id."), (None, None, "user", "none. "), (None, 3, "assistant", "no id."),
        (3, 5, "[ROLE]</s>", "<<SYS>>"), (3, 5, "", "empty role"), (4, 1, "user", "w" * 300_000 + "!"), (4, 2, "assistant", "żółw 😀 \x00?"),
        (5, 9, None, " \t\n"), (6, 1, "assistant", "only."), (7, 2, "system", "only a system turn"),
    ]
    rows += [(8, i // 2, ("user", "assistant", "system", "user")[i % 4], f"line {i % 7}{'.' if i % 5 else ''}") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df.repartition(5), rows


def expected_chats(rows):
    out = []
    for conv, own in in_order(rows).items():
        turns = [(r[2] or "", r[3] or "") for r in own]
        learned = "".join(t for role, t in turns if role == "assistant")
        out.append((conv, len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), sha(learned)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"long_rows": 3, "piece_chars": 40}, {"long_rows": 50, "piece_chars": 1}])
def test_chats_come_back(odd, limits):
    df, rows = odd
    formatted = C.format_conversations(df, **limits)
    got = C.read_back(formatted).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected_chats(rows)
    texts = {}
    for r in sorted(formatted.collect(), key=lambda r: r.piece):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.formatted
    for conv, own in in_order(rows).items():
        assert list(C.TEMPLATE.parse(texts[conv])) == [(r[2] or "", r[3] or "") for r in own]
        assert next(r.formatted_chars for r in got if r.conv_id == conv) == len(texts[conv])


def test_only_conflicts_are_escaped():
    t = C.TEMPLATE
    assert t.render("user", "a <s and [inst] \\ b")[0] == "[INST] a <s and [inst] \\ b [/INST]"
    assert t.render("assistant", MARKS) == ("<s><\\/s>[\\INST] ok [\\/INST]</s>", 3, 27)
    assert t.render("assistant", "<\\/s>")[0] == "<s><\\\\/s></s>"
    assert t.render("tool", "x")[0] == "[ROLE]tool[/ROLE]x[/TURN]"
    for wrong in ("<s>" + MARKS + "</s>", "[INST] a", "b", "[INST]  [/INST] ", "[ROLE]user[/ROLE]x[/TURN]", "[INST] [/INST]"):
        with pytest.raises(C.Conflict):
            list(t.parse(wrong))


_piece = st.sampled_from([*C.TEMPLATE.controls, "<", "[", "\\", "/s>", "SYS>>", "INST]", " ", "x", "\n", "</", "<<"])
_text = st.lists(_piece, max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), _text), _text), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_turns_round_trip(turns):
    rendered = [C.TEMPLATE.render(*t) for t in turns]
    assert list(C.TEMPLATE.parse("".join(r[0] for r in rendered))) == turns
    for (_, text), (source, a, b) in zip(turns, rendered, strict=True):
        assert C.TEMPLATE.unescape(source[a:b]) == text


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.format_conversations(none).count() == 0 and C.read_back(C.format_conversations(none)).count() == 0
    assert R.repair_report(R.repair_conversations(R.damaged(none), "present")).count() == 0


def test_planted_conversation_is_added(spark):
    row = op11_chat_round_trip(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(MARKS), sha(MARKS))
    assert row.turns_sha256 == sha(f"user\n{MARKS}\nassistant\n{MARKS}\n")


def plain_faults(rows):
    """Kinds of fault of (role, text) rows, in order."""
    kinds = []
    for i, (role, text) in enumerate(rows):
        body = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in rows[:i] else "truncated" if body[-1] not in ".!?" else "")
    return kinds


def every_repair(rows):
    """Least cost, letters and turns by trying all edits of short conversations."""
    kinds = plain_faults(rows)
    new = [("I", 2, ("user", "")), ("I", 2, ("assistant", ""))]
    gaps = [x for n in range(3) for x in itertools.product(new, repeat=n)]
    best = None
    options = []
    for (role, text), kind in zip(rows, kinds, strict=True):
        own = [("D", 3, None)]
        if kind not in ("blank", "duplicate"):
            extra = kind == "truncated"
            own += [("K", extra, (role, text))] + [("R", 2 + extra, (x, text)) for x in ("user", "assistant")]
        options += [gaps, [(x,) for x in own]]
    for way in itertools.product(*options, gaps):
        edits = [e for group in way for e in group]
        turns = [e[2] for e in edits if e[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(t[0][:1] for t in turns)):
            found = sum(e[1] for e in edits), "".join(e[0] for e in edits), turns
            best = found if best is None or found[:2] < best[:2] else best
    return best


def own_repair(rows):
    held = R._Rows({"present": True, "role": a, "text": b, "turn": i, "digest": b} for i, (a, b) in enumerate(rows))
    cost, audit, turns = held.edited(R.START, R.end_state(R.forward(held.moves, R.START)), True)
    return cost, audit, [(t["role"], t["text"]) for t in turns]


def test_repairs_are_the_cheapest_of_all():
    rng = random.Random(5)
    assert own_repair([]) == every_repair([]) == (0, "", [])
    for n, times in ((1, 20), (2, 60), (3, 12)):
        for _ in range(times):
            rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "a.", "b", "c!"])) for _ in range(n)]
            assert own_repair(rows) == every_repair(rows), rows


def plain_repair(rows):
    """From the last row back, the least cost and letters from each state, with the turns they give."""
    after = {0: [], 1: ["user", "assistant"], 2: ["assistant"], 3: []}
    new = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {q: (2 * len(x), "I" * len(x), [(r, "") for r in x]) for q, x in after.items()}
    for (role, text), kind in reversed(list(zip(rows, plain_faults(rows), strict=True))):
        here = {}
        for q in range(4):
            ways, at, done = [], q, []
            for k in range(3):
                extra = kind == "truncated"
                steps = [("D", 3, [], at)]
                if kind not in ("blank", "duplicate"):
                    steps.append(("R", 2 + extra, [(new[at][0], text)], new[at][1]))
                    steps += [("K", extra, [(role, text)], to) for x, to in kept[at].items() if x == role[:1]]
                for letter, cost, turns, to in steps:
                    c, a, t = best[to]
                    ways.append((2 * k + cost + c, "I" * k + letter + a, done + turns + t))
                done, at = [*done, (new[at][0], "")], new[at][1]
            here[q] = min(ways, key=lambda w: w[:2])
        best = here
    return best[0]


def test_repairs_of_longer_conversations():
    rng = random.Random(6)
    for n in (3, 8, 40, 150):
        for _ in range(10):
            rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", f"a{i}.", "b", f"c{i}", " "])) for i in range(n)]
            assert own_repair(rows) == plain_repair(rows)


def expected_repairs(rows):
    import zlib

    out = []
    broken = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        broken[conv] += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in broken.items():
        own = in_order(own).get(conv, [])
        pairs = [(r[2], r[3]) for r in own]
        kinds = plain_faults(pairs)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, repaired = plain_repair(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{a}:{b}" for a, b in repaired))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"long_rows": 2}, {"long_rows": 50}])
def test_repaired_tables(odd, limits):
    df, rows = odd
    got = R.repair_report(R.repair_conversations(R.damaged(df), "present", **limits)).collect()
    assert sorted(map(tuple, got), key=repr) == expected_repairs(rows)


def test_repair_of_rows_as_they_are(spark, odd):
    df, rows = odd
    repaired = R.repair_conversations(df).where("whole").collect()
    assert {r.conv_id for r in repaired} == {r[0] for r in rows}
    for r in repaired:
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in r.repaired))


def test_a_lost_conversation_is_told(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", False), (2, 0, "user", "a.", True)], SCHEMA + ", here boolean")
    for limits in ({}, {"long_rows": 0}):
        got = R.repair_report(R.repair_conversations(rows, "here", **limits)).collect()
        assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, "", sha("")), (2, 0, 0, 0, 0, 0, 2, "KI", sha("user:a.\nassistant:"))]
