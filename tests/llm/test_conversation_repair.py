from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from grievlake.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
ROLE = {"u": "user", "a": "assistant"}


def cheapest_by_hand(letters):
    """(cost, edits) by trying every state after every row, inserts up to two in a row, strings compared whole."""
    states = {0: (0, "")}

    def step(found, state, cost, edits):
        if state not in found or (cost, edits) < found[state]:
            found[state] = (cost, edits)

    def with_inserts(states):
        found = dict(states)
        for _ in range(3):
            for state, (cost, edits) in list(found.items()):
                step(found, 3 if state == 2 else 2, cost + 5, edits + "I")
        return found

    for letter in letters:
        kind, fault = divmod(ord(letter) - 65, 4)
        after = {}
        for state, (cost, edits) in with_inserts(states).items():
            step(after, state, cost + 2, edits + "D")
            if fault not in (1, 2):
                extra = 5 * (fault == 3)
                following = 3 if state == 2 else 2
                step(after, following, cost + 1 + extra, edits + "R")
                if kind + 1 == following or (kind == 0 and state == 0):
                    step(after, kind + 1, cost + extra, edits + "K")
        states = after
    return min(v for s, v in with_inserts(states).items() if s in (0, 3))


def test_auction_equals_search_on_all_short_and_random_long_conversations():
    letters = [chr(65 + i) for i in range(16)]
    for size in range(4):
        for word in itertools.product(letters, repeat=size):
            assert cr.cheapest.__wrapped__("".join(word)) == cheapest_by_hand(word)
    draw = random.Random(5)
    for size in (7, 15, 16, 17, 33, 150):
        for _ in range(60):
            word = "".join(draw.choices(letters, [9, 1, 1, 2, 9, 1, 1, 2, 9, 1, 1, 2, 1, 1, 1, 1], k=size))
            assert cr.cheapest.__wrapped__(word) == cheapest_by_hand(word)


def test_prices_are_feasible_and_work_grows_with_the_length():
    draw = random.Random(2)
    word = "".join(chr(65 + draw.randrange(16)) for _ in range(4000))
    lattice = cr.Lattice(word)
    edits = lattice.trace()
    for node in range(4 * len(word) + 4):
        for _, cost, to in lattice.arcs(node):
            if lattice.settled[to]:
                assert lattice.price[node] <= cost + lattice.price[to]
    assert lattice.rises < 200 * len(word)
    rest = cr.Lattice(word[:1000])
    rest.trace()
    assert lattice.rises < 8 * rest.rises
    assert len(edits.replace("I", "")) == len(word)


def by_hand(turns):
    """The contract over plain rows: conv_id -> the query's columns."""
    blank = lambda v: " " if v is None else str(v)
    conversations = {}
    for conv, turn, role, text in turns:
        conversations.setdefault(conv, [])
        role, text = blank(role), blank(text)
        draw = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if draw == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(draw, text)
        role = "user" if draw == 4 else role
        conversations[conv] += [(turn, role, text)] * (2 if draw == 3 else 1)
    out = {}
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, word, faults = set(), "", []
        for _, role, text in rows:
            bare = text.rstrip(cr.WHITE_SPACE)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
            word += chr(65 + 4 * ("sua".find(role[0]) % 4 if role else 3) + fault)
        cost, edits = cheapest_by_hand(word)
        body, row, state = [], 0, ""
        for edit in edits:
            following = "a" if state == "u" else "u"
            if edit == "D":
                row += 1
            elif edit == "K":
                state = rows[row][1][0]
                body.append(":".join(rows[row][1:]))
                row += 1
            else:
                state = following
                body.append(ROLE[following] + ":" + (rows[row][2] if edit == "R" else ""))
                row += edit == "R"
        known = [t for t, *_ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out[conv] = (
            gaps, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, edits, hashlib.sha256("\n".join(body).encode()).hexdigest(),
        )
    return out


def repaired(spark, turns):
    summary, lines = cr.repair(cr.damage(spark.createDataFrame(turns, SCHEMA)))
    hashes = {r["conv_id"]: r["digest"] for r in cr.digests(lines).collect()}
    return {
        r["conv_id"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")],
                       hashes.get(r["conv_id"], hashlib.sha256(b"").hexdigest()))
        for r in summary.collect()
    }


def drawn_turns():
    draw = random.Random(11)
    turns = []
    for conv in [*range(40), None]:
        for turn in range(draw.choice([1, 2, 5, 8])):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = draw.choice(["Fine.", "no end", "What? ", " \t", None, "é! \n", f"own {turn}."])
            turns.append((conv, draw.choice([turn, turn, turn + 3, None]) if turn % 4 == 3 else turn, role, text))
    return turns + turns[::9]


def test_query_columns_equal_the_contract(spark):
    turns = drawn_turns()
    want = by_hand(turns)
    got = repaired(spark, turns)
    assert got == {c: v for c, v in want.items() if v[6] or c in got}
    assert all(want[c][5:7] == (0, "") for c in set(want) - set(got))


def test_a_conversation_over_many_tasks_and_runs(spark, monkeypatch):
    monkeypatch.setattr(cr, "RUN_BITS", 3)
    draw = random.Random(8)
    turns = [(7, t, draw.choice(["user", "assistant"]), draw.choice(["Yes.", "cut", f"Text {t}."])) for t in range(400)]
    turns += [(8, 0, "user", "Only.")]
    assert repaired(spark, turns) == by_hand(turns)


def test_repeated_rows_and_empty_table(spark):
    turns = [(3, 1, "user", "Same."), (3, 1, "user", "Same."), (3, 2, "assistant", "Yes.")]
    assert repaired(spark, turns) == by_hand(turns)
    assert repaired(spark, []) == {}


def test_repaired_turns_alternate(spark):
    summary, lines = cr.repair(spark.createDataFrame(drawn_turns(), SCHEMA))
    assert lines.columns == ["conv_id", "line", "role", "text"]
    talks = {}
    for r in sorted(lines.collect(), key=lambda r: (str(r["conv_id"]), r["line"])):
        talks.setdefault(r["conv_id"], []).append(r["role"][0])
    assert talks and all(re.fullmatch("(s?(ua)+)?", "".join(t)) for t in talks.values())


@pytest.mark.parametrize("columns", [["extra", "at", "line"]])
def test_other_columns_are_ignored(spark, columns):
    turns = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "assistant", "B.")], SCHEMA)
    for c in columns:
        turns = turns.selectExpr("*", f"1 AS {c}")
    summary, _ = cr.repair(turns)
    assert [tuple(r) for r in summary.collect()] == [(1, 0, 0, 0, 0, 0, 0, "KK")]
