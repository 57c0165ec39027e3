"""Searches against all edit sequences and against a table over all rows; conversations against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from fixtures import by_id

from tessera.llm import turn_repair as T
from tessera.llm.turn_repair import damaged, repair, repair_summary, repaired_turns

FAULT = {0: "", 1: "truncated", 2: "blank", 3: "duplicate"}


def outcome(rows, audit):
    """(cost, role initials) of an edit sequence, or None where it does not fit; rerolled and inserted rows are '?'."""
    cost, roles, i = 0, "", 0
    for edit in audit:
        if edit == "I":
            cost, roles = cost + 3, roles + "?"
            continue
        if i == len(rows):
            return None
        initial, fault = "suax"[rows[i] & 3], rows[i] >> 2
        i += 1
        if edit == "D":
            cost += 4
        elif fault >= 2:
            return None
        else:
            cost += 3 * (fault == 1) + 3 * (edit == "R")
            roles += "?" if edit == "R" else initial
    if i < len(rows):
        return None
    for head in ("", "s"):
        want = head + "ua" * len(roles)
        if len(roles) == len(head) + (len(roles) - len(head)) // 2 * 2 >= 0 and not (head and len(roles) < 3):
            if all(a == b or (a == "?" and b != "s") for a, b in zip(roles, want)):
                return cost
    return None


def every_sequence(rows):
    best = None
    for size in range(2 * len(rows) + 3):
        for audit in map("".join, itertools.product("DIKR", repeat=size)):
            cost = outcome(rows, audit)
            if cost is not None and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def by_table(rows):
    """The same by a table over rows and last roles, cheapest (cost, audit) first."""
    now = {0: (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for state, (cost, audit) in list(now.items()):
                to = 2 if state in (0, 1, 3) else 3
                now[to] = min(now.get(to, (10 ** 9, "")), (cost + 3, audit + "I"))
        if i == len(rows):
            return min(now[s] for s in (0, 3) if s in now)
        initial, fault, after = "suax"[rows[i] & 3], rows[i] >> 2, {}
        for state, (cost, audit) in now.items():
            need = "a" if state == 2 else "u"
            steps = [(4, "D", state)]
            if fault < 2:
                extra = 3 * (fault == 1)
                steps.append((3 + extra, "R", 3 if need == "a" else 2))
                if initial == need:
                    steps.append((extra, "K", 3 if need == "a" else 2))
                if initial == "s" and state == 0:
                    steps.append((extra, "K", 1))
            for c, a, to in steps:
                after[to] = min(after.get(to, (10 ** 9, "")), (cost + c, audit + a))
        now = after


def test_all_sequences():
    for n in (0, 1, 2):
        for rows in itertools.product(range(16), repeat=n):
            if n < 2 or (rows[0] * 16 + rows[1]) % 5 == 0:
                assert repair(bytes(rows)) == every_sequence(rows) == by_table(rows), rows


@pytest.mark.parametrize("part", [2, 3, 5, 16])
def test_searches(part):
    rnd = random.Random(part)
    for k in range(150):
        pool = (range(16), [1, 2], [1, 2, 2, 1, 0], [5, 6, 1, 2], [1])[k % 5]
        rows = bytes(rnd.choice(list(pool)) for _ in range(rnd.randint(0, 40)))
        assert repair(rows, part) == by_table(rows), list(rows)


def test_long():
    rnd = random.Random(0)
    rows = bytes(rnd.randrange(16) for _ in range(5000))
    cost, audit = repair(rows)
    assert (cost, audit) == by_table(rows)
    assert outcome(rows, audit) == cost


def plainly(rows):
    """Expected summaries of rows (conv, turn, role, text), undamaged, by conversation."""
    blank = " "
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        role, text = blank if role is None else role, blank if text is None else text
        convs[conv]
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        convs[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, said in convs.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes = set(), []
        for _, role, text in said:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1
            seen.add((role, text))
            codes.append(("sua".find(role[0]) % 4 if role else 3) + 4 * fault)
        cost, audit = by_table(codes)
        lines, i = [], 0
        for edit in audit:
            last = lines[-1][0] if lines else ""
            need = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{need}:")
                continue
            _, role, text = said[i]
            i += 1
            if edit != "D":
                lines.append(f"{role if edit == 'K' else need}:{text}")
        turns = {t for t, _, _ in said if t is not None}
        initials = [r[:1] for _, r, _ in said]
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            **{name: sum(c >> 2 == f for c in codes) for f, name in FAULT.items() if f},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "lines": lines}
    return out


def conversations(seed=1, n=120):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, 9) if conv else 200):
            role = rnd.choice(["system", "user", "assistant"]) if rnd.random() < .2 else ("user", "assistant")[turn % 2]
            text = rnd.choice(["Yes.", "No!", "Why?", "well", "", " \t", "Ends here. ", "é。", "line\nnext.", "x" * 500 + "."])
            rows.append((conv, turn if rnd.random() < .9 else rnd.choice([None, turn + 3, 0]), role, text))
    rows += [(None, i, "user", "lost.") for i in range(5)] + [(500, None, None, None), (501, 1, "", "x."), (502, 3, "tool", "t."), (503, 1, "System", "S.")]
    rows += [(504, -5, "user", "a."), (504, 9, "assistant", "b."), *[(505, 2, "user", "same.")] * 30]
    rnd.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True) for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, phase string, place int, stands boolean")


def test_conversations(spark):
    rows = conversations()
    want = plainly(rows)
    hurt = damaged(table(spark, rows))
    got = by_id(repair_summary(hurt, stands=hurt.stands), "conv_id")
    assert set(got) == set(want)
    for conv, w in want.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == {k: v for k, v in w.items() if k != "lines"}, conv
    assert any(not w["audit"] and w["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for w in want.values())
    lines = defaultdict(list)
    for r in sorted(repaired_turns(hurt, stands=hurt.stands).collect(), key=lambda r: r.place):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(lines[conv] == w["lines"] for conv, w in want.items())


def test_empty(spark):
    hurt = damaged(table(spark, []))
    assert repair_summary(hurt, stands=hurt.stands).count() == 0
    assert repaired_turns(table(spark, [])).count() == 0
