import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillon.llm import repair

LEGAL = re.compile("(s?(ua)+)?").fullmatch


def cheapest(signature, inserts=3):
    """The cheapest audit by trying all edits with a few inserts at each place."""
    best = None
    ways = [[("D", "", 2)] + ([] if c == "x" else [("K", c.lower(), 5 * c.isupper()), ("R", "u", 1 + 5 * c.isupper()), ("R", "a", 1 + 5 * c.isupper())]) for c in signature]
    gaps = [""] + ["".join(p) for n in range(1, inserts) for p in itertools.product("ua", repeat=n)]
    for rows in itertools.product(*ways):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            roles = between[0] + "".join(r[1] + g for r, g in zip(rows, between[1:]))
            if LEGAL(roles):
                audit = "I" * len(between[0]) + "".join(r[0] + "I" * len(g) for r, g in zip(rows, between[1:]))
                found = (sum(r[2] for r in rows) + 5 * sum(map(len, between)), audit)
                best = found if best is None or found < best else best
    return best


@pytest.mark.parametrize("length", range(4))
def test_short_signatures_by_brute_force(length):
    every = ["".join(s) for s in itertools.product("suaoSUAOx", repeat=length)]
    for signature in every if length < 3 else random.Random(3).sample(every, 120):
        assert repair.solve(signature) == cheapest(signature), signature


def forward(signature):
    """The same row by row."""
    states = {0: (0, "")}
    after = {0: "u", 1: "u", 2: "a", 3: "u"}
    number = {"s": 1, "u": 2, "a": 3}

    def closed(states):
        for _ in range(3):
            for s, (cost, audit) in list(states.items()):
                to, found = number[after[s]], (cost + 5, audit + "I")
                states[to] = min(states.get(to, found), found)
        return states

    for c in signature:
        new = {}
        for s, (cost, audit) in closed(dict(states)).items():
            ways = [(s, cost + 2, "D")]
            if c != "x":
                ways.append((number[after[s]], cost + 1 + 5 * c.isupper(), "R"))
                if c.lower() == after[s] or c.lower() == "s" and s == 0:
                    ways.append((number[c.lower()], cost + 5 * c.isupper(), "K"))
            for to, more, letter in ways:
                new[to] = min(new.get(to, (more, audit + letter)), (more, audit + letter))
        states = new
    return min(v for s, v in closed(dict(states)).items() if s in (0, 3))


def test_long_signatures_row_by_row():
    r = random.Random(5)
    for n in (9, 64, 65, 130, 3000):
        signature = "".join(r.choices("suaoSUAOx", (1, 8, 8, 1, 1, 3, 3, 1, 3), k=n))
        assert repair.solve(signature) == forward(signature)
    cost, audit = repair.solve("ua" * 50_000)
    assert cost == 0 and audit == "K" * 100_000


def plain(rows):
    """{conv: result} of damaged rows (conv, turn, role, text, times) in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [((r[1] is not None, r[1] or 0), r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == conv for _ in range(r[4])]
        own.sort(key=lambda r: (r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        signature, seen, faults = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            ink = text.strip(" \t\n\v\f\r")
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for (known, t), _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = forward(signature)
        kept, rest, last = [], iter(own), None
        for letter in audit:
            row = None if letter == "I" else next(rest)
            if letter == "D":
                continue
            role = row[1] if letter == "K" else "assistant" if last == "u" else "user"
            kept.append(f"{role}:{'' if row is None else row[2]}")
            last = role[0]
        assert LEGAL("".join(x[0] for x in kept))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(frame):
    rows = frame.collect()
    assert len({r.conv for r in rows}) == len(rows)
    return {r.conv: tuple(r[c] for c in COLUMNS) for r in rows}


def generated(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "Why?", "cut", " ", "", None, "two\nlines!", "end. \n", "x" * 30_000 + ".", "Ünï."]
    roles = ["user", "assistant", "system", "tool", None, "", "usher"]
    return [(r.choice([None, *range(12)]), r.choice([None, *range(6)]), r.choices(roles, (8, 8, 2, 1, 1, 1, 1))[0], r.choice(texts), r.choice([0, 1, 1, 1, 2])) for _ in range(n)] + [(77, 1, "user", "gone", 0)]


def test_against_plain_python(spark, monkeypatch):
    rows = generated(1, 150)
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string, times int").repartition(5)
    want = plain(rows)
    assert want[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result(repair.repair(frame)) == want


def test_fragments_and_repaired_rows(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t // 7}.", 1) for t in range(400)] + [("2" == "", None, None, None, 1)]
    rows = [(int(c), *r) for c, *r in rows]
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string, times int")
    monkeypatch.setattr(repair, "FRAGMENT", 7)
    found = repair.audits(frame)
    assert result(repair.repair(frame)) == plain(rows)
    out = sorted(repair.repaired(frame, found).where("conv = 1").collect(), key=lambda r: r.place)
    assert [r.place for r in out] == list(range(len(out))) and LEGAL("".join(r.role[0] for r in out))
    assert {r.edit for r in out} <= set("KRI")


def test_damage_and_odd_tables(spark):
    rows = [(c, t, "system" if t == 0 else None if t == 3 else "assistant", "One. Two? Three" if (t or 0) % 4 else None) for c in (*range(30), None) for t in (0, 1, 2, 3, None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, times int")
    own = lambda x: " " if x is None else x
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{own(c)}:{own(t)}".encode()) % 20
        role, text = own(role), own(text)
        want.append((c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, {0: 0, 3: 2}.get(kind, 1)))
    damaged = repair.damage(frame)
    assert sorted(map(repr, map(tuple, damaged.collect()))) == sorted(map(repr, want))
    assert result(repair.repair(damaged)) == plain(want)
    assert repair.repair(damaged.limit(0)).collect() == []
