"""Repaired conversations against all edits tried one by one, and in pieces of few rows."""

import hashlib
import random
import zlib

import pytest

from tidemill.llm import conversation_repair as C

KINDS = [0, 1, 2, 3, 4, 5, 6, 7, C.GONE]


def repair_plainly(rows):
    """Cost and least letters, by growing the cheapest edits of each prefix in each state."""
    best = {(0, 0): (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(4):  # inserted rows before row i
            for state in range(4):
                if (i, state) in best:
                    cost, letters = best[i, state]
                    key = (i, C._NEXT[state])
                    best[key] = min(best.get(key, (C.FAR, "")), (cost + 5, letters + "I"))
        if i == len(rows):
            break
        kind = rows[i]
        for state in range(4):
            if (i, state) not in best:
                continue
            cost, letters = best[i, state]
            ways = [("D", 2, state)]
            if kind != C.GONE:
                late, role, wanted = 5 if kind >= 4 else 0, kind % 4, 3 if state == 2 else 2
                ways.append(("R", 1 + late, wanted))
                if role == wanted or role == 1 and state == 0:
                    ways.append(("K", late, role))
            for letter, more, after in ways:
                key = (i + 1, after)
                best[key] = min(best.get(key, (C.FAR, "")), (cost + more, letters + letter))
    return min(best[len(rows), state] for state in (0, 3) if (len(rows), state) in best)


def random_kinds(rng, most):
    return [rng.choice(KINDS if rng.random() < 0.5 else [1, 2, 3]) for _ in range(rng.randint(0, most))]


def test_edits_equal_all_edits_tried():
    rng = random.Random(3)
    for _ in range(3000):
        kinds = random_kinds(rng, 9)
        cost, letters, end = C.solve(tuple((k, 1) for k in kinds))
        assert (cost, letters + C._TAIL[end]) == repair_plainly(kinds), kinds


def test_pieces_equal_the_whole():
    rng = random.Random(4)
    for _ in range(300):
        kinds = random_kinds(rng, 60) or [2]
        rows = [(k, 1) for k in kinds]
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), min(3, len(rows) - 1))), len(rows)]
        pieces = [tuple(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        prices = C.boundary_prices([C.distances(p) for p in pieces])
        state, out, costs = 0, "", []
        for piece, exits in zip(pieces, prices):
            cost, letters, state = C.solve(piece, state, exits)
            out, costs = out + letters, [*costs, cost]
        assert (costs[0], out + C._TAIL[state]) == repair_plainly(kinds)


def test_work_grows_with_the_length():
    rows = tuple((random.Random(5).choice(KINDS), 1) for _ in range(4000))
    asked = []
    for n in (1000, 4000):
        lattice, steps = C.Lattice(rows[:n], C._TAIL_COST), 0
        class Counted(list):
            def __getitem__(self, i):
                nonlocal steps
                steps += 1
                return super().__getitem__(i)
        lattice.arcs = Counted(lattice.arcs)
        lattice.converge()
        asked.append(steps)
    assert asked[1] < 8 * asked[0]


def damage_plainly(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def report_plainly(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damage_plainly(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            if not bare:
                fault = 0
            elif (role, text) in seen:
                fault = 1
            else:
                fault = 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            kinds.append(C.GONE if fault in (0, 1) else {"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + (4 if fault == 2 else 0))
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, letters = repair_plainly(kinds)
        repaired, left = [], iter(own)
        for letter in letters:
            row = None if letter == "I" else next(left)
            if letter == "K":
                repaired.append((row[2], row[3]))
            elif letter != "D":
                repaired.append(("assistant" if repaired and repaired[-1][0][:1] == "u" else "user", row[3] if row else ""))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (gaps, *counts, illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def made_rows():
    rng, rows = random.Random(6), []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9) if conv != 7 else 300):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(["Yes.", "No.", "and", " \t", None, f"Turn {turn}!", "é日."])))
    return rows


@pytest.mark.parametrize("piece", [C.PIECE, 5])
def test_report_equals_plain_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    rows = made_rows()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"conv": C.F.lit(1), "kind": C.F.lit("x")})
    got = {r[0]: tuple(r)[1:] for r in C.damage_and_repair(table.repartition(5)).collect()}
    assert got == report_plainly(rows)


def test_rows_carry_the_repaired_texts(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "What?"), (1, 2, "user", "Well?"), (1, 3, "assistant", "So.")]
    table = spark.createDataFrame(rows, "c int, t int, r string, x string")
    got = C.repaired_conversations(table, "c", "t", "r", "x").select("edit", "new_role", "new_text").collect()
    assert [tuple(r) for r in got] == [("R", "user", "Hello."), ("R", "assistant", "What?"), ("K", "user", "Well?"), ("K", "assistant", "So.")]


def test_empty_tables_and_lost_conversations(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.damage_and_repair(none).count() == 0
    lost = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(lost, 0, "user", "Hi.")], none.schema)
    assert tuple(C.damage_and_repair(one).first()) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
