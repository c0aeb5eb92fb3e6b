import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from rasterloom.llm import conversations as C

SPACE = " \t\n\x0b\f\r"


def cheapest(rows):
    """Uniform-cost search over (row, state): rows are (role, text, fault)."""
    queue, seen = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, k, state, out = heapq.heappop(queue)
        if (k, state) in seen:
            continue
        seen.add((k, state))
        if k == len(rows) and state in (0, 3):
            return cost, audit, out
        moves = [("u", {0: 2, 1: 2, 3: 2}), ("a", {2: 3})]
        name = {"u": "user", "a": "assistant"}
        for i, to in moves:
            if state in to:
                heapq.heappush(queue, (cost + 2, audit + "I", k, to[state], (*out, f"{name[i]}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(queue, (cost + 3, audit + "D", k + 1, state, out))
            if fault not in ("b", "d"):
                t = int(fault == "t")
                for i, to in moves:
                    if state in to:
                        heapq.heappush(queue, (cost + 2 + t, audit + "R", k + 1, to[state], (*out, f"{name[i]}:{text}")))
                to = dict(moves).get(role[:1], {0: 1} if role[:1] == "s" else {})
                if state in to:
                    heapq.heappush(queue, (cost + t, audit + "K", k + 1, to[state], (*out, f"{role}:{text}")))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append((role, text, "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def plain(table, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        mine = convs[conv]
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        marked = faults(rows)
        cost, audit, said = cheapest(marked)
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[:1] for r, _, _ in marked]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == x for _, _, f in marked) for x in "bdt"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(seed, n=60, roles=("user", "assistant", "system", "tool", "", "User")):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", " \t", "well? ", "end.", "ok"]
    return [(c, r.choice([t, t, t + 3, None]), r.choice(roles[:3] * 4 + roles), r.choice(texts + [None, f"t{t}."])) for c in [*range(n), None] for t in range(r.randint(1, 9))]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "e", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, rank int").repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search(spark, seed):
    rows = table(seed)
    assert found(C.repaired(frame(spark, rows))) == plain(rows)


def test_odd_tables(spark):
    rows = [(1, None, None, None), (2, 5, "user", "x" * 200_000), (2, 6, "assistant", "ü."), (2, 6, "assistant", "ü."), (-3, 10**17, "s", "."), (-3, -10**17, "u", "."), (-3, 0, "", "z.")] * 2
    assert found(C.repaired(frame(spark, rows))) == plain(rows)
    assert found(C.repaired(frame(spark, []))) == []


def test_conversations_without_rows(spark):
    ids = spark.createDataFrame([(7,), (None,), (8,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    rows = spark.createDataFrame([(8, 1, "user", "a.", 1)], "conv_id long, turn long, role string, text string, n int")
    got = {r[0]: tuple(r)[1:] for r in C.repair(rows, ids).collect()}
    assert got[7] == got[None] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[8][5:7] == (2, "KI")


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    monkeypatch.setattr(C, "MERGE", 3)
    r = random.Random(4)
    rows = [(5, t, r.choice(["user", "assistant", "system"]), f"t{t // 2}" + r.choice(".! ")) for t in range(700)] + [(6, 1, "user", "a."), (6, 2, "assistant", "b.")]
    assert found(C.repair(frame(spark, rows))) == plain(rows, damage=False)


def test_any_split_gives_the_same_cell():
    """All spans by all splits, against spans of twice the length."""
    r = random.Random(9)
    for _ in range(40):
        shape = "".join(chr(65 + r.randrange(16)) for _ in range(r.randint(1, 7)))
        cells = {(i, i + 1): C.terminal(c) for i, c in enumerate(shape)}
        for n in range(2, len(shape) + 1):
            for i in range(len(shape) - n + 1):
                splits = {C.combine(cells[i, k], cells[k, i + n]) for k in range(i + 1, i + n)}
                assert len(splits) == 1
                cells[i, i + n] = splits.pop()
        assert cells[0, len(shape)] == C.climb([C.terminal(c) for c in shape])


def test_text_ids(spark):
    rows = [("a", 1, "user", "x."), ("b", 1, "assistant", "y"), (None, 2, "user", "z.")]
    got = {r["conv_id"]: r["audit"] for r in C.repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert got == {"a": "KI", "b": "D", None: "KI"}
