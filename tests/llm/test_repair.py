"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from planspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, same string, code int, n long, letters string"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """Audit, cost and repaired rows of (role, text, fault) by Dijkstra over rows and states, audits carried along."""
    seen, heap = set(), [(0, "", 0, 0, ())]
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return audit, cost, out
        to = 3 if state == 2 else 2
        name = "assistant" if state == 2 else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, (name, ""))))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*out, (name, text))))
            for initial, after, state_then in (("s", (0,), 1), ("u", (0, 1, 3), 2), ("a", (2,), 3)):
                if role[:1] == initial and state in after:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, state_then, (*out, (role, text))))


def plain_damage(data):
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
            yield from [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def digest(conv, role, text):
    return hashlib.sha256(f"{'-' if conv is None else conv}:{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plain_report(data):
    out = {}
    for conv in {r[0] for r in data}:
        rows = sorted((r for r in plain_damage(data) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(conv, *r[2:])))
        marked, said = [], set()
        for _, _, role, text in rows:
            last = text.rstrip(SPACES)[-1:]
            marked.append((role, text, "blank" if not last else "duplicate" if (role, text) in said else "truncated" if last not in ".!?" else None))
            said.add((role, text))
        audit, cost, kept = cheapest(marked)
        turns = {r[1] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        faults = [sum(f == name for *_, f in marked) for name in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def conversations(seed, many=80):
    rng = random.Random(seed)
    data = []
    for conv in range(many):
        turn = rng.randrange(-3, 3)
        for _ in range(rng.choice([1, 2, 3, 6, 9, 40])):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "USER", "summary"])
            text = rng.choice(["Yes.", "No!", "more", "", " \n", None, "And so on?\t", "x y. ", "Ünï. 中", f"one {rng.random()}."])
            data.append((conv, None if rng.random() < 0.03 else turn, role, text))
            turn += rng.choice([1, 1, 1, 1, 2, 0, 1 << 60 if turn < 100 else 1])
    return data + [(None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), ((1 << 60) + 1, 0, "user", "long " * 200_000 + "."), ((1 << 60) + 1, 1, "assistant", "Yes.")]


def test_edits_equal_a_search_over_all_edits():
    rng = random.Random(1)
    for _ in range(1500):
        codes = bytes(rng.choice([0, 4, 8, 12, 4, 8, 4, 8]) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 60])))
        rows = [("suax"[c // 4], str(i), repair.FAULTS[c % 4]) for i, c in enumerate(codes)]
        assert repair.whole_edits(codes) == cheapest(rows)[0]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_report_equals_brute_force(spark, tmp_path, block):
    data = conversations(block)
    spark.createDataFrame([(*r, "a", 1, 2, "b") for r in data], SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    convs = spark.read.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(repair.damaged(convs), block).collect()}
    want = plain_report(data)
    assert got == {k: v for k, v in want.items() if k in got}
    assert all(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k, v in want.items() if k not in got)
    if block == 4096:
        rows = repair.query(spark, str(tmp_path)).collect()
        assert {r.conv_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_one_conversation_holds_all_rows(spark):
    said = [(7, t, ("user", "assistant")[t % 2], f"turn {t % 900}.") for t in range(3000)] + [(7, 3000, "user", "again.")] * 500
    got = repair.report(spark.createDataFrame([(*r, "a", 1, 2, "b") for r in said], SCHEMA), 256).collect()
    marked = [(r, x, None if i < 900 else "duplicate") for i, (_, _, r, x) in enumerate(said[:3000])]
    audit, cost, kept = cheapest([*marked, ("user", "again.", None)] + [("user", "again.", "duplicate")] * 499)
    assert [(r.conv_id, r.audit, r.cost, r.duplicate) for r in got] == [(7, audit, cost, 2100 + 499)]
    rows = repair.repaired(spark.createDataFrame([(*r, "a", 1, 2, "b") for r in said], SCHEMA), 256)
    assert [(r.role, r.text) for r in rows.where("edit <> 'D'").orderBy("position").collect()] == list(kept) and rows.count() == len(audit)


def test_empty_table(spark):
    assert repair.report(spark.createDataFrame([], SCHEMA)).count() == 0 and repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
