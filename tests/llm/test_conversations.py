"""Conversation repair against a shortest-path search over whole audits in plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations

ROWS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = [" " if v is None else v for v in (role, text)]
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    key = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), key(r)))


def legal_prefix(roles):
    return re.fullmatch("(s?(ua)*u?)?", roles) is not None


def brute(rows):
    """gaps, faults and the cheapest edits: Dijkstra over (cost, audit), roles checked as a whole string."""
    rows = damaged(rows)
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, met = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, kept = heapq.heappop(heap)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        state = (k, roles[-1:] or "^")
        if state in met:
            continue
        met.add(state)
        grow = lambda c, edit, n, role, text: heapq.heappush(heap, (cost + c, audit + edit, n, roles + role[:1], (*kept, f"{role}:{text}"))) if role[:1] and legal_prefix(roles + role[:1]) else None
        for role in ("user", "assistant"):
            grow(5, "I", k, role, "")
        if k < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, roles, kept))
            if faults[k] not in ("b", "d"):
                more = 5 if faults[k] == "t" else 0
                grow(more, "K", k + 1, rows[k][1], rows[k][2])
                for role in ("user", "assistant"):
                    grow(more + 1, "R", k + 1, role, rows[k][2])
    return (gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def conversation(r, conv):
    rows = []
    for turn in range(r.randrange(1, 12)):
        role = r.choice(["user", "assistant"] if r.random() < 0.5 else ["user", "assistant", "system", "tool", "", None, "s", "uA"])
        text = r.choice(["Yes.", "Why?", "so on", "", " \t", None, "Stop!\n", f"t{turn}.", f"é{turn}!", "a" * 50 + "."])
        rows.append((conv, r.choice([turn, turn, turn, None, turn // 2, turn * 3]), role, text))
        if r.random() < 0.1:
            rows.append(rows[-1])
    return rows


def result(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("task_rows", [20, 50_000])
def test_random_conversations(spark, task_rows):
    r = random.Random(task_rows)
    by = {conv: conversation(r, conv) for conv in [*range(400), None]}
    rows = [x for c in by.values() for x in c]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, ROWS).withColumns({"copies": F.lit(7), "key": F.lit("k"), "slice": F.lit(1), "_code": F.lit(0)})
    got = result(conversations.repair(conversations.damage(df), task_rows))
    assert got == {conv: brute(rows) for conv, rows in by.items()}


def test_one_conversation_over_many_partitions(spark):
    """Parts are put together to what one search over all rows finds, ties included."""
    r = random.Random(3)
    roles = {0: ["user", "assistant"], 1: ["system"], 2: ["user", "assistant", "system", "tool"]}
    by = {c: [(c, t, r.choice(roles[c % 3]), r.choice([f"x{t}.", f"x{t}", "again."])) for t in range(n)] for c, n in [(0, 300), (1, 90), (2, 200), (4, 3), (5, 150)]}
    df = spark.createDataFrame([x for c in by.values() for x in c], ROWS)
    assert result(conversations.repair(conversations.damage(df), 11)) == {c: brute(rows) for c, rows in by.items()}


def test_survivors_hold_only_what_is_unresolved():
    decoder, held = conversations.Survivors(conversations.NOTHING), 0
    for k in range(20_000):
        decoder.step(conversations.MOVES["ua"[k % 2], False])
        held = max(held, decoder.held)
    assert held < 20
    nodes, node = 0, decoder.root
    while node.parent is not None:
        nodes, node = nodes + 1, node.parent
    assert nodes == 0


def test_all_rows_dropped_empty_and_long(spark):
    drop = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    keep = next(t for t in range(1000) if zlib.crc32(f"2:{t}".encode()) % 20 > 4)
    df = spark.createDataFrame([(1, drop, "user", "a."), (2, keep, "user", "long " * 200_000 + "."), (2, keep + 1000000, None, None)], ROWS)
    got = result(conversations.repair(conversations.damage(df)))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == brute([tuple(r) for r in df.where("conv_id = 2").collect()])
    assert conversations.repair(conversations.damage(spark.createDataFrame([], ROWS))).count() == 0


def test_many_copies_of_one_row(spark):
    rows = [(7, 11, "user", "Same.")] * 500 + [(7, 12, "assistant", "Same.")] * 3
    assert result(conversations.repair(conversations.damage(spark.createDataFrame(rows, ROWS)), 10)) == {7: brute(rows)}
