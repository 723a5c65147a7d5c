"""Conversation repair: Dijkstra against a search over all edits, pieces against wholes, and the awkward rows."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagespan.llm import conversation_repair as repair

ROWS = "conv_id long, turn long, role string, text string, part int, ord int, audit string"


def every_edit(rows):
    """The least (cost, audit) over all audits of bounded cost, by breadth: rows are (initial, fault)."""
    best = None
    front = {(0, 0): {(0, "")}}  # all of a node's paths, not only its best
    for i in range(len(rows) + 1):
        for _ in range(3):
            for s in range(4):
                for c, a in list(front.get((i, s), ())):
                    if a[-3:] != "III":
                        front.setdefault((i, repair.NEXT[s]), set()).add((c + 5, a + "I"))
        if i == len(rows):
            break
        x, fault = rows[i]
        for s in range(4):
            for c, a in front.get((i, s), ()):
                front.setdefault((i + 1, s), set()).add((c + 2, a + "D"))
                if fault != 2:
                    front.setdefault((i + 1, repair.NEXT[s]), set()).add((c + 1 + 5 * fault, a + "R"))
                    if (s, x) in repair.STEP:
                        front.setdefault((i + 1, repair.STEP[s, x]), set()).add((c + 5 * fault, a + "K"))
    best = min(p for s in (0, 3) for p in front.get((len(rows), s), ()))
    return best


def test_dijkstra_equals_a_search_over_all_edits():
    rnd = random.Random(3)
    for n, times in ((0, 1), (1, 10), (2, 30), (3, 60), (4, 20)):
        for _ in range(times):
            rows = [(rnd.choice(["s", "u", "a", "t", ""]), rnd.choice([0, 0, 0, 1, 2])) for _ in range(n)]
            (found,) = repair.cheapest(rows).values()
            assert found == every_edit(rows), rows


def brute(rows):
    """rows of one conversation, sorted -> the report's fields."""
    blank = duplicate = truncated = 0
    seen, lattice = set(), []
    for _, role, text in rows:
        own = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 2
        if not own:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif own[-1] not in ".!?":
            truncated, fault = truncated + 1, 1
        else:
            fault = 0
        seen.add((role, text))
        lattice.append((role[:1], fault))
    ((cost, audit),) = repair.cheapest(lattice).values()
    turns = repair.edited([r for _, r, _ in rows], [t for _, _, t in rows], audit)
    t = {x for x, _, _ in rows if x is not None}
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(lattice))
    return (max(t) - min(t) + 1 - len(t) if t else 0, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest()), turns


def conversations(rnd, convs, turns):
    out = []
    for c in range(convs):
        for t in range(rnd.randint(0, turns)):
            turn = None if rnd.random() < 0.05 else t if rnd.random() < 0.8 else t // 3
            out.append((c if c else None, turn, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rnd.choice(["Yes.", "No!", "cut off", "", " \n", None, f"é{t}?", "same."])))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], ROWS).repartition(5)
    out = repair.repair_conversations(df)
    want, said = {}, {}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r if r is not None else " ", x if x is not None else " ") for k, t, r, x in rows if k == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        want[c], said[c] = brute(own)
    got = {r[0]: tuple(r)[1:] for r in out["report"].collect()}
    assert got == want
    turns = {}
    for r in out["turns"].orderBy("conv_id", "part", "ord", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: t for c, t in said.items() if t}


@pytest.mark.parametrize("piece", [512, 1, 3])
def test_report_equals_a_plain_loop(spark, piece, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    check(spark, conversations(random.Random(piece), 60, 9))


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 16)
    rnd = random.Random(8)
    long = [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(["Yes.", "No.", f"t{t}.", "cut"])) for t in range(900)]
    check(spark, long + conversations(rnd, 12, 6))
    monkeypatch.setattr(repair, "BROADCAST_ROWS", 0)
    check(spark, [(7, t, r, x) for _, t, r, x in long[:60]])


def test_damage_follows_its_rule(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["A. b!", None])) for c in (None, 1, 2, 30) for t in [None, *range(40)]]
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if k:
            want += [(c, t, "user" if k == 4 else r, "" if k == 1 else x.replace(".", "").replace("!", "") if k == 2 else x)] * (1 + (k == 3))
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], ROWS)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=str) == sorted(want, key=str)
    out = repair.damage_and_repair(df)
    assert out.count() == 4


def test_conversations_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    none = spark.createDataFrame([], ROWS)
    assert repair.damage_and_repair(none).count() == 0 and repair.repair_conversations(none)["turns"].count() == 0
    (r,) = repair.damage_and_repair(none.unionByName(spark.createDataFrame([(gone, 0, "user", "x", 1, 1, "k")], ROWS))).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    (r,) = repair.repair_conversations(none.unionByName(spark.createDataFrame([(1, None, "user", "﻿A ", 1, 1, "k")], ROWS)).select(F.lit(1).alias("turns"), "*"))["report"].collect()
    assert (r.blank, r.truncated, r.audit, r.cost) == (0, 1, "D", 2)
