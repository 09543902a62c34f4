"""Conversation repair against a plain model: every audit string by length of cost, on both ways of solving."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from helpers import SF

from sparkloom.llm import turn_repair
from sparkloom.session import read_table


def _damaged(rows):
    """rows (conv_id, turn, role, text) -> conv_id -> damaged (turn, role, text) in order."""
    out: dict = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def _cheapest(rows, faults):
    """(cost, audit, roles and texts) by a table over turns and roles so far, all ways kept by their least (cost, audit)."""
    ways = {"": (0, "", [])}  # by the roles' last initial; "" for none

    def fits(last, initial):
        return last + initial in ("s", "u", "su", "ua", "au")

    def inserted(ways):
        for _ in range(2):
            for last, (cost, audit, text) in list(ways.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    new = (cost + 5, audit + "I", [*text, (role, "")])
                    if fits(last, initial) and (initial not in ways or new[:2] < ways[initial][:2]):
                        ways[initial] = new
        return ways

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after: dict = {}
        for last, (cost, audit, done) in inserted(ways).items():
            options = [(last, 2, "D", done)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] and fits(last, role[:1]):
                    options.append((role[0], extra, "K", [*done, (role, text)]))
                options += [(i, 1 + extra, "R", [*done, (new, text)]) for i, new in (("u", "user"), ("a", "assistant")) if fits(last, i)]
            for end, price, edit, kept in options:
                new = (cost + price, audit + edit, kept)
                if end not in after or new[:2] < after[end][:2]:
                    after[end] = new
        ways = after
    ways = inserted(ways)
    return min((ways[x] for x in ("", "a") if x in ways), key=lambda w: w[:2])


def _model(rows):
    out = []
    for conv, own in _damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, kept = _cheapest(own, faults)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(seed):
    made = random.Random(seed)
    rows = []
    for conv in [None, *range(60), 10**12]:
        n = made.choice([1, 2, 3, 5, 8, 20]) if conv != 7 else 700
        for turn in range(n):
            role = made.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "u", "student"])
            text = made.choice(["Yes.", "no", "", None, " \x0b\n", "What? ", "é ", " ", f"line {turn}.\nmore!", "x" * 3000 + "."])
            rows.append((conv, made.choice([turn, turn, turn, turn // 2, None, turn * 2]), role, text))
    return rows + rows[:9]


@pytest.mark.parametrize(("long", "block"), [(1024, 256), (3, 4)])
def test_both_ways_agree_with_the_model(spark, monkeypatch, long, block):
    monkeypatch.setattr(turn_repair, "LONG", long)
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = _rows(long)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = turn_repair.digested(*turn_repair.repair(turn_repair.damage(df))).collect()
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == _model(rows)


def test_the_query_is_the_model_on_the_table(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = turn_repair.op13_turn_repair(spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=str) == _model(rows)


def test_search_stops_at_the_first_end(spark):
    assert turn_repair.best("") == (0, "")
    assert turn_repair.best("sua") == (0, "KKK")
    assert turn_repair.best("s") == (2, "D")
    assert turn_repair.best("aa") == (1, "RK")
    assert turn_repair.best("u") == (2, "D") and turn_repair.best("U") == (2, "D")
    assert turn_repair.best("ua" * 40 + "u") == (2, "KK" * 40 + "D")
    assert set(turn_repair.search("sua", until=None)) <= set(turn_repair.GRAMMAR)


def test_no_conversations_and_extra_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, at string, audit string")
    assert turn_repair.digested(*turn_repair.repair(turn_repair.damage(empty))).count() == 0
