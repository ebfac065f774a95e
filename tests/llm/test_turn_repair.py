"""Repair of conversations against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from depotwise.llm import turn_repair

SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
DUE = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def fix(rows):
    """Cost, letters and repaired rows of (role, text, fault) rows by trying every edit everywhere."""

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            cost, letters, kept = best(i, DUE[state], inserts + 1)
            found.append((cost + 2, "I" + letters, ((NAMES[DUE[state]], ""), *kept)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, letters, kept = best(i + 1, state, 0)
            found.append((cost + 3, "D" + letters, kept))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                cost, letters, kept = best(i + 1, DUE[state], 0)
                found.append((cost + 2 + extra, "R" + letters, ((NAMES[DUE[state]], text), *kept)))
                if role[:1] in NEXT[state] and role:
                    cost, letters, kept = best(i + 1, NEXT[state][role[:1]], 0)
                    found.append((cost + extra, "K" + letters, ((role, text), *kept)))
        return min(found, default=(10**9, "", ()))

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(50_000)
    try:
        return best(0, "", 0)
    finally:
        sys.setrecursionlimit(limit)


def expected(table):
    by = {}
    for conv, turn, role, text in table:
        rows = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in rows:
            end = text.rstrip(SPACES)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        initials = [role[:1] for _, role, _ in rows]
        cost, letters, kept = fix(marked)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[sum(f == name for _, _, f in marked) for name in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def answers(rows):
    keys = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[k] for k in keys) for r in rows}


SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind string, code string, place int, digest string"


@pytest.fixture(scope="module")
def table():
    rng = random.Random(3)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "Student"]
    texts = ["Yes.", "No", "So? ", "é!", "", None, " \t", "\x85", "Well.\n", "a" * 3000, "a" * 2999 + ".", "Yes."]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(9)):
            rows.append((conv, None if rng.random() < 0.08 else turn * rng.choice([1, 1, 2]) - 1, rng.choice(roles), rng.choice(texts)))
    rows += [(900, t, ("user", "assistant")[t % 2], f"Line {t}." if t % 7 else "Again.") for t in range(700)]
    return rows + rows[:40]


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7, "z") for r in rows], SCHEMA)


def test_reports_equal_brute_force(spark, table):
    conversations = made(spark, table)
    got = answers(turn_repair.reports(turn_repair.damaged(conversations), conversations).collect())
    assert got == expected(table)


def test_repaired_rows_are_what_the_reports_sum_up(spark, table):
    rows = turn_repair.damaged(made(spark, table))
    by = {}
    for r in sorted(turn_repair.repaired(rows).where("edit <> 'D'").collect(), key=lambda r: (str(r.conv_id), r.place)):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in turn_repair.reports(rows).collect():
        lines = by.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines)) and len(lines) == r.n_repaired


@pytest.mark.parametrize("seed", range(4))
def test_checkpoints_change_nothing(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3, 8, 17, 60, 200):
        codes = bytes(rng.choice([0, 4, 8, 4, 8, 12]) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        faults = ["", "blank", "duplicate", "truncated"]
        cost, letters, _ = fix([("suat"[c // 4], "", faults[c % 4]) for c in codes])
        assert turn_repair.cheapest(codes) == (cost, letters)


def test_no_rows(spark):
    none = made(spark, [])
    assert turn_repair.reports(turn_repair.damaged(none), none).collect() == []
    assert turn_repair.repaired(none).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = made(spark, [(dropped, 0, "user", "Gone.")])
    row = turn_repair.reports(turn_repair.damaged(lost), lost).collect()
    assert answers(row) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
