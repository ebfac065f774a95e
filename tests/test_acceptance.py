"""Requests granted in turn, against serving them one by one."""

import random
import time

import pytest

from depotwise.operators import acceptance

ENTRY = "request_id long, kind int, warehouse_id long, product_id long, units long"
LIMITS = "kind int, warehouse_id long, product_id long, room long, reason string"


def one_by_one(entries, limits):
    room = {(k, w, p): r for k, w, p, r, _ in limits}
    why = {(k, w, p): reason for k, w, p, _, reason in limits}
    by = {}
    for request, *limit, units in entries:
        by.setdefault(request, []).append((tuple(limit), units))
    out = {}
    for request in sorted(by):
        failed = [(limit[0], why.get(limit, "no limit known")) for limit, units in by[request] if units > max(room.get(limit, 0), 0)]
        out[request] = min(failed)[1] if failed else None
        if not failed:
            for limit, units in by[request]:
                room[limit] = room.get(limit, 0) - units
    return out


def mixed(rng, n, limits):
    """Moves between limits that are nearly used up."""
    entries = []
    for request in range(n):
        a, b = rng.sample(range(len(limits)), 2)
        units = rng.randrange(1, 30)
        entries += [(request, *limits[a][:3], units), (request, *limits[b][:3], -units)]
        if rng.random() < 0.3:
            c = rng.choice([i for i in range(len(limits)) if i not in (a, b)])
            entries.append((request, *limits[c][:3], rng.choice([-3, 5])))
    return entries


@pytest.mark.parametrize("seed, rounds", [(0, 0), (1, 1), (2, 4)])
def test_equals_one_by_one(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(acceptance, "ROUNDS", rounds)
    rng = random.Random(seed)
    limits = [(0, w, p, rng.randrange(0, 90), "no stock") for w in range(2) for p in range(4)] + [(1, w, None, 100, "full") for w in range(2)]
    entries = [*mixed(rng, 400, limits), (1000, 0, 9, 9, 1), (1001, 0, 9, 9, -5), (1002, 0, 9, 9, 0)]
    got = acceptance.accepted_in_turn(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(limits, LIMITS)).collect()
    expected = one_by_one(entries, limits)
    assert {r.request_id: r.reason for r in got} == expected and len(got) == len(expected)
    assert 50 < sum(reason is None for reason in expected.values()) < 380


def test_later_rounds_read_open_entries_only(spark, monkeypatch):
    """10**5 mixed requests on one hub: few rounds, each over less than the one before."""
    rng = random.Random(9)
    n = 100_000
    entries = [(i, 1, 1, None, rng.randrange(1, 100) if rng.random() < 0.6 else -rng.randrange(1, 100)) for i in range(n)]
    entries += [(i, 0, 1, i % 5000, rng.randrange(-9, 10)) for i in range(n)]
    limits = [(1, 1, None, 20_000, "full")] + [(0, 1, p, 30, "no stock") for p in range(5000)]
    sizes, folds = [], []
    bounded, folded = acceptance._bounded, acceptance._folded

    def watched(state):
        sizes.append(state.count())
        return bounded(state)

    def counted(state, held):
        folds.append(state.count())
        return folded(state, held)

    monkeypatch.setattr(acceptance, "_bounded", watched)
    monkeypatch.setattr(acceptance, "_folded", counted)
    start = time.perf_counter()
    got = {r.request_id: r.reason for r in acceptance.accepted_in_turn(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(limits, LIMITS)).collect()}
    seconds = time.perf_counter() - start
    assert got == one_by_one(entries, limits)
    print(f"rounds over {sizes} entries, folds over {folds}, {seconds:.0f} s")
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0] and len(folds) < 40


def test_no_requests(spark):
    none = acceptance.accepted_in_turn(spark.createDataFrame([], ENTRY), spark.createDataFrame([], LIMITS))
    assert none.columns == ["request_id", "reason"] and none.collect() == []
