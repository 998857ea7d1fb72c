"""Fixpoints and chains: depth, cycles, nulls, repeats and hot nodes."""

from collections import deque
from decimal import Decimal
import random

import pytest

from sparkloft.operators import recursion
from sparkloft.operators.recursion import chains, reachable, with_previous

from datetime import datetime, timedelta


def brute_reach(links, seeds):
    out, queue = {s: 0 for s in seeds if s is not None}, deque(s for s in seeds if s is not None)
    while queue:
        a = queue.popleft()
        for x, y in links:
            if x == a and y is not None and y not in out:
                out[y] = out[a] + 1
                queue.append(y)
    return out


def reached(spark, links, seeds):
    rows = reachable(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(s,) for s in seeds], "node long"), "a", "b").collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.steps for r in rows}


def test_reach_of_odd_links(spark):
    links = [(1, 2), (2, 3), (3, 1), (3, 3), (1, 2), (4, 5), (None, 6), (3, None), (9, 1), (2, 7)]
    for seeds in ([1], [1, 4, 4, None], [99], [None], []):
        assert reached(spark, links, seeds) == brute_reach(links, seeds)
    assert reached(spark, [], [1]) == {1: 0}


def test_reach_is_deep_and_levels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(recursion, "COMPACT", 3)
    links = [(k, k + 1) for k in range(12)] + [(3, 0), (7, 2)]
    assert reached(spark, links, [0]) == {k: k for k in range(13)}


def test_reach_of_random_links_with_a_hot_node(spark):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(7, k) for k in range(200, 500)]
    assert reached(spark, links, [0, 1]) == brute_reach(links, [0, 1])


@pytest.mark.parametrize("few", [0, 3, 10**6])
def test_small_frontiers_are_sent_to_the_links(spark, monkeypatch, few):
    """Links are not shuffled for them; repeated links; the same nodes and steps whatever is sent."""
    monkeypatch.setattr(recursion, "FEW", few, raising=False)
    plans, kept = [], recursion.durable
    monkeypatch.setattr(recursion, "durable", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or kept(rows))
    links = [(1, k) for k in range(2, 12)] * 3 + [(k, k + 20) for k in range(2, 12)] + [(22, 40), (40, 1), (40, 41)]
    assert reached(spark, links, [1]) == brute_reach(links, [1])
    steps = [p for p in plans if "LeftSemi" in p]
    assert len(steps) == 5 and sum("strategy=broadcast" in p for p in steps) == {0: 0, 3: 3, 10**6: 5}[few]


def chased(spark, rows):
    made = [(n, p, None if v is None else Decimal(v)) for n, p, v in rows]
    got = chains(spark.createDataFrame(made, "node long, parent long, value decimal(12,2)"), "node", "parent", "value").collect()
    return {r.node: (r.root, r.hops, r.total) for r in got}


def test_chains(spark):
    """A chain of 40, a tree, a parent that is no node, null values, a cycle and what leads into it."""
    rows = [(k, k - 1 if k else None, k) for k in range(40)] + [(100, 0, 1), (101, 100, None), (102, 100, 5), (200, 999, 7), (300, 301, 1), (301, 302, 1), (302, 300, 1), (303, 300, 1), (400, 400, 2)]
    got = chased(spark, rows)
    assert all(got[k] == (0, k, Decimal(k * (k + 1) // 2)) for k in range(40))
    assert got[100] == (0, 1, 1) and got[101] == (0, 2, 1) and got[102] == (0, 2, 6) and got[200] == (200, 0, 7)
    assert all(got[k] == (None, None, None) for k in (300, 301, 302, 303, 400))
    assert chased(spark, []) == {} and chased(spark, [(1, None, None)]) == {1: (1, 0, 0)}


def test_previous_order_over_bins(spark):
    """What went before, in the own bin or the one before; ties by key; no further than the gap."""
    day = datetime(2024, 1, 1)
    r = random.Random(2)
    rows = [(k, r.randrange(3), day + timedelta(days=r.randrange(400)), 1.0) for k in range(200)]
    got = {x.o_orderkey: x.previous for x in with_previous(spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, p double"), 20).collect()}
    for k, c, at, _ in rows:
        before = max(((t, j) for j, d, t, _ in rows if d == c and (t, j) < (at, k)), default=None)
        assert got[k] == (before[1] if before and at - before[0] <= timedelta(days=20) else None)
