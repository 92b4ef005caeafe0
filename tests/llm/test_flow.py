"""The flow of many sources: maximal, of least cost, and in time."""

import itertools
import random
import time

from spindrift.llm import mixing


def value_and_cost(patterns, flows, layers):
    cost = 0
    for (size, _), f in zip(patterns, flows, strict=True):
        left = sum(f.values())
        assert left <= layers * size
        for k in range(layers):
            part = min(size, left)
            cost += k * part
            left -= part
    return sum(sum(f.values()) for f in flows), cost


def test_small_flows_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        m, layers = rng.randrange(1, 4), rng.randrange(1, 4)
        patterns = [(rng.randrange(3), sorted(rng.sample(range(m), rng.randrange(1, m + 1)))) for _ in range(rng.randrange(1, 4))]
        quotas = [rng.randrange(5) for _ in range(m)]
        flows = mixing.min_cost_flow(patterns, quotas, layers)
        assert all(set(f) <= set(members) for (_, members), f in zip(patterns, flows, strict=True))
        assert all(sum(f.get(s, 0) for f in flows) <= q for s, q in enumerate(quotas))
        each = [[x for x in itertools.product(*[range(min(quotas[s], layers * size) + 1) for s in members]) if sum(x) <= layers * size] for size, members in patterns]
        best = None
        for pick in itertools.product(*each):
            if all(sum(x[members.index(s)] for x, (_, members) in zip(pick, patterns, strict=True) if s in members) <= q for s, q in enumerate(quotas)):
                total, cost = value_and_cost(patterns, [dict(enumerate(x)) for x in pick], layers)
                best = min(best or (-total, cost), (-total, cost))
        total, cost = value_and_cost(patterns, flows, layers)
        assert (-total, cost) == best


def test_many_patterns_are_routed_in_seconds():
    rng = random.Random(5)
    sources = 3000
    patterns = [(rng.randrange(1, 1000), [s]) for s in range(sources)] + [(rng.randrange(1, 100), sorted(rng.sample(range(sources), rng.randrange(2, 4)))) for _ in range(20_000)]
    quotas = [rng.randrange(1, 3000) for _ in range(sources)]
    began = time.perf_counter()
    flows = mixing.min_cost_flow(patterns, quotas, 3)
    assert time.perf_counter() - began < 90
    assert all(sum(f.values()) <= 3 * size for (size, _), f in zip(patterns, flows, strict=True))
