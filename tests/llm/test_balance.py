"""Packing by cost: each document goes to the cheapest sequence that holds it, as the plain rule says."""

import random

from spindrift.llm import packing


def plain(lengths, length):
    n = -(-sum(lengths) // length)
    room, spent, out = [length] * n, [0.0] * n, []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size, start = lengths[item], 0
        fits = [s for s in range(n) if room[s] >= size]
        if fits:
            s = min(fits, key=lambda s: (spent[s], s))
            out.append((item, 0, size, s))
            room[s] -= size
            spent[s] += packing.cost(size)
            continue
        while size:
            s = max(range(n), key=lambda s: room[s])
            part = min(size, room[s])
            out.append((item, start, part, s))
            room[s] -= part
            spent[s] += packing.cost(part)
            start, size = start + part, size - part
    return out, spent


def test_whole_documents_go_to_the_cheapest_sequence():
    rng = random.Random(9)
    for _ in range(200):
        length = 64
        lengths = [rng.randrange(1, length) for _ in range(rng.randrange(1, 60))]
        got = packing.pack(lengths, length)
        want, _ = plain(lengths, length)
        whole = lambda pieces: {(i, s) for i, start, size, s, *_ in pieces if size == lengths[i]}
        first_cut = next((k for k, (i, _, size, _) in enumerate(want) if size < lengths[i]), len(want))
        # up to the first document that fits nowhere whole the choice is the plain rule's
        assert {(i, s) for i, _, _, s, _ in got[:first_cut]} == {(i, s) for i, _, _, s in want[:first_cut]}
        assert len(whole(got)) >= first_cut and sum(p[2] for p in got) == sum(lengths)
        assert len({p[3] for p in got}) == -(-sum(lengths) // length)


def test_costs_are_balanced():
    rng = random.Random(10)
    lengths = [rng.randrange(1, 400) for _ in range(4000)]
    spent: dict[int, float] = {}
    for _, _, size, s, _ in packing.pack(lengths):
        spent[s] = spent.get(s, 0.0) + packing.cost(size)
    mean = sum(spent.values()) / len(spent)
    assert max(spent.values()) < 1.2 * mean and sum(abs(v - mean) for v in spent.values()) / len(spent) < 0.05 * mean
