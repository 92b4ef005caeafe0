"""Verbatim copies, altered copies and everyday notices; the time in proportion to the text."""

import itertools
import random
import time

import pytest

from spindrift.llm import licenses


def test_increasing_is_a_longest_one():
    rng = random.Random(1)
    for _ in range(200):
        xs = rng.sample(range(30), rng.randrange(1, 9))
        got = [xs[i] for i in licenses.increasing(xs)]
        most = max(n for n in range(1, len(xs) + 1) for c in itertools.combinations(xs, n) if list(c) == sorted(c))
        assert got == sorted(got) and len(got) == most


def test_coverage_is_the_common_subsequence_of_texts_without_repeats():
    """With words unique on both sides patience alignment is a longest common subsequence."""
    rng = random.Random(2)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    for _ in range(60):
        a = [f"w{i}".encode() for i in rng.sample(range(40), 25)]
        b = [w for w in a if rng.random() < 0.85] + [f"x{i}".encode() for i in range(4)]
        for _ in range(rng.randrange(4)):
            i, j = rng.randrange(len(b)), rng.randrange(len(b))
            b[i], b[j] = b[j], b[i]
        pairs = licenses.align(a, b)
        assert len(pairs) == common(a, b) and all(a[i] == b[j] for i, j in pairs)
        text = b" ".join([b"before"] * 7 + b + [b"after"] * 7)
        found = licenses.Scanner({"t": b" ".join(a).decode()}).matches(text)
        assert [round(m[1], 9) for m in found] == ([round(len(pairs) / 25, 9)] if len(pairs) >= 20 else [])


def test_verbatim_copies_are_all_claimed():
    rng = random.Random(3)
    few = {"one": "a b c d e f g", "two": "a b c d e f g h i", "three": "x y z", "four": "m n o p q r a b"}
    scanner = licenses.Scanner(few)
    for _ in range(100):
        words = [rng.choice("kuvw") for _ in range(rng.randrange(9))]
        for _ in range(rng.randrange(6)):
            words += few[rng.choice(list(few))].split() + [rng.choice("kuvw") for _ in range(rng.randrange(1, 5))]
        want, i = [], 0
        while i < len(words):
            here = [n for n in few if words[i : i + len(few[n].split())] == few[n].split()]
            if here:
                name = max(here, key=lambda n: len(few[n].split()))
                want.append((name, 1.0, i))
                i += len(few[name].split())
            else:
                i += 1
        assert [(m[0], m[1], m[3]) for m in scanner.matches(" ".join(words).encode())] == want


def test_a_verbatim_text_after_another_counts_whole_and_time_is_linear():
    scanner = licenses.Scanner()
    gpl, apache = licenses.TEMPLATES["GPL-3 text"], licenses.TEMPLATES["Apache-2.0 text"]
    assert [(m[0], m[1]) for m in scanner.matches(f"{gpl} {apache}".encode())] == [("GPL-3 text", 1.0), ("Apache-2.0 text", 1.0)]
    began = time.perf_counter()
    assert [m[0] for m in scanner.matches(" ".join([gpl] * 10).encode())] == ["GPL-3 text"] * 10
    assert scanner.matches(" ".join(sorted(gpl.split()) * 5).encode()) == []
    edited = " ".join(w for t in (gpl, apache, gpl) for i, w in enumerate(t.split()) if i % 11)
    assert [(m[0], m[1] > 0.88) for m in scanner.matches(edited.encode())] == [("GPL-3 text", True), ("Apache-2.0 text", True), ("GPL-3 text", True)]
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("/* SPDX-License-Identifier: MIT */", ["MIT SPDX line"]),
        ("SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0-or-later SPDX line"]),
        ("SPDX-License-Identifier: GPL-3.0-only", ["GPL-3.0-only SPDX line"]),
        ("This project is licensed under the terms of the MIT license.", ["MIT terms line"]),
        ("Released under the GNU General Public License v3.0.", ["GPL-3.0 v line"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0 line"]),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["EPL-2.0 line"]),
        ("Released under the Unlicense.", ["Unlicense line"]),
        ("Apache License, Version 2.0 or MIT license at your option", ["Apache-2.0 option line", "MIT option line"]),
        ("All rights are reserved by the owner", []),
        ("All rights reserved", ["All rights reserved line"]),
        ("The mit and the license are released under review", []),
    ],
)
def test_everyday_notices(text, names):
    assert [m[0] for m in licenses.Scanner().matches(f"some words {text} some more".encode())] == names
