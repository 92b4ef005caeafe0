"""Values of likeness, toxicity features and trees against plain versions."""

import random
import unicodedata

import numpy as np

from spindrift.llm import fingerprint, toxicity
from tests.llm.test_llm import frame


def canon(x):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).upper().lower()).split())


def test_likeness_to_the_next_and_to_the_edited_text(spark):
    rng = random.Random(3)
    texts = [rng.choice(["One  two", "ONE two", "one two three", "ﬁne Å", "FINE å", "", "x", "a b", "B a", "ab ab ab ab", "AB ab"]) for _ in range(60)]
    rows = [(3 * i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    for k, (i, t, _) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].near_next == float(canon(t) == canon(nxt)), (t, nxt)
        assert got[i].near_edited == float(canon(t) == canon(edited)), (t, edited)


def test_features_are_what_they_say():
    judge = toxicity.Judge(frozenset({"zork"}), frozenset({"blar"}))
    text = "You ZORK! blarney b.l.a.r.x z0rk zooork, yes? IDIOT 12 a_b"
    f = dict(zip(toxicity.NAMES, toxicity.features(text.encode(), judge), strict=True))
    n, size = 10, len(text)
    assert np.isclose(f["words"], np.log1p(n)) and np.isclose(f["chars"], np.log1p(size))
    assert np.isclose(f["lexicon"], np.log1p(2)) and np.isclose(f["stem_rate"], 1 / n)  # zork, idiot; blarney
    assert np.isclose(f["hidden_rate"], 3 / n)  # b.l.a.r.x, z0rk, zooork
    assert np.isclose(f["hit_rate"], 6 / n) and f["most_in_span"] == 6 and np.isclose(f["second_rate"], 1 / n)
    assert f["near_second"] == sum(abs(p) <= toxicity.NEAR for p in (1, 2, 3, 4, 5, 7))
    assert np.isclose(f["capital_words"], 2 / n) and np.isclose(f["capitals"], sum(c.isupper() and c.isascii() for c in text) / size)
    assert np.isclose(f["exclaims"], 1 / size) and np.isclose(f["questions"], 1 / size) and np.isclose(f["digits"], 3 / size)
    assert toxicity.features(b" \n", judge) == [0.0] * len(toxicity.NAMES)


def test_a_tree_splits_where_the_gain_is_largest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 2] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    trees = toxicity.Trees(depth=1, rounds=1, bins=32).fit(x, y)
    which, cut, value = trees.trees[0]
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    best = None
    for j in range(4):
        coded = np.searchsorted(trees.cuts[j], x[:, j], side="right")
        for c in range(34):
            left = coded <= c
            if min(left.sum(), (~left).sum()) < trees.least:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + trees.penalty) for s in (left, ~left))
            if best is None or gain > best[0] + 1e-12:
                best = (gain, j, c, [trees.rate * g[s].sum() / (h[s].sum() + trees.penalty) for s in (left, ~left)])
    assert (which[0], cut[0]) == best[1:3] and np.allclose(value, best[3])
    assert np.allclose(trees.raw(x), trees.base + np.where(np.searchsorted(trees.cuts[which[0]], x[:, which[0]], side="right") <= cut[0], *best[3]))


def test_isotonic_blocks_are_the_means_of_violators():
    at, share = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1]))
    assert list(share) == sorted(share) and np.allclose(np.interp([0.1, 0.25, 0.5], at, share), [0, 0.5, 1])
