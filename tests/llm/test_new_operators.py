"""Fill-in-middle, substring dedup and vector codes: edge cases, brute force, round trips."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import ann, infill, passages, quantize
from tests.llm.test_llm import docs, frame, none, odd_rows  # noqa: F401

# ---------------------------------------------------------------------------- fill-in-middle


def plain_form(i, t):
    n = len(t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_infill_equals_plain_slices_and_round_trips(spark, none):  # noqa: F811
    rows = odd_rows() + [(100 + i, t, "a") for i, t in enumerate(["a<P>b", "<", "<P", "P>", "<S<S>", "日本語" * 40, "😀" * 99, "é" * 50, "a<" * 30, ">M<" * 30, "x" * 300_001, "\n", "<Q>" * 20])]
    data = frame(spark, rows)
    got = infill.fill_in_middle(data).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    want = collections.Counter((i, *plain_form(i, t or "")) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got) == want
    assert collections.Counter((r.doc_id, r.again) for r in got) == collections.Counter((i, t or "") for i, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(none).count() == 0


@pytest.mark.parametrize("unit", infill.UNITS)
def test_infill_units_keep_whole_units(unit):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab é\n\t😀 ") for _ in range(rng.randrange(60)))
        raw = text.encode()
        mask = infill.boundaries(raw, unit)
        starts = [i for i in range(len(raw)) if mask >> len(raw) - 1 - i & 1]
        if unit == "codepoint":
            want = [len(text[:k].encode()) for k in range(len(text))]
        elif unit == "line":
            want = [0] * bool(raw) + [i + 1 for i in range(len(raw) - 1) if raw[i] == 10]
        else:
            space = lambda i: raw[i : i + 1].isspace()
            want = [0] * bool(raw) + [i for i in range(1, len(raw)) if space(i - 1) and not space(i)]
        assert starts == want and mask.bit_count() == len(want)
        ranks = sorted(rng.randrange(len(want) + 1) for _ in range(2)) if want else []
        assert infill.selected(mask, len(raw), ranks) == [(want + [len(raw)])[r] for r in ranks]


# ---------------------------------------------------------------------------- substring dedup


def brute_force(rows, window=passages.WINDOW):
    """Of (id, text) rows the (id, words, removed, kept) of each."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).digest()))
    met, out = set(), []
    for k in order:
        words = (rows[k][1] or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in met:
                gone |= set(range(i, i + window))
            met.add(w)
        out.append((rows[k][0], len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return collections.Counter(out)


def repeating_rows(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    shared = [fresh(n) for n in (20, 21, 25, 40, 19, 60)]
    rows = []
    for i in range(80):
        words = fresh(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            words += (p if rng.random() < 0.6 else p[a:b]) + fresh(rng.randrange(30))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200, "a " * 70), (201, "a b " * 50), (202, "x y z " * 15 + "a " * 40), (203, " ".join("v v v v v v " + w for w in fresh(60)))]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (301, rows[5][1]), (301, " ".join(shared[5])), (302, " ".join(shared[4])), (302, " ".join(shared[4]))]
    rows += [(None, rows[7][1]), (None, " ".join(shared[3])), (None, None), (303, ""), (304, None), (305, "   " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "busy"), [(1, passages.BUSY), (2, 0), (3, 3)])
def test_passages_equal_brute_force(spark, monkeypatch, seed, busy):
    monkeypatch.setattr(passages, "BUSY", busy)
    rows = repeating_rows(seed)
    data = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as anchor", "'x' as tag", "3 as n", "4 as own")
    got = collections.Counter(map(tuple, passages.without_repeats(data.repartition(5)).collect()))
    assert got == brute_force(rows)


def test_passages_on_nothing_and_odd_rows(docs, none):  # noqa: F811
    assert passages.without_repeats(none).count() == 0
    assert collections.Counter(map(tuple, passages.without_repeats(docs).collect())) == brute_force([(i, t) for i, t, _ in odd_rows()])


def test_passages_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    monkeypatch.setattr(passages, "PIECE_BYTES", 1000)
    parts = list(passages.pieces(text))
    assert len(parts) > 20
    seen = [(before + i, tuple(w[i : i + 20])) for before, p in parts for w in [p.split()] for i in range(len(w) - 19)]
    words = text.split()
    assert set(seen) == {(i, tuple(words[i : i + 20])) for i in range(len(words) - 19)}
    whole = passages.Windows(text + b" ", np.array([0, len(text) + 1]))
    cut = np.concatenate([passages.Windows(raw, first).anchor[passages.Windows(raw, first).valid] for _, raw, first in passages.grouped([text])])
    assert set(whole.anchor.tolist()) == set(cut.tolist())
    assert passages.word_hashes(np.frombuffer(b"x" * 2_000_000 + b" yy", np.uint8), np.array([0, 2_000_001]), np.array([2_000_000, 2_000_003])).all()


def test_shard_joins_windows_to_passages():
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}".encode() for _ in range(n)]
    shared = fresh(30)
    rows = [(1, fresh(5) + shared + fresh(5), (False, k, b""), 100 * k, False) for k in range(3)]
    shard = passages.Shard(rows)
    assert [n for _, n in shard.passages()] == [11]  # one passage of 11 windows
    verdicts = list(shard.located())
    assert verdicts == [([], [5, 35]), ([5, 35], [5, 35]), ([5, 35], [5, 35])]


# ---------------------------------------------------------------------------- vector codes


def plain_codes(rows, entries=256, rounds=4, parts=4):
    """(vec_id, label, code, error) and the codebooks, with Python's integers."""
    fine = [(i, s, v) for i, s, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    fine = [r for r in fine if len(r[2]) == len(fine[0][2])]
    if not fine:
        return [], []
    width = -(-len(fine[0][2]) // parts)
    x = [[math.floor(1024 * c) for c in v] + [0] * (width * parts - len(v)) for _, _, v in fine]
    cut = [[v[p * width : (p + 1) * width] for v in x] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for v in cut[p]:
                members[near(v, books[p])[1]].append(v)
            for k, vs in members.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [[near(cut[p][n], books[p]) for p in range(parts)] for n in range(len(fine))]
    return [(i, None if s is None else str(s), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, s, _), f in zip(fine, found, strict=True)], books


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("size", "entries"), [(300, 256), (60, 8), (5, 256), (400, 20)])
def test_codes_equal_plain_lloyd(spark, size, entries):
    rng = random.Random(size)
    base = [[rng.choice([-1, 0, 0.5, 1]) for _ in range(8)] for _ in range(9)]
    rows = [(i, rng.choice([0, 1, None]), [float(np.float32(c + rng.choice([0, 0, rng.gauss(0, 0.3)]))) for c in rng.choice(base)]) for i in range(size)]
    rows += [(3, 0, rows[3][2]), (None, 1, rows[0][2]), (900, 1, None), (901, 1, []), (902, 1, [1.0] * 7 + [None]), (903, 1, [float("nan")] * 8), (904, 1, [float("inf")] * 8), (905, 1, [1.0] * 4)]
    data = spark.createDataFrame([(i, v, s) for i, s, v in rows], VECTORS).selectExpr("*", "1 as code", "2 as error", "3 as trees").repartition(3)
    coded, books = quantize.compress(data, entries=entries)
    want, want_books = plain_codes(rows, entries)
    assert books == want_books
    assert collections.Counter(map(tuple, coded.select("vec_id", "label", "code", "error").collect())) == collections.Counter(want)


def test_codes_of_odd_inputs(spark):
    empty = spark.createDataFrame([], VECTORS)
    coded, books = quantize.compress(empty)
    assert coded.count() == 0 and books == [[], [], [], []]
    # a length that four doesn't divide, and components whose squares pass 64 bits
    rows = [(i, 0, [1e18 * (i + 1), -1e17 * i, 3.5, 0.25 * i, 1e12, -7.0]) for i in range(6)]
    data = spark.createDataFrame([(i, v, s) for i, s, v in rows], "vec_id long, embedding array<double>, label int")
    coded, books = quantize.compress(data, entries=2)
    want, want_books = plain_codes(rows, 2)
    assert books == want_books
    assert sorted(map(tuple, coded.collect())) == sorted((i, s, c, min(e, quantize.LARGEST)) for i, s, c, e in want)


def test_tree_filter_equals_full_comparison():
    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (40, 5), (700, 64)):
        x = rng.integers(-6, 7, (n, 5))  # many ties
        book = np.concatenate([rng.integers(-6, 7, (k, 5)), x[:1], x[:1]])
        tree = quantize.Tree.of(x)
        want = quantize.nearest(x, book)
        assert (quantize.assigned(tree, x, book) == want).all()
        count, total = quantize.gathered(tree, x, book)
        assert (count == np.bincount(want, minlength=len(book))).all() and all((total[e] == x[want == e].sum(axis=0)).all() for e in range(len(book)))
        (again, y), *_ = quantize.unpacked(quantize.packed([x]))
        assert (again.order == tree.order).all() and (x == y).all()


def test_ann_misses_nothing_without_structure_nor_in_a_tight_cluster(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2400, 32))
    x[::8] = 2.0 + 1e-4 * rng.normal(size=(300, 32))  # told apart by far less than a code's width
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(data, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 2400, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        top = np.lexsort((np.arange(len(x)), -s))[:20]
        assert [(i, z) for _, i, z in sorted(got[q])] == [(int(i), s[i]) for i in top]


def test_small_lists_share_cells_and_large_ones_have_many():
    of = ann.Lists.of(np.array([3, 0, 4, 25, 5, 6]), np.ones(6), np.ones(6), 10)
    assert of.first.tolist() == [0, 0, 0, 1, 4, 5] and of.cells.tolist() == [1, 1, 1, 3, 1, 1]
