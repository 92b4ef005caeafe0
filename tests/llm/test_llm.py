"""Every dealt operator on small rows: edge cases with their defined results, and brute force."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import ann, brown, fingerprint, jaccard, licenses, mixing, packing, sharding, toxicity, warc
from spindrift.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def frame(spark, rows, schema=DOCS, extra=True):
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows] if schema == DOCS else rows
    df = spark.createDataFrame(full, schema)
    # columns whose names the operators might use themselves
    return df.selectExpr("*", "1 as h", "2 as node", "3 as bucket", "4 as size", "5 as key") if extra else df


def odd_rows(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = text(80)
    rows = [(i, text(rng.randint(1, 60)), rng.choice(["a", "b", None])) for i in range(30)]
    rows += [(30, None, "a"), (31, "", None), (32, " \t\n", "b"), (33, "one", "a"), (34, base, "a"), (35, base, "b"), (36, base.upper(), "a")]
    for i in range(37, 45):  # near copies
        w = base.split()
        w[rng.randrange(80)] = "x"
        rows.append((i, " ".join(w), "b"))
    rows += [(45, text(6000), "c"), (None, "no id here at all today", "a"), (46, "é ﬁ Å <|endoftext|> ΑΣ", "a"), (46, "é ﬁ Å <|endoftext|> ΑΣ", "a"), (46, "same id, other text", "b")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_sharding(docs, none):
    rows = sharding.shard_rows(docs, 7).collect()
    assert len(rows) == len(odd_rows()) and sharding.shard_rows(none).count() == 0
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
        assert r.permuted == sharding.permuted(r.row_number, len(rows), 20) == r.slot * 7 + r.shard and r.law == "rows" and r.grown_shard is None
    sizes = [len(v) for v in shards.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    by = {(r.doc_id, r.text_crc32, r.size) for r in rows}
    assert by == {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _ in odd_rows()}
    assert rows == sharding.shard_rows(docs.repartition(3), 7).collect() or {tuple(r) for r in rows} == {tuple(r) for r in sharding.shard_rows(docs.repartition(3), 7).collect()}


def test_rows_of_one_id_fall_into_many_buckets(spark):
    data = frame(spark, [(None if i % 3 else 5, f"text {i}", "a") for i in range(300)])
    found = data.select(sharding.bucket_of(F.col("doc_id"), F.xxhash64("text")).alias("b")).distinct().count()
    assert found > 250 and {r.slot * 40 + r.shard for r in sharding.shard_rows(data).collect()} == set(range(300))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 1000])
def test_permutation_is_one(n):
    assert sorted(sharding.permuted(x, n, 3) for x in range(n)) == list(range(n))


def test_min_cost_flow_shares_an_overlap():
    # both need 10; a alone has 6, the shared pattern 14: the first copies suffice
    flows = mixing.min_cost_flow([(6, [0]), (14, [0, 1])], [10, 10], 3)
    assert sum(f.get(0, 0) for f in flows) == 10 and sum(f.get(1, 0) for f in flows) == 10
    assert sum(flows[0].values()) <= 6 and sum(flows[1].values()) <= 14


def test_targets():
    t = mixing.level_targets([100, 10, 10], [1, 2, 3], 3)
    assert sum(t) == pytest.approx(120) and t[1:] == [30, 30]


def test_mixing(docs, none):
    rows = mixing.mixed_documents(docs).collect()
    assert len(rows) == len(odd_rows()) and mixing.mixed_documents(none).count() == 0
    want, got, most = {}, collections.Counter(), collections.Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        got[r.source] += r.taken
        want[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(got[s] - want[s]) <= most[s] for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_documents(docs.repartition(3)).collect()))
    repeated = mixing.mixed_rows(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in rows)


def test_mixing_a_capped_source_and_rows_of_one_id(spark):
    """b's share is thrice its size and so is its target; rows without an id are told apart by text."""
    rows = [(None if i % 2 else 7, f"{i} " + "w " * 40, "a") for i in range(60)] + [(i, f"v{i} v v", "b") for i in range(5)]
    data = frame(spark, rows)
    got = mixing.mixed_documents(data).collect()
    assert {r.target for r in got if r.source == "b"} == {45.0} and all(r.copies == 3 for r in got if r.source == "b")
    text = lambda df: sorted(map(str, mixing.mixed_documents(df).collect()))
    assert text(data) == text(data.repartition(5)) == text(data.orderBy(F.desc("text")))
    assert mixing.mixed_rows(data).where("source = 'b'").count() == 15


def test_mixing_overlapping_sources(spark):
    sized = spark.createDataFrame([(i, 10, ["a"] if i < 10 else ["a", "b"]) for i in range(30)], "doc_id long, size long, members array<string>")
    rows = mixing.mix(sized, {"a": 100, "b": 150}).collect()
    owners = collections.Counter(s for r in rows for s in r.taken_for)
    assert owners["a"] * 10 == pytest.approx(100, abs=10) and owners["b"] * 10 == pytest.approx(150, abs=10)
    assert all(r.copies == len(r.taken_for) <= 3 for r in rows)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack_documents(docs).collect()
    assert packing.pack_documents(none).count() == 0
    want = collections.Counter()
    for i, t, _ in odd_rows():
        want[(i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at and n > 0
            at += n
        assert at <= 2048
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r.length for r in rows) == total and len(seqs) <= total // 2048 + 2
    for (i, ids), n in want.items():
        mine = [r for r in pieces[(i, len(ids))]]
        crc = lambda a, b: zlib.crc32(np.array(ids[a:b], "<u4").tobytes())  # noqa: E731, B023
        good = [r for r in mine if crc(r.start, r.start + r.length) == r.ids_crc32]
        assert sum(r.length for r in good) >= n * len(ids)


def test_warc(spark, tmp_path):
    long, other = "<p>" + "ü" * 100, "<p>" + "y" * 120
    rows = [(5, "http://a/ b\n", long), (2, None, long), (9, "http://c", long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", other), (None, "u", "alone" * 30), (2, None, long)]
    pages = frame(spark, rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.with_roles(pages), path)
    got = sorted(warc.read_archives(spark, path).collect(), key=str)
    brute = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        first = min(same) if same and len(b) >= 100 else None
        revisit = first is not None and (i is None or i > first)
        brute.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, brute)) == sorted(str(tuple(r)[:5]) for r in got)
    # one record by id, out of its own frame; and the whole file is a plain Zstandard stream
    row = got[0]
    data = open(row.bundle.removeprefix("file:"), "rb").read()
    import zstandard

    rid = warc.record_id(row.page_id, row.payload_digest)
    record = warc.BundleReader(data).record(rid)
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert record in plain and plain.startswith(b"WARC/1.1\r\n") and rid.encode() in record
    empty = str(tmp_path / "e")
    warc.write_archives(warc.with_roles(pages.limit(0)), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_bundle_frames():
    bundle = warc.Bundle(frame_bytes=200)
    for i in range(50):
        bundle.add(f"<{i}>", warc.build_record(i, None, b"x" * 60, 60, "d", None))
    reader = warc.BundleReader(bundle.finish())
    assert len({f for _, f, _, _ in reader.index}) > 5 and b"urn:page:17:" in reader.record("<17>")


def sets_of(rows):
    out = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(rows):
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(str((i, len(s), (least.get(find(k)) if s else i))) for k, (i, s) in enumerate(sets))


def test_jaccard(docs, none):
    assert sorted(str(tuple(r)) for r in jaccard.near_duplicates(docs).collect()) == brute_components(odd_rows())
    assert jaccard.near_duplicates(none).count() == 0


@pytest.mark.parametrize("long", [jaccard.LONG, 3])
def test_jaccard_large_group(spark, monkeypatch, long):
    """One large group of near copies whose members mostly reach only its middle, and a passage; by
    coarse vectors alone, and with a fine one for every set."""
    monkeypatch.setattr(jaccard, "LONG", long)
    rng = random.Random(4)
    base, passage = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(120)], [f"p{k}" for k in range(50)]
    rows = [(0, " ".join(base), "a")]
    for i in range(1, 160):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(120)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(w), "a"))
    for i in range(160, 260):
        rows.append((i, " ".join(passage + [f"q{rng.randrange(99999)}" for _ in range(rng.randint(3, 30))]), "a"))
    got = sorted(str(tuple(r)) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows)
    kept = jaccard.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len({x.rsplit(",")[-1] for x in brute_components(rows)})


def test_jaccard_heavy_shingles_meet_over_all_places(spark, monkeypatch):
    """Every shared shingle counts as heavy: pairs, small and large groups stay linked."""
    monkeypatch.setattr(jaccard, "HEAVY", 1)
    rng = random.Random(9)
    rows = []
    for size in [2] * 15 + [5, 20, 60]:
        base = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(14)]
        rows += [(len(rows) + k, " ".join(base[:13] + [f"e{rng.randrange(9999)}"]), "a") for k in range(size)]
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert sorted(str(tuple(r)) for r in jaccard.near_duplicates(frame(spark, rows)).collect()) == brute_components(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_jaccard_shared_names_are_told_apart(docs, monkeypatch):
    """Names of so few bits that most sets share theirs with another."""
    assert sorted(str(tuple(r)) for r in jaccard.near_duplicates(docs, name_bits=4).collect()) == brute_components(odd_rows())


def test_candidate_groups_and_forests_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k % 3 :], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for k in range(9)] + [rng.integers(0, 1 << 63, 60).astype(np.uint64)]
    data = [jaccard.count_vector(s) for s in sets]
    block = pa.RecordBatch.from_arrays([pa.array([7] * 10), pa.array(range(10)), pa.array([len(s) for s in sets]), pa.array(data, pa.binary())], names=["h", "node", "n", "data"])
    found = [m for b in jaccard._near_groups(iter([block.slice(0, 4), block.slice(4)])) for m in b.column(0).to_pylist()]
    assert found == [list(range(9))]
    group = pa.RecordBatch.from_arrays([pa.array([1] * 9), pa.array(range(9)), pa.array([0, 0, 2, 3, 4, 5, 6, 7, 8]), pa.array([np.sort(s).tobytes() for s in sets[:9]], pa.binary())], names=["g", "node", "label", "set"])
    links = [tuple(r.values()) for b in jaccard._forests(iter([group.slice(0, 5), group.slice(5)])) for r in b.to_pylist()]
    assert len(links) == 7 and {x for pair in links for x in pair} >= set(range(2, 9))


def test_fine_vectors_tell_long_sets_apart():
    """Of sets of 20,000 shingles the coarse bound lets every pair through, the fine one near copies."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) for _ in range(4)]
    sets.append(np.unique(np.concatenate([sets[1][:18_500], rng.integers(0, 1 << 63, 900).astype(np.uint64)])))
    assert jaccard.linked(sets[1], sets[4])
    fine = next(jaccard._fine_vectors(iter([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])]))).column(1).to_pylist()
    for given, expected in ((fine, [[1, 4]]), ([None] * 5, [[0, 1, 2, 3, 4]]), ([*fine[:4], None], [[0, 1, 2, 3, 4]])):
        columns = [pa.array([1] * 5), pa.array(range(5)), pa.array([len(s) for s in sets]), pa.array([jaccard.count_vector(s) for s in sets], pa.binary()), pa.array(range(5)), pa.array(given, pa.binary())]
        group = pa.RecordBatch.from_arrays(columns, names=["g", "node", "n", "data", "label", "fine"])
        assert [m for b in jaccard._still_open(iter([group.slice(0, 2), group.slice(2)])) for m in b.column(0).to_pylist()] == expected


def test_count_tree_loses_nothing():
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(900, rng.integers(5, 200), replace=False).tolist()) for _ in range(150)]
    sets += [set(list(s)[2:]) | {1000 + k} for k, s in enumerate(sets[:60])]
    vectors = np.array([np.bincount([x % 64 for x in s], minlength=64) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(vectors, sizes)
    for i, s in enumerate(sets):
        found = set(tree.search(vectors[i], sizes[i]).tolist())
        assert all(j in found for j, t in enumerate(sets) if 100 * len(s & t) >= 80 * len(s | t))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[12] == 10 and got[140] == 100


def test_fingerprint(docs, none):
    rows = fingerprint.fingerprints(docs).collect()
    assert len(rows) == len(odd_rows()) and fingerprint.fingerprints(none).count() == 0
    canon = lambda x: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).upper().lower()).split())
    seen, edited = collections.defaultdict(set), set()
    by_size = collections.defaultdict(list)
    for r in rows:
        by_size[(r.doc_id, r.n_chars)].append(r)
        edited.add(r.edited_sha256)
        assert r.near_next in (0.0, 1.0) and r.near_edited == float(r.fingerprint == r.edited_fingerprint)
    for i, t, _ in odd_rows():
        for r in by_size[(i, len(t or ""))]:
            seen[canon(t or "")].add(r.fingerprint)
    assert all(len(v) == 1 for v in seen.values()) and len({f for v in seen.values() for f in v}) == len(seen)
    plain = sorted(((i, t or "") for i, t, _ in odd_rows() if i is not None and i < 45))
    for (i, t), (_, nxt) in zip(plain, plain[1:]):
        h = len(t) // 2
        assert hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest() == by_size[(i, len(t))][0].edited_sha256


def test_fingerprint_numbers_colliding_forms(spark):
    found = spark.createDataFrame([(1, 1, 7, 8, "b"), (2, 2, 7, 8, "a"), (3, 3, 7, 8, "b"), (4, 4, 9, 9, None)], "doc_id long, key long, h1 long, h2 long, form string")
    assert {(r.doc_id, r.number) for r in fingerprint.collisions(found).collect()} == {(1, 1), (3, 1)}


def test_licenses(spark, docs, none):
    line, mit = licenses.TEMPLATES["Apache-2.0 line"], licenses.TEMPLATES["MIT"]
    edited = " ".join(w for k, w in enumerate(mit.split()) if k % 9)
    rows = [(1, f"a b the {line} c the license d {line}", "s"), (2, f"x {edited} the license y", "s"), (3, "the license of version", "s"), (4, None, "s")]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (got[1].license, got[1].coverage, got[1].first_word) == ("Apache-2.0 line", 1.0, 3)
    assert got[2].license == "MIT" and 0.85 < got[2].coverage < 0.95 and got[3].license is None and got[4].coverage == 0
    assert licenses.scan_licenses(docs).where("license is not null").count() == 0 and licenses.scan_licenses(none).count() == 0


def test_every_license_template_is_found_under_its_name():
    scanner = licenses.Scanner()
    assert scanner.scan(b"some words. All rights reserved. more words")[:2] == ("All rights reserved line", 1.0)
    assert {"BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "LGPL-2.1", "CC-BY-SA-4.0 line", "MIT text", "Apache-2.0 text", "GPL-3 text"} <= set(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert scanner.scan(f"before {text} after".encode())[:2] == (name, 1.0)


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Released under the BSD License.", "BSD line"),
        ("Released under the Foo License.", None),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0 short line"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0 line"),
        ("Licensed under CC BY-NC 3.0.", None),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0 line"),
        ("This work is licensed under the GNU General Public License, version 7.", None),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0 line"),
        ("This work is licensed under the GNU General Public License version 3.", "GPL-3.0 line"),
        ("Released by us under the MIT License.", "MIT line"),
    ],
)
def test_license_lines_are_told_apart(text, name):
    assert licenses.Scanner().scan(f"before it {text} after it".encode())[0] == name
    # templates that lack the sibling don't take its place
    few = {k: v for k, v in licenses.TEMPLATES.items() if k in ("MIT line", "GPL-3.0 line", "CC-BY-NC-4.0 line")}
    assert licenses.Scanner(few).scan(f"before it {text} after it".encode())[0] in (None, name)


def test_all_notices_of_a_text_are_listed(spark):
    line, mit = licenses.TEMPLATES["Apache-2.0 line"], licenses.TEMPLATES["MIT"]
    edited = " ".join(w for k, w in enumerate(mit.split()) if k % 20)
    rows = [(1, f"a b {line} c d {edited} e {line} {line}", "s"), (2, None, "s")]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert [(n.license, n.first_word) for n in got[1].notices][0] == ("Apache-2.0 line", 2)
    assert [n.license for n in got[1].notices] == ["Apache-2.0 line", "MIT", "Apache-2.0 line", "Apache-2.0 line"]
    assert got[1].license == "MIT" and 0.9 < got[1].coverage < 1 and got[2].notices == []


def test_alignment_is_common_and_increasing():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice(b"abcdefgh") for _ in range(rng.randrange(20))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_brown(docs, none):
    held = toxicity.id_crc() % 7 == 2
    rows = brown.score(docs, held).collect()
    assert len(rows) == len(odd_rows()) and brown.score(none, held).count() == 0
    tok = lambda t: (t or "").encode().lower().split() + [b" "]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t, _ in odd_rows() if not out(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((len(tok(t)), sum(c[w] > 0 for w in tok(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 5), out(i)) for i, t, _ in odd_rows())
    assert want == sorted((r.n_tokens, r.n_known, round(r.base_score, 5), r.held_out) for r in rows)
    assert all(r.train_tokens == n and r.score <= 0 for r in rows)


def test_brown_beats_the_unigram_on_two_languages(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{min(int(rng.expovariate(0.1)), 40)}" for _ in range(80)), "s") for i in range(200)]
    got = brown.score(frame(spark, rows), toxicity.id_crc() % 7 == 2).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b + 100


def test_brown_end_token_rarer_than_the_ranked_words(spark, monkeypatch):
    monkeypatch.setattr(brown, "UNIT_WORDS", 4)
    monkeypatch.setattr(brown, "HOT_WORDS", 8)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[:20]) for _ in range(200)), "s") for i in range(20)]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tok = lambda t: t.encode().split() + [b" "]
    c = collections.Counter(w for i, t, _ in rows if not out(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in brown.score(frame(spark, rows), toxicity.id_crc() % 7 == 2).collect()}
    for i, t, _ in rows:
        assert got[i].n_known == sum(c[w] > 0 for w in tok(t)) and math.isfinite(got[i].score) and got[i].score <= 0
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)))


def test_brown_gives_words_outside_the_units_their_class(spark, monkeypatch):
    """Two languages; rare words of both end alike, so only their neighbours tell them apart. The
    score is recomputed from the classes, and each context's probabilities sum to one."""
    monkeypatch.setattr(brown, "UNIT_WORDS", 20)
    monkeypatch.setattr(brown, "HOT_WORDS", 60)
    rng = random.Random(2)
    pick = lambda k: f"{'ab'[k]}{min(int(rng.expovariate(0.3)), 9)}" if rng.random() < 0.8 else f"r{rng.randrange(60)}{'ab'[k]}xyz"
    rows = [(i, " ".join(pick(i % 2) for _ in range(120)), "s") for i in range(150)]
    data = frame(spark, rows).select("doc_id", "text", F.lit(False).alias("held_out"))
    v, _, words, hot_class, owner, mass, _ = brown._learned(data.select("doc_id", "held_out", "text"))
    cls = {r.word: (r.c, r["class"]) for r in words.collect()}
    assert len(cls) == v.distinct and sum(c for c, _ in cls.values()) == v.total
    sides = [{cls[w][1] for w in cls if w.endswith(f"{x}xyz")} for x in "ab"]
    assert not sides[0] & sides[1]
    n = len(mass)
    pairs = np.zeros((n, n))
    seqs = [[cls[w][1] for w in t.split()] for _, t, _ in rows]
    for q in seqs:
        for a, b in zip([n - 1, *q], [*q, n - 1]):
            pairs[a, b] += 1
    gains = brown.class_gains(pairs, mass, v.total, v.distinct)
    u = lambda c: (c + 1) / (v.total + v.distinct + 1)
    for a in range(n):
        seen = sum(u(c) * 10 ** gains[a, k] for c, k in cls.values())
        assert seen + sum(u(0) * 10 ** gains[a, k] for k in range(n - 1)) == pytest.approx(1)
    got = {r.doc_id: r.score for r in brown.score(frame(spark, rows), F.lit(False)).collect()}
    for (i, t, _), q in zip(rows, seqs):
        want = sum(math.log10(u(cls[w][0])) for w in t.split()) + math.log10(u(cls[" "][0])) + sum(gains[a, b] for a, b in zip([n - 1, *q], [*q, n - 1]))
        assert got[i] == pytest.approx(want)


def test_exchange_moves_a_word_to_its_language():
    owner = np.array([0, 0, 1, 0, 2])  # units 0, 1 follow each other, and 2, 3 do; 3 is misplaced
    after = np.array([[100, 0, 0], [100, 0, 0], [50, 50, 0], [50, 50, 0], [0, 0, 0]])
    new, moved = brown.exchange(owner, after, after.copy(), 4, np.arange(5))
    assert moved and new[0] == new[1] != new[2] == new[3] and new[4] == 2


def test_toxicity(spark, docs, none):
    rng = random.Random(5)
    text = lambda bad: " ".join(rng.choice(WORDS) for _ in range(40)) + (" you idiot " + rng.choice(["moron", "m0ron", "gruxling"]) if bad else "")
    rows = [(i, text(i % 5 == 0), "s") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)] + [(7, None, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    data = frame(spark, rows)
    model = toxicity.fit(data, labels, toxicity.training_rows())
    got = toxicity.score(data, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    clean = toxicity.without_toxic(data, model)
    assert clean.columns == data.columns and clean.count() == sum(r.predicted == 0 for r in got)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    assert toxicity.score(none, model).count() == 0
    bare = toxicity.fit(data, labels.limit(0), toxicity.training_rows())
    assert {r.score for r in toxicity.score(docs, bare).collect()} == {0.0}


def test_toxicity_learns_nothing_from_noise(spark):
    """Labels without any ground: a lexicon that had seen a part's labels would make the calibration sure of itself."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(30)), "s") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(rng.random() < 0.4)) for i in range(600)], "doc_id long, quality int, toxic int")
    data = frame(spark, rows)
    got = toxicity.score(data, toxicity.fit(data, labels, toxicity.training_rows())).collect()
    held = [r.score for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(s >= 0.7 for s in held) / len(held) < 0.1 and abs(sum(held) / len(held) - 0.4) < 0.15


def test_toxicity_of_few_labels_and_repeated_ids(spark):
    rows = [(i, f"text {i % 7} you idiot" if i < 8 else f"text {i % 7}", "s") for i in range(60)] + [(3, None, "s"), (3, "z again", "s")]
    few = spark.createDataFrame([(i, 1, int(i < 8)) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), few, F.lit(True))
    assert model.trees is None and model.constant == 8 / 60  # 8 of 60 are toxic, fewer than 10


def test_isotonic_is_monotone():
    at, share = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(share) == sorted(share) and list(at) == sorted(at)


def test_ann(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 16))
    v[300:340] = v[300]  # a hot vector
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(600)]
    rows += [(600, None), (620, [0.0] * 16), (640, [None] + [1.0] * 15), (660, [float("nan")] + [1.0] * 15), (680, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    data = frame(spark, rows, "vec_id long, embedding array<float>")
    got = ann.nearest(data, data["vec_id"] % 20 == 0).collect()
    x = np.array([r[1] for r in rows[:600]])
    near = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        near[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        top = np.lexsort((np.arange(600), -s))[:20]
        hits += len(set(top) & {i for i, _ in near[q]})
        total += 20
        assert len(near[q]) == 20 and all(abs(s[i] - z) < 1e-9 for i, z in near[q]) and [z for _, z in near[q]] == sorted((z for _, z in near[q]), reverse=True)
    assert hits / total >= 0.9 and set(near) == set(range(0, 600, 20))
    assert ann.nearest(data.limit(0), data["vec_id"] % 20 == 0).count() == 0
    uneven = frame(spark, [*rows, (700, [1.0] * 3), (701, [2.0] * 3)], "vec_id long, embedding array<float>")
    assert sorted(got) == sorted(ann.nearest(uneven, uneven["vec_id"] % 20 == 0).collect())
    few = data.where("vec_id < 5")
    assert few.count() == 5 and ann.nearest(few, few["vec_id"] == 0).count() == 4


def test_ann_ties_and_repeated_rows(spark):
    rows = [(k % 50, [float(k % 5 == 0), 1.0, 0.0, 0.5]) for k in range(100)]  # every row twice, many alike
    got = ann.nearest(frame(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20, k=12).collect()
    near = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])]
    # the query row is there twice but asks once, doesn't find its own id, and ties go to the smaller
    assert near == [(i, 2.25) for i in (0, 0, 5, 5, 10, 10, 15, 15, 25, 25, 30, 30)]


def representatives(rows):
    """Of (id, text, other) rows those that stay: per component the smallest id (null last), then the
    smallest hash of the text, then the smallest other column; all without words."""
    def words(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            groups[top(i)].append(rows[i])
    return groups, [r for r, s in zip(rows, sets, strict=True) if not s]


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    a, b, c, d = text(30), text(30), text(40), text(50)
    near = c.split()
    near[3] = "other"
    rows = [(5, a, "x"), (3, b, "x"), (5, b, "x"), (None, a, "x"), (None, b, "y"), (None, d, "m"), (None, d.upper(), "k"), (7, c, "z"), (7, " ".join(near), "a"), (9, c, "q")]
    rows += [(11, text(9), "p"), (11, text(9), "p"), (12, "", "e"), (12, "", "e"), (None, None, "n"), (None, " ", "n")]
    same = text(25)
    rows += [(20, same, "b"), (20, same, "a"), (20, same, "a"), (21, same, None)]
    data = spark.createDataFrame([(i, t, o, o, len(t or "")) for i, t, o in rows], DOCS).selectExpr("*", "1 as node", "2 as label", "map('k', n_chars) as row", "4 as `text_hash`", "5 as words")
    groups, wordless = representatives(rows)
    hashed = {r.text: r.h for r in data.select("text", F.xxhash64("text").alias("h")).collect()}
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]], r[2] is not None, r[2] or "")) for g in groups.values()] + wordless
    for parts in (1, 7):
        kept = jaccard.one_of_each(data.repartition(parts))
        assert kept.columns == data.columns
        got = kept.select("doc_id", "text", "lang").collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = odd_rows()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = pipeline.without_toxic(spark, docs, d)
    assert clean.columns == docs.columns and collections.Counter(map(tuple, clean.select("doc_id", "text").collect())) == collections.Counter((i, t) for i, t, _ in rows)
    kept = pipeline.near_duplicates(spark, clean, d)
    groups, wordless = representatives(rows)
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]])) for g in groups.values()] + wordless
    assert kept.columns == docs.columns and collections.Counter(map(tuple, kept.select("doc_id", "text").collect())) == collections.Counter((i, t) for i, t, _ in want)
    packed = pipeline.run(spark, d)
    assert packed.count() > 0 and {r.doc_id for r in packed.select("doc_id").collect()} <= {r.doc_id for r in kept.collect()}


def test_pipeline_on_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline as pipeline

    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
