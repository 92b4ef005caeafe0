"""N-gram Jaccard join: documents whose sets of word shingles overlap by 80 % or more.

1. Every document's set is hashed (64-bit shingles, whole texts); equal sets are one *class*, so a
   group of exact copies is one row from then on. The set's *count vector* tells how many of its
   shingles fall into each of ``GROUPS`` hash groups.
2. Blocks. Two sets that reach the threshold share one of their first n - ceil(.8 n) + 1 shingles
   in any common order of all shingles. The order used is by an approximate document frequency
   (a table of 2**``SKETCH_BITS`` counters over all documents), then by hash: common passages come
   last, so they fill no block unless a text consists of them. Any order gives the same result.
3. In a block, count vectors are points of an R-tree. A node keeps the largest coordinates and the
   smallest set below it; since an overlap is at most the sum of coordinate minima, a subtree (or
   a pair) whose bound misses the threshold is left out. What a block sends on is not its pairs but
   its *candidate groups*: the members of each component of surviving pairs, one row a member.
4. First the pairs of one star a group are verified on the sets themselves, which joins most near
   copies. Where a group isn't in one component by then, its sets meet in one task, which verifies
   its surviving pairs and returns a spanning forest of the links, at most one a member. A pair
   whose two sets are linked already, over others, needs no comparison; any other isn't left out.
   Before long sets travel, their pairs meet the same bound over ``FINE_GROUPS`` finer groups: with
   few groups any two sets of some 15,000 shingles look alike.

Blocks of more than ``SMALL_BLOCK`` rows are cut into cells of about ``CELL`` rows. First the rows
of one in ``PIVOT_SHARE`` such blocks are compared with the block's most central one (found by
cells, then by cells of cells), which joins most members of a group of near copies by one link
each. Then the blocks that aren't yet in one component are done cell against cell: each row's best
candidate first, then, with the components these make, as in 3 and 4. Rows of one component need no
comparison. Components are exact. The work on a group of near copies
grows with the members its centre doesn't reach times all its members; what is sent on never does.

Nothing but counters of fixed size reaches the driver. Texts never move: each pass over them gives
narrow rows, and only sets of candidate groups and of large blocks are shuffled. A class is named
by 64 bits of its digest; where two different sets share them (looked up over all classes), both
are named by the other 64 bits.

Defined results: a text without words (or null) has no shingles, links with nothing and is its own
component; fewer than five words are one shingle; repeated rows are one class; a class without any
non-null doc_id has a null component unless linked to one that has; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import WORD, staged, table, unstaged, utf8_column
from spindrift.llm.components import components

SHINGLE, PERCENT = 5, 80
GROUPS, SKETCH_BITS = 512, 20
SMALL_BLOCK, CELL, CELL_SHINGLES, FANOUT, FANIN = 32, 256, 1 << 20, 16, 256
#: Shared names of sets the driver looks at (about 70 are to be expected among 5 * 10**10 sets).
MOST_SHARED = 10_000
#: Of the shingles of a large block, one in so many serves the pivot round.
PIVOT_SHARE = 8
#: Sets of more shingles than LONG have a count vector of FINE_GROUPS groups too.
LONG, FINE_GROUPS = 4_096, 8_192
#: A shingle counted more often than this is dealt over several tasks.
HEAVY = 1_000_000
SALTS = 64
#: Figures of one large block are joined to its rows by (block, one of so many salts).
SPREAD = 16
#: Texts hashed together, rows taken from a batch at once, and names a task remembers to spare repeats: bounds of memory.
CHUNK_BYTES, SLICE, REMEMBERED = 1 << 18, 1024, 1 << 16

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
PLACES = mixed(np.arange(301, 301 + SHINGLE, dtype=np.uint64)) | _U(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse mod 2**64, k below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        inverse = pow(BASE, -1, 1 << 64)
        made = []
        for b in (BASE, inverse):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 4 * CHUNK_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for some in _chunks(texts):
        raw = b" ".join(some).lower() + b" "
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        first_byte = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(raw, np.uint8)
        gap = SPACE[data]
        edges = np.flatnonzero(np.diff(gap, prepend=True))
        starts, ends = edges[0::2], edges[1::2]
        power, inverse = _powers(len(data))
        sums = np.concatenate([[_U(0)], np.cumsum(BYTES[data] * power[: len(data)], dtype=np.uint64)])
        words = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        bounds = np.searchsorted(starts, first_byte)
        n = max(0, len(words) - SHINGLE + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            rolled += words[k : k + n] * PLACES[k]
        rolled = mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(rolled[a : b - SHINGLE + 1])
            elif b > a:
                short = (words[a:b] * PLACES[: b - a]).sum(dtype=np.uint64) + _U(b - a)
                yield mixed(np.array([short]) ^ _U(0xA5A5A5A5A5A5A5A5))
            else:
                yield np.zeros(0, np.uint64)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def identity(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set, as two signed 64-bit numbers; the first names its class."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), SLICE):
            yield batch.slice(i, SLICE)


class Names:
    """Of the sets of a task, the names not met before (as far as they are remembered)."""

    def __init__(self, bits: int, shared: frozenset[int]):
        self.mask, self.shared, self.met = (1 << bits) - 1 if bits < 64 else -1, shared, set()

    def both(self, s: np.ndarray) -> tuple[int, int]:
        first, second = identity(s)
        return first & self.mask, second

    def of(self, s: np.ndarray) -> int:
        first, second = self.both(s)
        return second if first in self.shared else first

    def fresh(self, name) -> bool:
        if name in self.met:
            return False
        if len(self.met) >= REMEMBERED:
            self.met.clear()
        self.met.add(name)
        return True


def cell_of(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SKETCH_BITS)).astype(np.int64)


def count_vector(s: np.ndarray, groups: int = GROUPS) -> bytes:
    """The counts of so many groups, of one byte each if they fit, else of four."""
    counts = np.bincount((s & _U(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes()


def vectors_of(raw: list[bytes], groups: int = GROUPS) -> np.ndarray:
    if all(len(r) == groups for r in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), groups)
    return np.stack([np.frombuffer(r, np.uint8 if len(r) == groups else "<u4").astype(np.uint32) for r in raw])


def prefix(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    n = len(s)
    keep = n - -(-PERCENT * n // 100) + 1
    return s[np.lexsort((s, sketch[cell_of(s)]))[:keep]]


def reaches(overlap, both) -> np.ndarray:
    """Whether an overlap of two sets of ``both`` elements in all reaches the threshold."""
    return (100 + PERCENT) * overlap >= PERCENT * both


# ---------------------------------------------------------------------------- passes over the texts

SEEN = "kind int, doc_id long, n long, node long, node2 long, data binary"


def _described(bits: int):
    """Kind 0: a document. Kind 1: a block of the task's document frequencies (node: its number)."""

    def out(rows) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "doc_id", "n", "node", "node2", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(bits, frozenset())
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in slices(batches):
            rows, met = [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(list(utf8_column(batch.column(1)))), strict=True):
                if not len(s):
                    rows.append((0, doc, 0, None, None, None))
                    continue
                who = names.both(s)
                rows.append((0, doc, len(s), *who, count_vector(s)))
                if names.fresh(who):
                    met.append(cell_of(s))
            if met:
                cells, times = np.unique(np.concatenate(met), return_counts=True)
                counts[cells] += times.astype(np.int32)
            yield out(rows)
        step = len(counts) // 16
        yield out([(1, None, None, i, None, counts[i * step : (i + 1) * step].astype("<i8").tobytes()) for i in range(16)])

    return run


def _sums(t: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(x, "<i8") for x in t.column("data").to_pylist()), np.int64(0))
    return pa.table({"node": pa.array([t.column("node")[0].as_py()], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})


def frequencies(seen: DataFrame) -> np.ndarray:
    parts = seen.where("kind = 1").select("node", "data", (F.spark_partition_id() % SALTS).alias("salt"))
    rows = parts.groupBy("node", "salt").applyInArrow(_sums, "node long, data binary").groupBy("node").applyInArrow(_sums, "node long, data binary").collect()
    found = {r["node"]: np.frombuffer(bytes(r["data"]), "<i8") for r in rows}  # 2**SKETCH_BITS counters
    return np.concatenate([found[i] for i in range(16)]) if found else np.zeros(1 << SKETCH_BITS, np.int64)


def _prefixes(sketch: np.ndarray, bits: int, shared: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(bits, shared)
        for batch in slices(batches):
            hs, nodes = [], []
            for s in shingle_sets(list(utf8_column(batch.column(0)))):
                if len(s) and names.fresh(who := names.of(s)):
                    hs.append(prefix(s, sketch))
                    nodes.append(np.full(len(hs[-1]), who))
            if hs:
                h = np.concatenate(hs)
                heavy = sketch[cell_of(h)] > HEAVY
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(heavy)], names=["h", "node", "heavy"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, node): small blocks as member lists, rows of larger ones one by one.
    A heavy shingle's rows lie in several tasks, so each of them goes on as it is."""
    h, nodes, long, spread = None, [], False, False
    small: list[list[int]] = []
    big: list[tuple[int, int, bool]] = []

    def out() -> pa.RecordBatch:
        members = [*small, *([None] * len(big))]
        hs, ns, spreads = ([None] * len(small) + [x[i] for x in big] for i in range(3))
        small.clear()
        big.clear()
        return pa.RecordBatch.from_arrays([pa.array(members, pa.list_(pa.int64())), pa.array(hs, pa.int64()), pa.array(ns, pa.int64()), pa.array(spreads, pa.bool_())], names=["members", "h", "node", "heavy"])

    for batch in batches:
        hs, ns, heavy = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
        if not len(hs):
            continue
        # drop rows that repeat, then rows whose shingle is alone within the batch
        fresh = np.ones(len(hs), bool)
        fresh[1:] = (hs[1:] != hs[:-1]) | (ns[1:] != ns[:-1])
        hs, ns, heavy = hs[fresh], ns[fresh], heavy[fresh]
        cuts = np.flatnonzero(np.diff(hs)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(hs)]])
        keep = (ends - starts > 1) | heavy[starts]
        keep[0] = keep[-1] = True  # runs may go on in another batch
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            if hs[a] != h:
                if not long and len(nodes) > 1:
                    small.append(nodes)
                h, nodes, long, spread = hs[a], [], bool(heavy[a]), bool(heavy[a])
            for node in ns[a:b].tolist():
                if nodes and node == nodes[-1]:
                    continue
                nodes.append(node)
                if not long and len(nodes) > SMALL_BLOCK:
                    big.extend((int(h), x, spread) for x in nodes)
                    long = True
                elif long:
                    big.append((int(h), node, spread))
                    nodes = nodes[-1:]
        if small or big:
            yield out()
    if not long and len(nodes) > 1:
        small.append(nodes)
    if small or big:
        yield out()


def _sets_of(wanted: np.ndarray, bits: int, shared: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(bits, shared)
        for batch in slices(batches):
            nodes, sets = [], []
            for s in shingle_sets(list(utf8_column(batch.column(0)))):
                if len(s) and wanted[(who := names.of(s)) & (len(wanted) - 1)] and names.fresh(who):
                    nodes.append(who)
                    sets.append(s.tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


# ---------------------------------------------------------------------------- the tree


class CountTree:
    """An R-tree of count vectors, bulk-loaded by sort-tile-recursive packing. A node holds the
    largest coordinates and the smallest set below it: what the overlap bound needs."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.vectors, self.sizes = vectors, sizes
        order = self._tiled(np.arange(len(sizes)))
        self.leaves = [order[i : i + FANOUT] for i in range(0, len(order), FANOUT)]
        self.levels = [self._bounds(self.leaves, vectors, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            high, least = self.levels[-1]
            groups = [np.arange(i, min(i + FANOUT, len(high))) for i in range(0, len(high), FANOUT)]
            self.levels.append(self._bounds(groups, high, least))

    def _tiled(self, rows: np.ndarray) -> np.ndarray:
        """By set size, then in tiles by the coordinate that varies most."""
        rows = rows[np.argsort(self.sizes[rows], kind="stable")]
        tile = FANOUT * FANOUT
        out = []
        for i in range(0, len(rows), tile):
            t = rows[i : i + tile]
            out.append(t[np.argsort(self.vectors[t][:, self.vectors[t].var(0).argmax()], kind="stable")])
        return np.concatenate(out) if out else rows

    @staticmethod
    def _bounds(groups, high, least):
        return np.stack([high[g].max(0) for g in groups]), np.array([least[g].min() for g in groups])

    def search(self, vector: np.ndarray, size: int) -> np.ndarray:
        """Rows whose overlap with the query can reach the threshold."""
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            high, least = self.levels[level]
            nodes = nodes[reaches(np.minimum(high[nodes], vector).sum(1, dtype=np.int64), size + least[nodes])]
            if level and len(nodes):
                nodes = np.concatenate([np.arange(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1][0]))) for i in nodes])
        if not len(nodes):
            return nodes
        rows = np.concatenate([self.leaves[i] for i in nodes])
        return rows[reaches(np.minimum(self.vectors[rows], vector).sum(1, dtype=np.int64), size + self.sizes[rows])]


def _points(t: pa.Table):
    return np.asarray(t.column("node")), np.asarray(t.column("n")), vectors_of(t.column("data").to_pylist())


def _distance(vectors: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """L1 distances from the mean of n vectors of that sum."""
    return np.abs(vectors - total / n).sum(1)


class Forest:
    """Disjoint groups of rows 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j

    def groups(self) -> list[list[int]]:
        """Those of more than one row."""
        found: dict[int, list[int]] = {}
        for i in range(len(self.parent)):
            found.setdefault(self.root(i), []).append(i)
        return [g for g in found.values() if len(g) > 1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows of equal first column (a long), also those that go on in another batch."""
    held, parts = None, []
    for batch in batches:
        key = np.asarray(batch.column(0))
        cuts = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if a == b:
                continue
            if parts and key[a] != held:
                yield pa.Table.from_batches(parts)
                parts = []
            held = key[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


GROUPED = "members array<long>, labels array<long>"


def _grouped(found: list[tuple[list[int], list[int]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i in range(2)], names=["members", "labels"])


def _near_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate groups of small blocks, rows (h, node, n, data) sorted by h: the members, and as
    labels the star of the member of most candidates, itself first."""
    found = []
    for block in _runs(batches):
        nodes, sizes, vectors = _points(block)
        tree, forest = CountTree(vectors, sizes), Forest(len(nodes))
        near = [tree.search(vectors[i], sizes[i]).tolist() for i in range(len(nodes))]
        for i, js in enumerate(near):
            for j in js:
                forest.join(i, j)
        for g in forest.groups():
            most = min(g, key=lambda i: (-len(near[i]), nodes[i]))
            found.append((sorted(nodes[g].tolist()), [int(nodes[most]), *(int(nodes[j]) for j in near[most] if j != most)]))
        if len(found) >= SLICE:
            yield _grouped(found)
            found = []
    yield _grouped(found)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of each candidate group, rows (g, node, label, set) sorted by
    g; members of one label are linked already."""
    a, b = [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for group in _runs(batches):
        nodes, labels = np.asarray(group.column("node")), np.asarray(group.column("label"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        sizes, vectors = np.array([len(s) for s in sets]), vectors_of([count_vector(s) for s in sets])
        tree, forest, first = CountTree(vectors, sizes), Forest(len(nodes)), {}
        for i, label in enumerate(labels.tolist()):
            forest.join(first.setdefault(label, i), i)
        for i in range(len(nodes)):
            for j in tree.search(vectors[i], sizes[i]).tolist():
                if i < j and forest.root(i) != forest.root(j) and linked(sets[i], sets[j]):
                    forest.join(i, j)
                    a.append(int(nodes[i]))
                    b.append(int(nodes[j]))
        if len(a) >= SLICE:
            yield out()
            a, b = [], []
    yield out()


CENTRE = "h long, part long, node long, n long, data binary, total binary, rows long"


def _centre(t: pa.Table) -> pa.Table:
    """The most central of a cell's rows (or of its parts' central rows), and the cell's sum."""
    nodes, sizes, vectors = _points(t)
    if "total" in t.column_names:
        total = sum(np.frombuffer(x, "<i8") for x in t.column("total").to_pylist())
        rows = sum(t.column("rows").to_pylist())
    else:
        total, rows = vectors.sum(0, dtype=np.int64), len(nodes)
    i = int(np.lexsort((nodes, _distance(vectors, total, rows)))[0])
    out = {"h": t.column("h")[0].as_py(), "part": t.column("part")[0].as_py(), "node": int(nodes[i]), "n": int(sizes[i]), "data": t.column("data")[i].as_py(), "total": total.astype("<i8").tobytes(), "rows": rows}
    kinds = {"data": pa.binary(), "total": pa.binary()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in out.items()})


def _near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (node, n, data, pivot, pivot_n, pivot_data) whose bound reaches the threshold."""
    for batch in batches:
        node, n, data, pivot, pivot_n, pivot_data = batch.columns
        if not len(batch):
            continue
        overlap = np.minimum(vectors_of(data.to_pylist()), vectors_of(pivot_data.to_pylist())).sum(1).astype(np.int64)
        x, y = np.asarray(node), np.asarray(pivot)
        keep = reaches(overlap, np.asarray(n) + np.asarray(pivot_n)) & (x != y)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], names=["a", "b"])


def _met(rows: DataFrame, figures: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (h, node, ...) of large blocks with their block's figures, one row an h: joined by
    (h, salt), so that no block's rows meet in one task."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int"))
    spread = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return salted.join(spread, ["h", "salt"], how).drop("salt")


def _pivot_pairs(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Each row (h, node, parts) of large blocks with its block's most central row: centres of
    cells first, then centres of FANIN centres at a time."""
    placed = rows.withColumn("part", F.pmod(F.xxhash64("node", "h"), F.col("parts"))).join(points, "node").select("h", "part", "node", "n", "data")
    centres = staged(placed.groupBy("h", "part").applyInArrow(_centre, CENTRE), "centres")
    most = rows.agg(F.coalesce(F.max("parts"), F.lit(1))).first()[0]
    while most > 1:
        most, finer = -(-most // FANIN), centres
        centres = staged(finer.withColumn("part", F.floor(F.col("part") / FANIN).cast("long")).groupBy("h", "part").applyInArrow(_centre, CENTRE), "centres")
        unstaged(finer)
    pivots = centres.select("h", F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("data").alias("pivot_data"))
    return _met(placed, pivots).select("node", "n", "data", "pivot", "pivot_n", "pivot_data").mapInArrow(_near_pivot, "a long, b long").distinct()


def _across(best: bool):
    """Of a cell's pairs in different components; side 0 meets side 1, or, where the cell has one
    side only, its rows meet each other: the best candidate of each row of side 0 (as a group of
    two), or else the candidate groups of all."""

    def run(t: pa.Table) -> pa.Table:
        nodes, sizes, vectors = _points(t)
        label, side = np.asarray(t.column("label")), np.asarray(t.column("side"))
        ask = np.flatnonzero(side == 0)
        held = ask if bool(t.column("alone")[0].as_py()) else np.flatnonzero(side == 1)
        forest, pairs = Forest(len(nodes)), []
        if len(ask) and len(held):
            tree = CountTree(vectors[held], sizes[held])
            for i in ask.tolist():
                near = held[tree.search(vectors[i], sizes[i])]
                near = near[label[near] != label[i]]
                if best and len(near):
                    overlap = np.minimum(vectors[near], vectors[i]).sum(1, dtype=np.int64) / (sizes[near] + sizes[i])
                    pairs.append([i, int(near[np.lexsort((nodes[near], -overlap))[0]])])
                elif not best:
                    for j in near.tolist():
                        forest.join(i, j)
        return pa.Table.from_batches([_grouped([(nodes[g].tolist(), label[g].tolist()) for g in (pairs if best else forest.groups())])])

    return run


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return bool(reaches(int((t[at] == s).sum()), len(s) + len(t)))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among some pairs, of which each row of a block has one at most."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    with_a = ordered.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_verified, "a long, b long")


def _members(groups: DataFrame) -> DataFrame:
    """(g, node, label), a row a member of each different group."""
    zipped = groups.distinct().select(F.xxhash64("members", "labels").alias("g"), F.explode(F.arrays_zip("members", "labels")).alias("m"))
    return zipped.select("g", F.col("m.members").alias("node"), F.col("m.labels").alias("label"))


def _links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Spanning forests of the links in candidate groups. Near copies meet in many blocks, but in
    few different groups."""
    rows = _members(groups).join(sets, "node").select("g", "node", "label", "set")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_forests, "a long, b long").distinct()


def _still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate groups of pairs of different labels: rows (g, node, n, data, label, fine) sorted by
    g. Of two sets with fine vectors, these decide too."""
    found = []
    for group in _runs(batches):
        nodes, sizes, vectors = _points(group)
        label = np.asarray(group.column("label"))
        fine = [None if x is None else vectors_of([x], FINE_GROUPS)[0] for x in group.column("fine").to_pylist()]
        tree, forest = CountTree(vectors, sizes), Forest(len(nodes))
        for i in range(len(nodes)):
            for j in tree.search(vectors[i], sizes[i]).tolist():
                if i < j and label[i] != label[j] and forest.root(i) != forest.root(j):
                    if fine[i] is None or fine[j] is None or reaches(int(np.minimum(fine[i], fine[j]).sum(dtype=np.int64)), sizes[i] + sizes[j]):
                        forest.join(i, j)
        found += [(nodes[g].tolist(), label[g].tolist()) for g in forest.groups()]
        if len(found) >= SLICE:
            yield _grouped(found)
            found = []
    yield _grouped(found)


def _open(groups: DataFrame, labels: DataFrame, points: DataFrame) -> DataFrame:
    """What small blocks' candidate groups still leave open. A star's middle was compared with all
    its candidates, so it takes no further part."""
    others = groups.select(F.array_except("members", F.slice("labels", 1, 1)).alias("members")).where(F.size("members") > 1).distinct()
    rows = others.select(F.xxhash64("members").alias("g"), F.explode("members").alias("node")).join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_ = rows.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("g")
    held = rows.join(mixed_, "g").join(points, "node").select("g", "node", "n", "data", "label", F.lit(None).cast("binary").alias("fine"))
    return held.repartition("g").sortWithinPartitions("g", "node").mapInArrow(_still_open, GROUPED)


def _fine_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fine = [count_vector(np.frombuffer(x.as_buffer(), np.uint64), FINE_GROUPS) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary())], names=["node", "fine"])


def _narrowed(groups: DataFrame, points: DataFrame, sets: DataFrame) -> DataFrame:
    """What candidate groups leave open once their long sets were compared by fine vectors."""
    fine = sets.where(F.length("set") > 8 * LONG).select("node", "set").mapInArrow(_fine_vectors, "node long, fine binary")
    rows = _members(groups).join(points, "node").join(fine, "node", "left").select("g", "node", "n", "data", "label", "fine")
    return rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(_still_open, GROUPED)


def _cells(large: DataFrame, labels: DataFrame, points: DataFrame, best: bool) -> DataFrame:
    """Candidates (see ``_across``) in large blocks that aren't in one component yet. A block's largest
    component (side 1) and its other rows (side 0) are cut into parts of about CELL rows and
    CELL_SHINGLES shingles; parts of side 0 meet all parts of side 1 and each other."""
    labelled = large.join(labels, "node", "left").join(points, "node").withColumn("label", F.coalesce("label", "node"))
    rows = staged(labelled.select("h", "node", "n", "data", "label"), "large-labelled")
    per = rows.groupBy("h", "label").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"))
    most = per.groupBy("h").agg(F.max(F.struct("count", "label", "shingles")).alias("top"), F.sum("count").alias("m"), F.sum("shingles").alias("s"))
    cut = lambda m, s: F.greatest(F.lit(1), F.ceil(m / CELL), F.ceil(s / CELL_SHINGLES)).cast("int")
    figures = most.where(F.col("m") > F.col("top.count")).select("h", F.col("top.label").alias("top"), cut(F.col("m") - F.col("top.count"), F.col("s") - F.col("top.shingles")).alias("p0"), cut(F.col("top.count"), F.col("top.shingles")).alias("p1"))
    r = _met(rows, figures).withColumn("side", (F.col("label") == F.col("top")).cast("int"))
    r = r.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 1, F.col("p1")).otherwise(F.col("p0"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    keep = ["h", "x", "y", "alone", "side", "node", "n", "data", "label"]
    zero, one = r.where("side = 0"), r.where("side = 1")
    to_top = zero.withColumn("x", F.col("part")).withColumn("y", F.explode(upto("p1"))).withColumn("alone", F.lit(False)).select(keep)
    top = one.withColumn("y", F.col("part")).withColumn("x", F.explode(upto("p0"))).withColumn("alone", F.lit(False)).select(keep)
    # parts of side 0 with each other: part i meets j as (i, j), i < j with i on side 0 and j on side 1
    other = zero.withColumn("z", F.explode(upto("p0"))).withColumn("x", F.least("part", "z")).withColumn("y", -1 - F.greatest("part", "z"))
    other = other.withColumn("alone", F.col("x") == -1 - F.col("y")).withColumn("side", F.when(~F.col("alone") & (F.col("part") > F.col("z")), 1).otherwise(0)).select(keep)
    cells = to_top.unionByName(top).unionByName(other)
    found = staged(cells.groupBy("h", "x", "y").applyInArrow(_across(best), GROUPED), "cell-groups")
    unstaged(rows)
    return found


# ---------------------------------------------------------------------------- the join


def _blocks(texts: DataFrame, sketch: np.ndarray, bits: int, shared: frozenset[int]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Small blocks (members), rows (h, node) of large ones, and the tables these are read from."""
    prefixes = texts.select("text").mapInArrow(_prefixes(sketch, bits, shared), "h long, node long, heavy boolean")
    place = F.when(F.col("heavy"), F.pmod(F.col("node"), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = prefixes.select("h", "node", "heavy", place.alias("place")).repartition("h", "place").sortWithinPartitions("h", "node")
    parted = staged(dealt.select("h", "node", "heavy").mapInArrow(_shared, "members array<long>, h long, node long, heavy boolean"), "blocks")
    small = parted.where("members is not null").select("members")
    large = parted.where("members is null and not heavy").select("h", "node").distinct()
    if not (sketch > HEAVY).any():
        return small.distinct(), large, [parted]
    # shingles dealt over several tasks: their members are counted over all of them
    spread = staged(parted.where("heavy").select("h", "node").distinct(), "heavy-rows")
    counted = _met(spread, spread.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"))
    few = counted.where(F.col("m") <= SMALL_BLOCK).groupBy("h").agg(F.sort_array(F.collect_set("node")).alias("members"))
    return small.unionByName(few.select("members")).distinct(), large.unionByName(counted.where(F.col("m") > SMALL_BLOCK).select("h", "node")), [parted, spread]


def _tagged(described):
    """Adds the third column of the rows that came in, their text_hash; frequencies have none. A batch
    comes out for each slice that went in, of the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []

        def watched():
            for batch in slices(batches):
                waiting.append(batch.column(2))
                yield batch

        for out in described(watched()):
            tag = waiting.pop(0) if waiting else pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([*out.columns, tag], names=[*out.schema.names, "text_hash"])

    return run


def _found(docs: DataFrame, id_col: str, text_col: str, bits: int, tagged: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The rows (doc_id, n, node and, if ``tagged``, text_hash, the xxhash64 of the text), the classes
    (node, first_id, label: the smallest node of the component), and the tables both are read from."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *([F.xxhash64(text).alias("text_hash")] if tagged else []))
    described, kinds = (_tagged(_described(bits)), f"{SEEN}, text_hash long") if tagged else (_described(bits), SEEN)
    seen = staged(texts.mapInArrow(described, kinds), "shingle-sets")
    rows = seen.where("kind = 0")
    every = staged(rows.where("n > 0").groupBy("node", "node2").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("data").alias("data")), "classes")
    twice = [r[0] for r in every.groupBy("node").count().where("count > 1").select("node").limit(MOST_SHARED + 1).collect()]
    if len(twice) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} names of sets are shared")
    name = F.when(F.col("node").isin(twice), F.col("node2")).otherwise(F.col("node")) if twice else F.col("node")
    rows, classes = rows.withColumn("node", name), every.withColumn("node", name)
    if twice and classes.groupBy("node").count().where("count > 1").limit(1).count():
        raise ValueError("two sets share both halves of their digests' names")
    shared, sketch, points = frozenset(twice), frequencies(seen), classes.select("node", "n", "data")

    small, large_rows, parts = _blocks(texts, sketch, bits, shared)
    listed = small.select(F.xxhash64("members").alias("h"), F.explode("members").alias("node")).join(points, "node").select("h", "node", "n", "data")
    groups = staged(listed.repartition("h").sortWithinPartitions("h").mapInArrow(_near_groups, GROUPED).distinct(), "near-groups")
    large = staged(large_rows, "large-blocks")
    unstaged(*parts)

    needed = groups.select(F.explode("members").alias("node")).unionByName(large.select("node"))
    cells = needed.select(F.pmod(F.col("node"), F.lit(1 << SKETCH_BITS)).cast("int").alias("cell")).distinct().toArrow()
    wanted = np.zeros(1 << SKETCH_BITS, bool)  # of fixed size; a class let in for nothing meets no pair
    wanted[np.asarray(cells.column(0))] = True
    sets = staged(texts.select("text").mapInArrow(_sets_of(wanted, bits, shared), "node long, set binary").dropDuplicates(["node"]), "sets")

    size = large.groupBy("h").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    chosen = _met(large, size.where(F.pmod(F.xxhash64("h"), F.lit(PIVOT_SHARE)) == 0))
    star = groups.select(F.element_at("labels", 1).alias("a"), F.explode(F.slice("labels", 2, SMALL_BLOCK)).alias("b"))
    links = staged(_verify(star.unionByName(_pivot_pairs(chosen, points)), sets), "links")
    labels = components(links)
    some = large.limit(1).count() > 0

    def more(found: DataFrame) -> None:
        """Adds links; components are made anew if there are any."""
        nonlocal links, labels
        fresh = staged(found, "links")
        if fresh.limit(1).count():
            every = staged(links.unionByName(fresh), "links")
            unstaged(links, labels)
            links, labels = every, components(every)
        unstaged(fresh)

    if some:
        near = _cells(large, labels, points, best=True)
        more(_verify(near.select(F.element_at("members", 1).alias("a"), F.element_at("members", 2).alias("b")), sets))
        unstaged(near)
    rest = staged(_open(groups, labels, points), "open-groups")
    last = [rest, *([_cells(large, labels, points, best=False)] if some else [])]
    more(_links(_narrowed(last[0].unionByName(last[-1]) if some else rest, points, sets), sets))
    unstaged(*last)
    unstaged(groups, large, sets, links)

    full = classes.join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    return rows, full, [seen, every, labels]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. ``name_bits``: see the head of the module."""
    rows, full, _ = _found(docs, id_col, text_col, name_bits)
    whole = full.groupBy("label").agg(F.min("first_id").alias("component_id"))
    member = full.join(whole, "label").select("node", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n", "node").join(member, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, all its columns: that of smallest doc_id (null ids last), of one id
    that whose text has the smallest hash, of one id and text the first by the other columns (all that can be put
    in order; rows alike in these are interchangeable). Rows without words are linked with nothing and all stay."""
    rows, full, parts = _found(docs, "doc_id", "text", 64, tagged=True)
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text_hash"]
    member = rows.where("n > 0").select(*key, "node").join(full.select("node", "label"), "node")
    kept = staged(member.groupBy("label").agg(F.min(F.struct("no_id", "id", "text_hash")).alias("first")).select("first.*"), "kept-rows")
    unstaged(*parts)
    number, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mine = docs.select(F.struct(*columns).alias("row"), number.isNull().alias("no_id"), F.coalesce(number, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("text_hash"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("words"))
    order = F.struct(*[F.col(f"row.`{f.name}`") for f in docs.schema if _orderable(f.dataType)])
    chosen = mine.where("words").join(kept, ["no_id", "id", "text_hash"]).groupBy("no_id", "id", "text_hash").agg(F.min_by("row", order).alias("row"))
    return chosen.select("row.*").unionByName(mine.where("not words").select("row.*"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every shingle as its words, every pair that shares one, all that links reach. Holds where no two rows share an id.
OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM (SELECT a.doc_id, b.doc_id AS other, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2) p
  JOIN n x ON x.doc_id = p.doc_id JOIN n y ON y.doc_id = p.other
  WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
