"""Substring dedup: of every run of ``window`` words that occurs more than once, words of all
occurrences but the first are removed.

A window is ``WINDOW`` consecutive words of one document; its anchor is the smallest of the hashes
of the ``GRAM``-word grams in it, so equal windows have equal anchors wherever they stand.

1. Anchors are counted over all documents (summed up a task before the shuffle). Only windows whose
   anchor occurs twice can recur. These anchors are put in a bitmap of 16 bits each, 2**MOST_BITS
   at most: beyond that it lets more windows through, which costs work and never changes a result.
2. Consecutive candidate windows with one anchor form a stretch, some 27 words long. Stretches are
   grouped by anchor and digest, first on the map side: of a text that a third of all documents
   hold, one row a task is sent. A stretch keeps its first occurrence and whether there are more.
3. Distinct stretches are dealt by their anchor, so that all occurrences of a window meet. A task
   takes whole anchors until it holds ``TASK_WINDOWS`` windows, confirms which windows recur, word by
   word, joins those that always follow one another to passages, compiles the passages to an
   Aho-Corasick automaton and streams all its stretches through it. Each hit is an occurrence; the
   passage's first one is known from the stretches' first occurrences. Anchors with more than
   ``BUSY`` windows are dealt anew by whole windows, each again a stretch of its own, so no task
   holds an unbounded group.
4. The documents are streamed once more; each stretch takes the hits of its digest, and the spans
   meet their document's text by id and digest of the text.

Hashes only choose what is compared: windows are compared by their words, in the automata.
Stretches and rows of one id are told apart by MD5.

Defined results: documents are in order of id, null ids last, those of one id by the digest of
their text; identical rows are interchangeable, the first keeps what no earlier document has and the others
lose all words if they have a window. Null and empty texts have no words. Texts below ``WINDOW``
words keep all. An empty table gives no rows. Other columns are not read. A text of any length is
cut into pieces of some 4 MB that overlap by a window.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import staged, table, unstaged, utf8_column

WINDOW, GRAM = 20, 5
SPAN = WINDOW - GRAM + 1  # grams of a window: a power of two, as its minimum is found by doubling
#: Windows of a stretch at most: longer runs, which only repeating texts have, are cut.
MOST_WINDOWS = 64
#: Windows of one automaton, and of an anchor that is dealt anew.
TASK_WINDOWS, BUSY = 20_000, 32_768
#: Bits of the bitmap at least and at most (64 MB), and for each anchor.
LEAST_BITS, MOST_BITS, BITS_EACH = 15, 29, 16
#: Bytes of text hashed together, and of a piece of a long text.
CHUNK_BYTES, PIECE_BYTES = 1 << 18, 1 << 22

_U = np.uint64
SPACES = b" \t\n\x0b\x0c\r"
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
KEY = ["no_id", "id", "tag"]


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
PLACES = mixed(np.arange(901, 901 + GRAM, dtype=np.uint64)) | _U(1)
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse mod 2**64, k below n."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


POWER_BYTES = 2 * CHUNK_BYTES
POWER, INVERSE = _powers(POWER_BYTES)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, from prefix sums over CHUNK_BYTES of words at a time; a word longer than
    that is digested by itself."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + POWER_BYTES, "right"))
        if to == at:
            out[at] = int.from_bytes(hashlib.blake2b(data[base : ends[at]].tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        some = data[base : ends[to - 1]]
        sums = np.concatenate([[_U(0)], np.cumsum(BYTES[some] * POWER[: len(some)], dtype=np.uint64)])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mixed((sums[b] - sums[a]) * INVERSE[a] + (b - a).astype(np.uint64))
        at = to
    return out


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(words before it, piece) of a text: all windows that start in a piece's own part are in it."""
    at = before = 0
    while len(text) - at > PIECE_BYTES:
        cut = at + PIECE_BYTES
        while cut < len(text) and text[cut] not in SPACES:
            cut += 1
        end, words = cut, 0
        while end < len(text) and words < WINDOW - 1:  # the words that windows reach into
            while end < len(text) and text[end] in SPACES:
                end += 1
            words += end < len(text)
            while end < len(text) and text[end] not in SPACES:
                end += 1
        yield before, text[at:end]
        before += len(text[at:cut].split())
        at = cut
    yield before, text[at:]


def grouped(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray]]:
    """Pieces of the texts, some CHUNK_BYTES together: ((row, words before), joined bytes, first
    byte of each piece)."""
    some, parts, size = [], [], 0

    def out():
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return some, b" ".join(parts) + b" ", np.concatenate([[0], np.cumsum(sizes + 1)])

    for row, text in enumerate(texts):
        for before, piece in pieces(text):
            some.append((row, before))
            parts.append(piece)
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield out()
                some, parts, size = [], [], 0
    if some:
        yield out()


def sliding(x: np.ndarray, how) -> np.ndarray:
    """how (minimum or maximum) of SPAN neighbours, by doubling."""
    step = 1
    while step < SPAN:
        x = how(x[:-step], x[step:])
        step *= 2
    return x


class Windows:
    """The words and windows of some pieces. anchor and valid have an element a window."""

    def __init__(self, raw: bytes, first_byte: np.ndarray):
        data = np.frombuffer(raw, np.uint8)
        edges = np.flatnonzero(np.diff(SPACE[data], prepend=True))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.bounds = np.searchsorted(self.starts, first_byte)
        n = max(0, len(self.starts) - WINDOW + 1)
        self.valid = np.zeros(n, bool)
        if n:
            words = word_hashes(data, self.starts, self.ends)
            grams = np.zeros(len(words) - GRAM + 1, np.uint64)
            for k in range(GRAM):
                grams += words[k : k + len(grams)] * PLACES[k]
            self.grams = mixed(grams) | _U(1)  # never 0
            self.anchor = sliding(self.grams, np.minimum)
            self.piece = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
            self.valid = self.piece[:n] == self.piece[WINDOW - 1 :]

    def anchors(self) -> np.ndarray:
        """The grams that are the anchor of some window, once for each place."""
        if not self.valid.any():
            return np.zeros(0, np.uint64)
        edge = np.zeros(SPAN - 1, np.uint64)
        chosen = np.where(self.valid, self.anchor, _U(0))
        return self.grams[sliding(np.concatenate([edge, chosen, edge]), np.maximum) == self.grams]

    def stretches(self, wanted: np.ndarray) -> list[np.ndarray]:
        """(piece, first word in it, first window, windows) of runs of wanted windows with one anchor."""
        at = np.flatnonzero(self.valid)
        at = at[wanted_of(self.anchor[at], wanted)]
        if not len(at):
            return [at] * 4
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (self.anchor[at[1:]] != self.anchor[at[:-1]]) | (self.piece[at[1:]] != self.piece[at[:-1]])
        head = np.flatnonzero(new)
        nth = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        head = np.flatnonzero(nth % MOST_WINDOWS == 0)
        piece = self.piece[at[head]]
        return [piece, at[head] - self.bounds[piece], at[head], np.diff(np.append(head, len(at)))]


def wanted_of(anchor: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    cell = (anchor >> _U(1)) & _U(8 * len(bitmap) - 1)
    return (bitmap[(cell >> _U(3)).astype(np.int64)] >> (cell & _U(7)).astype(np.uint8)) & 1 > 0


# ---------------------------------------------------------------------------- passes over the texts


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Windows(raw, first).anchors() for _, raw, first in grouped(list(utf8_column(batch.column(0))))]
        if found:
            value, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.minimum(n, 2), pa.int64())], names=["anchor", "n"])


KEYED = "no_id boolean, id long, tag binary"
STRETCH = f"anchor long, digest binary, {KEYED}, start long, n long"


def _stretches(bitmap: np.ndarray, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, raw, first in grouped(list(utf8_column(batch.column(3)))):
                w = Windows(raw, first)
                if not w.valid.any():
                    continue
                piece, word, window, n = w.stretches(bitmap)
                if not len(piece):
                    continue
                begin, end = w.starts[window].tolist(), w.ends[window + n + WINDOW - 2].tolist()
                slices = [raw[a:b] for a, b in zip(begin, end, strict=True)]
                row, before = np.array(places, np.int64)[piece].T
                own = batch.select([0, 1, 2]).take(pa.array(row))
                digests = pa.array([hashlib.md5(s).digest() for s in slices], pa.binary())
                columns = [pa.array(w.anchor[window].view(np.int64)), digests, *own.columns, pa.array(word + before), pa.array(n)]
                names = ["anchor", "digest", *KEY, "start", "n"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(slices, pa.binary())] if with_text else []), names=names + (["words"] if with_text else []))

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """no_id, id, tag, text: a row's key has no nulls and orders the documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(id_col).cast("long")
    return docs.select(number.isNull().alias("no_id"), F.coalesce(number, F.lit(0).cast("long")).alias("id"), F.unhex(F.md5(text)).alias("tag"), text.alias("text"))


def bitmap_of(anchors: DataFrame) -> np.ndarray:
    """Bit (anchor >> 1) mod 2**b of every anchor is set; b follows their number. Pages of 4 KB are
    put together on the executors; the driver joins them."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, BITS_EACH * anchors.count())))))
    cell = F.shiftrightunsigned("anchor", 1).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + 1
    cells = anchors.select(cell.alias("cell"))
    pages = cells.groupBy(F.bitmap_bucket_number("cell").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in pages.collect():  # 2**(MOST_BITS - 15) pages at most
        page = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["page"] - 1) * 4096 :][: len(page)] = page
    return out


# ---------------------------------------------------------------------------- automata

# Words are written in digits of this base, the first from an alphabet of its own, so that a match
# can only begin at a word and no node has many branches.
DIGITS, FIRST, NEXT = 200, 0x400, 0x100


def word_codes(n: int) -> list[str]:
    width = 1
    while DIGITS**width < n:
        width += 1
    return ["".join(chr((NEXT if k else FIRST) + w // DIGITS**k % DIGITS) for k in range(width)) for w in range(n)]


class Shard:
    """The stretches of some anchors: rows of (anchor, words, order of the first occurrence, its
    start, more than one occurrence)."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        vocabulary = {w: None for r in rows for w in r[1]}
        codes = word_codes(len(vocabulary))
        self.width = len(codes[0]) if codes else 1
        code = dict(zip(vocabulary, codes, strict=True))
        self.coded = ["".join([code[w] for w in r[1]]) for r in rows]

    def passages(self) -> list[tuple[str, int]]:
        """(coded words, windows) of the recurring windows, joined where they always follow one another."""
        size = self.width * WINDOW
        number: dict[str, int] = {}
        ids, heads = [], []
        for text in self.coded:
            heads.append(len(ids))
            ids += [number.setdefault(text[k : k + size], len(number)) for k in range(0, len(text) - size + 1, self.width)]
        if not ids:
            return []
        of = np.array(ids)
        lengths = np.diff(np.append(heads, len(of)))
        many = np.repeat([2 if r[4] else 1 for r in self.rows], lengths)
        recurs = np.bincount(of, weights=many, minlength=len(number)) > 1
        head = np.zeros(len(of), bool)
        head[[h for h, n in zip(heads, lengths, strict=True) if n]] = True
        tail = np.append(head[1:], True)
        forks_back = self._differs(of, np.where(head, -1, np.roll(of, 1)), len(number))
        forks_on = self._differs(of, np.where(tail, -1, np.roll(of, -1)), len(number))
        # a passage begins where the window before isn't always the same or doesn't always lead here
        new = head | forks_back[of] | forks_on[np.roll(of, 1)]
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(of))
        row = np.repeat(np.arange(len(heads)), lengths)
        out: dict[int, tuple[str, int]] = {}
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if recurs[of[a]] and of[a] not in out:
                k = (a - heads[row[a]]) * self.width
                out[int(of[a])] = (self.coded[row[a]][k : k + size + (b - a - 1) * self.width], b - a)
        return list(out.values())

    @staticmethod
    def _differs(of: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -2)
        np.minimum.at(low, of, other)
        np.maximum.at(high, of, other)
        return (low != high) | (low < 0)

    def located(self) -> Iterator[tuple[list[int], list[int]]]:
        """Of each stretch (own, rest): word ranges, flat, of the hits in it that its first
        occurrence repeats, and of all hits, which all other occurrences repeat."""
        found = self.passages()
        if not found:
            yield from (([], []) for _ in self.rows)
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (text, _) in enumerate(found):
            automaton.add_word(text, k)
        automaton.make_automaton()
        first: dict[int, tuple] = {}
        hits: list[list[tuple[int, int]]] = []
        for text, r in zip(self.coded, self.rows, strict=True):
            mine = []
            for last, k in automaton.iter(text):
                begin = (last + 1) // self.width - found[k][1] - WINDOW + 1
                place = (*r[2], r[3] + begin)
                if k not in first or place < first[k]:
                    first[k] = place
                mine.append((begin, k))
            hits.append(mine)
        for r, mine in zip(self.rows, hits, strict=True):
            every = [(b, b + found[k][1] + WINDOW - 1) for b, k in mine]
            own = [s for s, (b, k) in zip(every, mine, strict=True) if first[k] != (*r[2], r[3] + b)]
            yield merged(own), merged(every)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Ascending, disjoint, flat."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


VERDICT = f"anchor long, digest binary, {KEYED}, start long, own array<int>, rest array<int>"


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor: whole anchors together, some TASK_WINDOWS windows a time."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        verdicts = list(Shard([(r[0], r[7].split(), (r[2], r[3], r[4]), r[5], r[8]) for r in held]).located())
        kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        rows = [(*r[:6], own, rest) for r, (own, rest) in zip(held, verdicts, strict=True) if rest]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "digest", *KEY, "start", "own", "rest"])

    held, windows = [], 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if windows >= TASK_WINDOWS and r[0] != held[-1][0]:
                yield out(held)
                held, windows = [], 0
            held.append(r)
            windows += r[6]
    if held:
        yield out(held)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a busy anchor's stretches as a stretch of its own."""
    for batch in batches:
        rows = []
        for anchor, digest, no_id, number, tag, start, n, words, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = words.split()
            for k in range(n):
                text = b" ".join(held[k : k + WINDOW])
                own = hashlib.md5(text).digest()
                rows.append((int.from_bytes(own[:8], "little", signed=True), own, no_id, number, tag, start + k, text, many, anchor, digest, k))
        kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary(), pa.int32()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SINGLE_NAMES)


SINGLE_NAMES = ["anchor", "digest", *KEY, "start", "words", "many", "of_anchor", "of_digest", "nth"]
SINGLE = f"anchor long, digest binary, {KEYED}, start long, words binary, many boolean, of_anchor long, of_digest binary, nth int"


def _distinct(rows: DataFrame) -> DataFrame:
    """A row for each anchor and digest, with its first occurrence."""
    per = rows.groupBy("anchor", "digest").agg(F.min(F.struct(*KEY, "start")).alias("first"), F.first("n").alias("n"), F.first("words").alias("words"), ((F.count("*") > 1) | F.bool_or("many")).alias("many"))
    return per.select("anchor", "digest", "first.*", "n", "words", "many")


def _automata(stretches: DataFrame) -> DataFrame:
    """The verdict on each distinct stretch. Dealt by anchor, in as many parts as any shuffle."""
    return stretches.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_located, VERDICT)


def _busy_verdict(stretches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for anchors with many stretches, by whole windows; and the table it reads."""
    single = staged(stretches.mapInArrow(_single_windows, SINGLE), "busy-windows")
    hit = _automata(_distinct(single.withColumn("n", F.lit(1).cast("long")))).select("anchor", "digest", F.struct(*KEY, "start").alias("first"), "own")
    met = single.join(hit, ["anchor", "digest"])
    place = F.struct(*KEY, "start")
    flat = F.array(F.col("nth"), F.col("nth") + WINDOW)
    is_first = (place == F.col("first")) & (F.size("own") == 0)
    per = met.groupBy(F.col("of_anchor").alias("anchor"), F.col("of_digest").alias("digest")).agg(
        F.min(F.struct(*KEY, (F.col("start") - F.col("nth")).alias("start"))).alias("at"),
        F.flatten(F.collect_list(F.when(~is_first, flat))).alias("own"),
        F.flatten(F.collect_list(flat)).alias("rest"),
    )
    return per.select("anchor", "digest", "at.*", "own", "rest"), single


# ---------------------------------------------------------------------------- the operator

KEPT = "doc_id long, n_words long, n_removed long, kept string, copies long"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the spans of each text; of identical rows the others (copies) lose all that windows cover."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def out(rows):
        columns = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        columns[3] = columns[3].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", "copies"])

    for batch in batches:
        rows, size = [], 0
        for no_id, number, text, copies, cuts in zip(*(c.to_pylist() if k != 2 else utf8_column(c) for k, c in enumerate(batch.columns)), strict=True):
            words = text.split(None)
            keep = bytearray(b"\x01") * len(words)
            for cut in cuts or ():
                flat = cut["cut"]
                for a, b in zip(flat[0::2], flat[1::2], strict=True):
                    a, b = a + cut["start"], b + cut["start"]
                    keep[a:b] = bytes(b - a)
            left = sum(keep)
            doc = None if no_id else number
            kept = b" ".join(itertools.compress(words, keep) if left < len(words) else words)
            rows.append((doc, len(words), len(words) - left, kept, 1))
            if copies > 1:
                gone = len(words) if len(words) >= WINDOW else 0
                rows.append((doc, len(words), gone, b"" if gone else kept, copies - 1))
            size += len(kept)
            if size >= 1 << 23:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by single spaces) of every row."""
    rows = keyed(docs, id_col, text_col)
    counts = rows.select("text").mapInArrow(_anchor_counts, "anchor long, n long")
    anchors = staged(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    bitmap = bitmap_of(anchors)
    unstaged(anchors)

    met = rows.mapInArrow(_stretches(bitmap, True), f"{STRETCH}, words binary").withColumn("many", F.lit(False))
    distinct = staged(_distinct(met), "stretches")
    busy = staged(distinct.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > BUSY).select("anchor"), "busy-anchors")
    parts = [distinct, busy]
    if busy.limit(1).count():
        again, single = _busy_verdict(distinct.join(busy, "anchor", "left_semi"))
        found = _automata(distinct.join(busy, "anchor", "left_anti")).unionByName(again)
        parts.append(single)
    else:
        found = _automata(distinct)
    verdicts = staged(found, "verdicts")
    unstaged(*parts)

    place = F.struct(*KEY, "start")
    told = verdicts.select("anchor", "digest", place.alias("first"), "own", "rest")
    occurrences = rows.mapInArrow(_stretches(bitmap, False), STRETCH)
    cuts = occurrences.join(told, ["anchor", "digest"]).select(*KEY, "start", F.when(place == F.col("first"), F.col("own")).otherwise(F.col("rest")).alias("cut")).where(F.size("cut") > 0)
    spans = staged(cuts.groupBy(*KEY).agg(F.collect_list(F.struct("start", "cut")).alias("cuts")), "spans")  # a document's own
    unstaged(verdicts)

    whole = rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies")).join(spans, KEY, "left")
    done = whole.select("no_id", "id", "text", "copies", "cuts").mapInArrow(_kept, KEPT)
    return done.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "n_words", "n_removed", "kept")


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window as its words. Holds where no two rows share an id.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE nth > 1
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
