"""Cost-balanced packing of tokenised documents into sequences of at most 2048 tokens.

A document's tokens (ids plus one end id) are cut into full sequences and one rest. A full piece
is a sequence of its own, without padding. Rests are dealt by a hash of the document id into
groups of about ``GROUP_DOCS`` documents; each group opens as few sequences as hold its tokens.
Rests are taken in descending order of estimated cost (linear plus quadratic attention cost); each
goes to the sequence of lowest cost so far that still has room, and one that fits nowhere whole is
cut across the sequences with most room. So a group pads less than one sequence in all, whatever
the lengths. The last sequence of a group holds what is left over; a sequence whose length is a
power of two needs no padding.

Token ids are found per word and kept in a bounded table per Python worker: the tokenizer's
pre-tokens never cross white space, so a text's ids are its words' ids in a row. Rests travel as
16-bit ids in one exchange by group; of full pieces only position and checksum move.

Defined results: a null text is an empty one, its single token the end id; repeated rows are
separate documents (occurrences of one id in a task go to groups of their own, so a repeated id
fills no group); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table, utf8_column

LENGTH = 2048
END_ID = 1
#: Documents whose rests are packed together: bounds a group's memory at any input size.
GROUP_DOCS = 4096
#: Words kept while a task runs and from one task to the next, and the length beyond which none is kept.
KEPT_WORDS, IDLE_WORDS, KEPT_CHARS = 1_000_000, 200_000, 40
#: Ids whose repeats a task counts at once.
COUNTED = 500_000
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH

#: Texts whose new words are learned at once.
TOGETHER = 512
#: Punctuation that, after letters, is a pre-token of its own.
TAIL = ".,!?;:"

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CACHES: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known(dict):
    """Ids by word; notes the words it lacks."""

    def __init__(self):
        super().__init__()
        self.lacking: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes:
        self.lacking.append(word)
        return b""

    def trim(self) -> None:
        """Keeps the words that came first: frequent ones are met early."""
        if len(self) > IDLE_WORDS:
            first = list(itertools.islice(self.items(), IDLE_WORDS))
            self.clear()
            self.update(first)


class WordIds:
    """Ids of whole texts by way of their words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        #: Which ids end a pre-token.
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known = _Known()

    def _alone(self, words: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u2").tobytes() for e in done]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only are one pre-token each, so many can be encoded as one text."""
        out: list[bytes] = []
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u2")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # a letter that the normaliser takes apart
                out += self._alone(some)
                continue
            raw, at = ids.tobytes(), 0
            for stop in (2 * stops).tolist():
                out.append(raw[at:stop])
                at = stop
        return out

    def _learn(self, lacking: set[bytes]) -> None:
        words = {w: w.decode("utf-8", "replace") for w in lacking}
        plain: dict[bytes, tuple[str, str]] = {}
        for w, s in words.items():
            core = s.rstrip(TAIL)
            if core.isalpha():
                plain[w] = (core, s[len(core) :])
        cores = list({c for c, _ in plain.values()})
        tails = list({t for _, t in plain.values() if t})
        ids = dict(zip(cores, self._letters(cores), strict=True)) | {"": b""}
        tail_ids = dict(zip(tails, self._alone(tails), strict=True)) | {"": b""}
        self.known.update({w: ids[c] + tail_ids[t] for w, (c, t) in plain.items()})
        rest = [w for w in words if w not in plain]
        self.known.update(zip(rest, self._alone([words[w] for w in rest]), strict=True))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        return [ids for i in range(0, len(texts), TOGETHER) for ids in self._some(texts[i : i + TOGETHER])]

    def _some(self, texts: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.trim()
        look, join = known.__getitem__, b"".join
        out, again = [], []
        for i, t in enumerate(texts):
            # Lower case early, so that more words are alike; not where a special token could arise.
            words = (t if b"<|" in t else t.lower()).split()
            before = len(known.lacking)
            out.append(join(map(look, words)))
            if len(known.lacking) > before:
                again.append((i, words))
        lacking = set(known.lacking)
        known.lacking.clear()
        if lacking:
            self._learn(lacking)
            for i, words in again:
                out[i] = join(map(look, words))
            for w in lacking:
                if len(w) > KEPT_CHARS:
                    del known[w]
        return out


def word_ids(path: str) -> WordIds:
    if path not in _CACHES:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


def crc_of(ids16: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids16, dtype="<u2").astype("<u4").tobytes())


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, pieces' length, sequence, offset) of one group's items, each of
    under ``length`` tokens, given in any order."""
    total = sum(lengths)
    if not total:
        return []
    n = -(-total // length)
    room, used = [length] * n, [0] * n
    open_, out = [(0.0, s) for s in range(n)], []
    parked: list[tuple[int, float, int]] = []  # with too little room for the last item, roomiest first

    def put(item: int, start: int, size: int, s: int, spent: float) -> None:
        out.append((item, start, size, s, used[s]))
        used[s] += size
        room[s] -= size
        if room[s]:
            heapq.heappush(open_, (spent + cost(size), s))

    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[item]
        while parked and -parked[0][0] >= size:
            _, spent, s = heapq.heappop(parked)
            heapq.heappush(open_, (spent, s))
        while open_ and room[open_[0][1]] < size:
            spent, s = heapq.heappop(open_)
            heapq.heappush(parked, (-room[s], spent, s))
        if open_:
            spent, s = heapq.heappop(open_)
            put(item, 0, size, s, spent)
            continue
        start = 0
        while size:  # fits nowhere whole: cut it over the roomiest sequences
            _, spent, s = heapq.heappop(parked)
            part = min(size, room[s])
            put(item, start, part, s, spent)
            start, size = start + part, size - part
    return out


def _cut(path: str, groups: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("group", pa.int32()), ("place", pa.int64()), ("rest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = word_ids(path), {}
        end = np.array([END_ID], dtype="<u2").tobytes()
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for doc, tokens in zip(ids, encode(list(utf8_column(batch.column(1)))), strict=True):
                tokens += end
                n = len(tokens) // 2
                if len(seen) > COUNTED:  # repeats count anew: they only spread rows of one id over groups
                    seen.clear()
                nth = seen[doc] = seen.get(doc, -1) + 1
                whole = n - n % LENGTH
                group = zlib.crc32(f"{doc}:{nth}".encode()) % groups
                for s in range(0, whole, LENGTH):
                    rows.append((doc, s, LENGTH, crc_of(tokens[2 * s : 2 * (s + LENGTH)]), n, group, nth, None))
                if n > whole:
                    rows.append((doc, whole, n - whole, None, n, group, nth, tokens[2 * whole :]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        encode.known.trim()  # the worker stays, and other stages need its memory

    return run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group int, place long, rest binary"


def _pack_group(t: pa.Table) -> pa.Table:
    base = t.column("group")[0].as_py() << 32
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("doc_id", "place", "start", "doc_tokens", "length", "ids_crc32", "rest")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    rests, out = [r for r in rows if r[6] is not None], []
    for item, start, size, s, offset in pack([r[4] for r in rests]):
        doc, _, first, tokens, _, _, ids = rests[item]
        out.append((doc, first + start, size, crc_of(ids[2 * start : 2 * (start + size)]), tokens, base + s, offset))
    used = -(-sum(r[4] for r in rests) // LENGTH)
    for s, (doc, _, start, tokens, size, crc, _) in enumerate((r for r in rows if r[6] is None), used):
        out.append((doc, start, size, crc, tokens, base + s, 0))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.table({n: pa.array([r[i] for r in out], type=pa.int64()) for i, n in enumerate(names)})


def pack_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: PIECE. A sequence id is its group times 2**32 plus a number."""
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    run, schema = _cut(vocabulary or default_vocabulary(), groups)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema).groupBy("group").applyInArrow(_pack_group, PIECE)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
