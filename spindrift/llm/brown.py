"""Language-model scoring by Brown class-based bigrams.

Exchange clustering gives every word a class; a text's probability is the product of class
transitions and word emissions, smoothed with the unigram:

    P(w | v) = z * U(w) * (MIX * T(c(w) | c(v)) / U(c(w)) + 1 - MIX)

where U is the add-one unigram over all training tokens, U(c) its sum over a class (with one
unseen word), T the smoothed class transition and z keeps the sum at one. So a text's score is its
unigram score plus a term of its class sequence alone.

Every word gets its class by the exchange criterion, in two steps.

1. The ``UNIT_WORDS`` most frequent words are exchanged one by one. All others stand together for
   the while, in *units* of the ``SUFFIXES`` most frequent endings and one for the rest. For each
   unit, executors count the classes after and before it over all training tokens; the driver, which
   holds units x classes numbers and never a text, sweeps the units, moving each to the class that
   raises the likelihood most. ``PASSES`` such rounds follow each other.
2. Each other word leaves its unit for the class that raises the likelihood most, by the classes
   after and before that very word over all training tokens. These counts are summed up by word on
   the executors, and the words are judged there, all against the transitions of step 1.

Then transitions and emissions are counted anew over the classes of all words. A word that training
hasn't seen has the class of its ending's unit. The number of classes follows the vocabulary (its
fourth root, 16 at least; 250 at most, for a class is one byte).

Counts cover every word of every training document: partial counts per task, then a sum by word.
Words of a count above a threshold, at most ``HOT_WORDS``, go to the tasks as a table; a document's
other words are joined to the full table, one row per document and distinct rare word.

Defined results: a null or empty text is the end token alone; a null doc_id is in the training
part; repeated rows are separate documents; without training tokens every count is 0 and both
scores are log10(1); an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import staged, table, unstaged, utf8_column
from spindrift.llm.toxicity import id_crc

HOT_WORDS, UNIT_WORDS, SUFFIXES, SUFFIX_CHARS = 262_144, 8_192, 1_023, 3
LEAST_CLASSES, MOST_CLASSES, PASSES = 16, 250, 4
MIX, ALPHA = 0.95, 0.5
END = b" "  # no word holds a space
FLUSH, KEPT_CONTEXTS, KEPT_OCCURRENCES = 1_000_000, 400_000, 4_000_000
#: Counts are told apart by their logarithm in steps of a sixteenth, to find the threshold of hot words.
STEPS = 16
BLOCK_UNITS, SALTS = 512, 64


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in utf8_column(batch.column(0)):
            counts.update(text.lower().split())
            counts[END] += 1
        if len(counts) > FLUSH:
            yield part()
            counts = Counter()
    if counts:
        yield part()


class Vocabulary:
    """Bounded tables: counts of the hot words, units of words and endings."""

    def __init__(self, hot: list[tuple[bytes, int]], suffixes: list[str], total: int, distinct: int, ends: int):
        self.hot = [w for w, _ in hot]
        self.hot_counts = np.array([c for _, c in hot], dtype=np.int64)
        self.suffixes = suffixes
        self.total, self.distinct, self.ends = total, distinct, ends  # ends: the end token's count
        self.words = min(UNIT_WORDS, len(hot))
        self.end = self.words + len(suffixes) + 1
        self.units = self.end + 1

    @property
    def log_all(self) -> float:
        return float(np.log10(self.total + self.distinct + 1))

    def tables(self):
        """What a task looks up: index of a hot word, unit of a hot word's index, unit of an ending."""

        class Index(dict):
            def __missing__(self, word):
                return -1

        index = Index(zip(self.hot, range(len(self.hot)), strict=True))
        ending = {s: self.words + i for i, s in enumerate(self.suffixes)}
        unit = np.arange(len(self.hot))
        rest = self.end - 1
        unit[self.words :] = [ending.get(w.decode()[-SUFFIX_CHARS:], rest) for w in self.hot[self.words :]]
        return index, unit, ending, rest


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, units binary, words binary, rare array<string>, times array<int>"


def _code(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, unit, ending, rest = v.tables()
        look, logs = index.__getitem__, np.log10(v.hot_counts + 1.0) - v.log_all
        end = float(np.log10(v.ends + 1.0)) - v.log_all
        for batch in batches:
            n_, known_, base_, units_, words_, rare_, times_ = [], [], [], [], [], [], []
            for text in utf8_column(batch.column(2)):
                words = text.lower().split()
                at = np.fromiter(map(look, words), np.int32, len(words))
                missed = np.flatnonzero(at < 0)
                coded = unit[at] if len(v.hot) else np.zeros(len(at), int)
                rare: Counter = Counter()
                if len(missed):
                    lacking = [words[i] for i in missed]
                    rare = Counter(lacking)
                    own = {w: (ending.get(w.decode()[-SUFFIX_CHARS:], rest), -1 - i) for i, w in enumerate(rare)}
                    coded[missed], at[missed] = np.array([own[w] for w in lacking]).T
                hits = at[at >= 0]
                n_.append(len(words) + 1)
                known_.append(len(hits) + (v.ends > 0))
                base_.append(float(logs[hits].sum()) + end)
                units_.append(coded.astype("<u2").tobytes())
                words_.append(at.astype("<i4").tobytes())
                rare_.append([w.decode() for w in rare])
                times_.append(list(rare.values()))
            cols = [batch.column(0), batch.column(1), pa.array(n_, pa.int64()), pa.array(known_, pa.int64()), pa.array(base_, pa.float64()), pa.array(units_, pa.binary()), pa.array(words_, pa.binary()), pa.array(rare_, pa.list_(pa.string())), pa.array(times_, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "units", "words", "rare", "times"])

    return run


def _contexts(owner: np.ndarray, end: int):
    """Per unit, how often each class follows and precedes it, in blocks of units."""
    classes = int(owner.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = np.zeros(len(owner) * classes, np.int64)
        before = np.zeros(len(owner) * classes, np.int64)
        stop = np.array([end], "<u2").tobytes()
        for batch in batches:
            run_ = np.frombuffer(stop + stop.join(x or b"" for x in batch.column(0).to_pylist()) + stop, "<u2").astype(np.int64)
            own = owner[run_]
            after += np.bincount(run_[:-1] * classes + own[1:], minlength=len(after))
            before += np.bincount(run_[1:] * classes + own[:-1], minlength=len(before))
        step = BLOCK_UNITS * classes
        rows = [(i // step, after[i : i + step].tobytes(), before[i : i + step].tobytes()) for i in range(0, len(after), step)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "after", "before"])

    return run


def _summed(t: pa.Table) -> pa.Table:
    sums = [sum((np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()), np.int64(0)) for c in ("after", "before")]
    return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "after": pa.array([sums[0].tobytes()], pa.binary()), "before": pa.array([sums[1].tobytes()], pa.binary())})


def contexts(units: DataFrame, owner: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    schema = "block int, after binary, before binary"
    parts = units.mapInArrow(_contexts(owner, end), schema).withColumn("salt", F.spark_partition_id() % SALTS)
    found = parts.groupBy("block", "salt").applyInArrow(_summed, schema).groupBy("block").applyInArrow(_summed, schema).collect()
    classes = int(owner.max()) + 1
    out = [np.zeros(len(owner) * classes, np.int64) for _ in range(2)]
    for r in found:  # units x classes numbers, whatever the corpus
        at = r["block"] * BLOCK_UNITS * classes
        for o, raw in zip(out, (r["after"], r["before"]), strict=True):
            x = np.frombuffer(bytes(raw), np.int64)
            o[at : at + len(x)] = x
    return out[0].reshape(-1, classes), out[1].reshape(-1, classes)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(owner: np.ndarray, after: np.ndarray, before: np.ndarray, end: int, order: np.ndarray) -> tuple[np.ndarray, int]:
    """One sweep: each unit, most frequent first, moves to the class of highest likelihood
    sum f(N(c,d)) - sum f(N(c,.)) - sum f(N(.,c)), given the other units' classes of the pass."""
    classes = after.shape[1]
    table_ = np.zeros((classes, classes))
    np.add.at(table_, owner, after)
    owner, moved = owner.copy(), 0
    free = classes - 1  # the end token's class takes no other unit
    left, right = table_.sum(1), table_.sum(0)
    for u in order:
        if u == end:
            continue
        a, out, into = owner[u], after[u].astype(float), before[u].astype(float)
        n_out, n_in = out.sum(), into.sum()
        if not n_out + n_in:
            continue
        table_[a] = np.maximum(table_[a] - out, 0)
        table_[:, a] = np.maximum(table_[:, a] - into, 0)
        left[a] -= n_out
        right[a] -= n_in
        t = table_[:free]
        gain = (_f(t + out) - _f(t)).sum(1)
        t = table_[:, :free].T
        gain += (_f(t + into) - _f(t)).sum(1)
        gain -= _f(left[:free] + n_out) - _f(left[:free]) + _f(right[:free] + n_in) - _f(right[:free])
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9:
            b = a
        moved += b != a
        owner[u] = b
        table_[b] += out
        table_[:, b] += into
        left[b] += n_out
        right[b] += n_in
    return owner, moved


def train(v: Vocabulary, units: DataFrame, unit_mass: np.ndarray, classes: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units, and the transitions they make. ``unit_mass``: per unit, its words'
    count plus their number. The last class is the end token's alone."""
    classes = min(classes, max(1, v.units - 1))
    owner = np.full(v.units, classes - 1)
    order = np.argsort(-unit_mass, kind="stable")
    first = [u for u in order if u != v.end][: classes - 1]
    owner[first] = np.arange(len(first))
    owner[v.end] = classes
    for _ in range(passes):
        after, before = contexts(units, owner, v.end)
        owner, moved = exchange(owner, after, before, v.end, order)
        if not moved:
            break
    after, _ = contexts(units, owner, v.end)
    pairs = np.zeros((classes + 1, classes + 1))
    np.add.at(pairs, owner, after)
    return owner, pairs


# ---------------------------------------------------------------------------- words outside the units


def _neighbours(v: Vocabulary, owner: np.ndarray):
    """(word, packed): of each word that isn't a unit of its own, how often each class follows it
    (key: the class) and precedes it (key: classes + the class) in the task's texts."""
    classes = int(owner.max()) + 1
    stop = int(owner[v.end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, unit, ending, rest = v.tables()
        look = index.__getitem__
        number: dict[bytes, int] = {}
        kept = 0
        seen: list[np.ndarray] = []  # number of the word * 2 * classes + key, an occurrence and side

        def part() -> pa.RecordBatch:
            both, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)
            word, key = both // (2 * classes), both % (2 * classes)
            packed = pa.py_buffer(np.stack([key, n], 1).astype("<u4").tobytes())
            ends = 8 * np.searchsorted(word, np.arange(len(number) + 1))
            column = pa.Array.from_buffers(pa.large_binary(), len(number), [None, pa.py_buffer(ends.astype("<i8").tobytes()), packed]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(number), pa.binary()).cast(pa.string()), column], names=["word", "packed"])

        for batch in batches:
            for text in utf8_column(batch.column(0)):
                words = text.lower().split()
                if not words:
                    continue
                at = np.fromiter(map(look, words), np.int32, len(words))
                coded = unit[at] if len(v.hot) else np.zeros(len(at), int)
                missed = np.flatnonzero(at < 0)
                coded[missed] = [ending.get(words[i].decode()[-SUFFIX_CHARS:], rest) for i in missed.tolist()]
                own = owner[coded].astype(np.int64)
                places = np.flatnonzero((at < 0) | (at >= v.words))
                first = np.array([number.setdefault(words[i], len(number)) for i in places.tolist()], np.int64) * (2 * classes)
                seen += (first + np.append(own[1:], stop)[places], first + classes + np.append(stop, own[:-1])[places])
                kept += 2 * len(places)
                if len(number) > KEPT_CONTEXTS or kept > KEPT_OCCURRENCES:
                    yield part()
                    number.clear()
                    seen.clear()
                    kept = 0
        yield part()

    return run


def _assigned(v: Vocabulary, owner: np.ndarray, pairs: np.ndarray):
    """The class of each word of rows (word, packed) sorted by word: the step of ``exchange`` for a
    single word, for many words at once."""
    classes = len(pairs)
    free = max(1, classes - 1)
    f_pairs, left, right = _f(pairs), pairs.sum(1), pairs.sum(0)

    def judged(words: list[str], keys: np.ndarray, n: np.ndarray, word: np.ndarray) -> np.ndarray:
        ending = {s: v.words + i for i, s in enumerate(v.suffixes)}
        now = owner[[ending.get(w[-SUFFIX_CHARS:], v.end - 1) for w in words]]
        both, times = np.unique(word * (2 * classes) + keys, return_inverse=True)
        n = np.bincount(times, n)
        word, key = both // (2 * classes), both % (2 * classes)
        rows = np.arange(len(key))
        follows = key < classes
        # per (word, class met): what each class's transitions gain by taking the word in
        held = np.where(follows[:, None], pairs[:free, key % classes].T, pairs[key % classes, :free])
        was = np.where(follows[:, None], f_pairs[:free, key % classes].T, f_pairs[key % classes, :free])
        mine = now[word]
        held[rows, mine] = np.maximum(held[rows, mine] - n, 0)
        was[rows, mine] = _f(held[rows, mine])
        gains = np.zeros((len(words), free))
        np.add.at(gains, word, _f(held + n[:, None]) - was)
        each = np.arange(len(words))
        for total, chosen in ((left, follows), (right, ~follows)):
            m = np.bincount(word[chosen], n[chosen], len(words))
            t = np.repeat(total[None, :free], len(words), 0)
            t[each, now] = np.maximum(t[each, now] - m, 0)
            gains -= _f(t + m[:, None]) - _f(t)
        gains[:, (left + right)[:free] == 0] = -np.inf  # an empty class suits each word alone, but not all that would go there
        best = gains.argmax(1)
        return np.where(gains[each, best] > gains[each, now] + 1e-9, best, now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, list[bytes]] | None = None

        def out(rows: list[tuple[str, list[bytes]]]) -> pa.RecordBatch:
            words = [w for w, _ in rows]
            packed = [b"".join(x) for _, x in rows]
            triples = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2).astype(np.int64)
            own = np.repeat(np.arange(len(words)), [len(x) // 8 for x in packed])
            found = judged(words, triples[:, 0], triples[:, 1], own) if words else np.zeros(0, int)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(found, pa.int32())], names=["word", "class"])

        for batch in batches:
            rows: list[tuple[str, list[bytes]]] = [] if held is None else [held]
            for w, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows and rows[-1][0] == w:
                    rows[-1][1].append(x)
                else:
                    rows.append((w, [x]))
            if rows:
                held = rows.pop()  # it may go on in the next batch
                yield out(rows)
        if held is not None:
            yield out([held])

    return run


# ---------------------------------------------------------------------------- scoring


def _classed(hot_class: np.ndarray):
    """A class per token, one byte each, of rows that end in (words, rare classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, rare in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                at = np.frombuffer(raw or b"", "<i4")
                own = np.empty(len(at), np.uint8)
                own[at >= 0] = hot_class[at[at >= 0]]
                own[at < 0] = np.array(rare or [], np.uint8)[-1 - at[at < 0]]
                out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "classes"])

    return run


def _transitions(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(classes * classes, np.int64)
        stop = bytes([classes - 1])
        for batch in batches:
            run_ = np.frombuffer(stop + stop.join(x or b"" for x in batch.column(0).to_pylist()) + stop, np.uint8).astype(np.int64)
            found += np.bincount(run_[:-1] * classes + run_[1:], minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], names=["pair", "n"])

    return run


def _gains(gains: np.ndarray):
    stop = bytes([len(gains) - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                own = np.frombuffer(stop + (raw or b"") + stop, np.uint8)
                out.append(float(gains[own[:-1], own[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "gain"])

    return run


def class_gains(pairs: np.ndarray, mass: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of z * (MIX * T / U + 1 - MIX) for each pair of classes. ``mass``: per class, its
    words' counts plus their number; each class but the end token's has one unseen word."""
    classes = len(pairs)
    t = (pairs + ALPHA) / (pairs.sum(1, keepdims=True) + ALPHA * classes)
    unseen = np.ones(classes)
    unseen[-1] = 0 if total else 1
    every = total + distinct + 1
    z = 1 / (MIX + (1 - MIX) * (total + distinct + unseen.sum()) / every)
    return np.log10(z * (MIX * t / ((mass + unseen) / every)[None, :] + 1 - MIX))


def hot_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The words of at least the least count that no more than HOT_WORDS words have, most frequent
    first. Every task sends on only such words; which count it is follows from a table of steps."""
    step = F.floor(F.log2("c") * STEPS).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()  # at most 64 * STEPS rows
    least, seen = None, 0
    for r in steps:
        seen += r["n"]
        if seen > HOT_WORDS:
            break
        least = r["least"]
    if least is None:
        return []
    hot = counts.where(F.col("c") >= least).toArrow()
    rows = zip(hot.column("word").to_pylist(), hot.column("c").to_pylist(), strict=True)
    return sorted(((w.encode(), c) for w, c in rows), key=lambda x: (-x[1], x[0]))


def _learned(rows: DataFrame) -> tuple[Vocabulary, DataFrame, DataFrame, np.ndarray, np.ndarray, np.ndarray, list[DataFrame]]:
    """Vocabulary, coded texts, the table of all words (word, c, class), the classes of the hot
    words and of the endings' units, the gains of pairs of classes, and the tables to drop later."""
    spark = rows.sparkSession
    texts = rows.where(~F.col("held_out")).select("text")
    counts = staged(texts.mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = END.decode()  # in every text, so it has its own unit and no place in the ranked tables
    ends = counts.where(F.col("word") == end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot_rows = hot_words(counts.where(F.col("word") != end))
    units = {w.decode() for w, _ in hot_rows[:UNIT_WORDS]} | {end}
    top = spark.createDataFrame([(w,) for w in sorted(units)], "word string")
    others = counts.join(F.broadcast(top), "word", "left_anti").groupBy(F.right("word", F.lit(SUFFIX_CHARS)).alias("suffix")).agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    mass_all = others.agg(F.coalesce(F.sum(F.col("c") + F.col("n")), F.lit(0))).first()[0]
    endings = others.orderBy(F.desc("c"), "suffix").limit(SUFFIXES).collect()
    v = Vocabulary(hot_rows, [r["suffix"] for r in endings], total, distinct, ends)
    mass = np.zeros(v.units)
    for i, (w, c) in enumerate(hot_rows[:UNIT_WORDS]):
        mass[i] = c + 1
    mass[v.end] = ends + 1 if ends else 0
    for i, r in enumerate(endings):
        mass[v.words + i] = r["c"] + r["n"]
    mass[v.end - 1] = mass_all - sum(r["c"] + r["n"] for r in endings)
    coded = staged(rows.mapInArrow(_code(v), CODED).withColumn("row", F.monotonically_increasing_id()), "coded")
    owner, pairs = train(v, coded.where(~F.col("held_out")).select("units"), mass, min(MOST_CLASSES, max(LEAST_CLASSES, round(distinct**0.25))))
    near = texts.mapInArrow(_neighbours(v, owner), "word string, packed binary").repartition("word").sortWithinPartitions("word")
    tail = near.mapInArrow(_assigned(v, owner, pairs), "word string, class int")
    head = spark.createDataFrame([(w.decode(), int(owner[i])) for i, (w, _) in enumerate(hot_rows[:UNIT_WORDS])] + [(end, int(owner[v.end]))], "word string, class int")
    table_ = staged(counts.join(tail.unionByName(head), "word").select("word", "c", "class"), "word-classes")
    of_class = {r["class"]: r["m"] for r in table_.groupBy("class").agg(F.sum(F.col("c") + 1).alias("m")).collect()}
    found = {w: k for w, k in table_.where((F.col("c") >= (hot_rows[-1][1] if hot_rows else 0)) & (F.col("word") != end)).select("word", "class").toArrow().to_pandas().itertuples(index=False)}  # the hot words
    hot_class = np.array([found[w.decode()] for w, _ in hot_rows], np.int64)
    n = int(owner[v.end]) + 1
    return v, coded, table_, hot_class, owner, np.array([of_class.get(k, 0) for k in range(n)], float), [counts, coded, table_]


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores every row; rows for which ``held_out`` (a condition on doc_id) holds aren't learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    v, coded, words, hot_class, owner, mass, parts = _learned(rows)
    ending = F.create_map(*[F.lit(x) for i, s in enumerate(v.suffixes) for x in (s, int(owner[v.words + i]))]) if v.suffixes else F.create_map(F.lit(""), F.lit(int(owner[v.end - 1])))
    unseen = F.coalesce(F.try_element_at(ending, F.right("word", F.lit(SUFFIX_CHARS))), F.lit(int(owner[v.end - 1])))
    rare = coded.select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("nth", "r")).select("row", "nth", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1) - F.lit(v.log_all))).alias("rare_base"),
        F.array_sort(F.collect_list(F.struct("nth", F.coalesce("class", unseen).alias("class")))).alias("rare_class"),
    )
    whole = coded.drop("rare", "times", "units").join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base"),
        "words",
        F.transform("rare_class", lambda x: x["class"]).alias("rare"),
    )
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, base double"
    classed = staged(whole.mapInArrow(_classed(hot_class), f"{shape}, classes binary"), "classed")
    unstaged(*parts)
    n = len(mass)
    pairs = np.zeros(n * n)
    for r in classed.where(~F.col("held_out")).select("classes").mapInArrow(_transitions(n), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # classes squared
        pairs[r["pair"]] = r["n"]
    gains = class_gains(pairs.reshape(n, n), mass, v.total, v.distinct)
    scored = classed.mapInArrow(_gains(gains), f"{shape}, gain double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("gain")).alias("score"))


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), id_crc() % 7 == 2)
