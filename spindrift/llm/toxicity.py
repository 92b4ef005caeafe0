"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features are rates and counts of a whole text: lexicon words and stems, their closeness to the
second person, capitals, punctuation, obfuscation. The lexicon is a short fixed list plus the
words and stems that the labelled rows single out. Trees are fitted on the driver from the dense
features of at most ``TRAIN_DOCS`` labelled documents (those of smallest md5 of the id). To
calibrate, each of ``FOLDS`` parts is scored by trees and by a lexicon that haven't seen its labels;
word statistics for the lexicons are summed by the executors, in one pass.
Scoring is one narrow pass: each word is judged once per worker and remembered in a bounded table.

Defined results: a null or empty text has all-zero features and gets their score; rows with equal
ids are scored each on their own; a label that is null or whose document is missing is not used;
several labels of one document count as toxic if one is; of rows that share a labelled id the one
of smallest text is learned from; an empty table gives no rows. Trees need at least 2 * ``Trees.least``
rows of each class, and both classes outside each part; with fewer every score is the share of toxic
rows among the learned ones (0 without any).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import staged, table, unstaged, utf8_column

TRAIN_DOCS = 12_000
THRESHOLD = 0.7
#: A learned term occurs in so many of the toxic documents (a number, a share), and at least
#: ``PRECISION`` of the documents that hold it are toxic.
LEAST_TOXIC, TOXIC_SHARE, PRECISION, MOST_TERMS = 3, 0.003, 0.8, 4096
FOLDS = 3
STEMS = (4, 5, 6)
#: Words that a worker remembers for each lexicon.
KEPT_WORDS = 120_000
NEAR, SPAN = 5, 50

# Insults and second-person words of the four languages.
INSULTS = frozenset("idiot moron stupid loser trash scum pathetic disgusting worthless clown dumb imbecile arschloch blödmann dummkopf versager connard imbécile crétin idiota estúpido imbécil basura".split())
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine euch ihr tu toi ton ta tes vous votre vos te ti tú usted ustedes vosotros".split())
UNLEET = str.maketrans("013457@$!|", "oieastasil")
INNER = re.compile(r"[\W_]+")
REPEATED = re.compile(r"(.)\1{2,}")

LEXICON, STEM, HIDDEN, SECOND, CAPITALS, BROKEN = 1, 2, 4, 8, 16, 32
NAMES = ["words", "chars", "lexicon", "lexicon_rate", "stems", "stem_rate", "hits", "hit_rate", "most_in_span", "hidden", "hidden_rate", "near_second", "near_rate", "second_rate", "capital_words", "capitals", "exclaims", "questions", "punctuation", "symbols", "digits", "broken_rate"]
UPPER, DIGITS, PUNCTUATION, SYMBOLS = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "*#$%&@_~^=+<>|/\\"))


class Judge(dict):
    """A raw word's marks; each word is judged once."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        super().__init__()
        self.words, self.stems = words | INSULTS, stems

    def hit(self, w: str) -> int:
        return (LEXICON if w in self.words else 0) | (STEM if any(w[:n] in self.stems for n in STEMS if len(w) > n) else 0)

    def __missing__(self, raw: bytes) -> int:
        text = raw.decode("utf-8", "replace")
        low = text.lower().strip(".,;:!?\"'()[]{}*#$%&@-_~<>/\\|")
        marks = self.hit(low)
        if not marks and len(low) > 2:
            plain = REPEATED.sub(r"\1", INNER.sub("", low.translate(UNLEET)))
            if plain != low:
                marks |= HIDDEN if self.hit(plain) else 0
            if not low.isalpha():
                marks |= BROKEN
        if low in SECOND_PERSON:
            marks |= SECOND
        if len(low) > 1 and text.isupper():
            marks |= CAPITALS
        self[raw] = marks
        return marks


def features(text: bytes, judge: Judge) -> list[float]:
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    marks = np.frombuffer(bytes(map(judge.__getitem__, words)), np.uint8)
    lexicon, stems, hidden, second, capitals, broken = (int(np.count_nonzero(marks & m)) for m in (LEXICON, STEM, HIDDEN, SECOND, CAPITALS, BROKEN))
    at = np.flatnonzero(marks & (LEXICON | STEM | HIDDEN))
    hits, near, most = len(at), 0, 0
    if hits:
        most = int((np.searchsorted(at, at + SPAN) - np.arange(hits)).max())
        if second:
            ahead = np.concatenate([[0], np.cumsum((marks & SECOND) > 0)])
            near = int((ahead[np.minimum(at + NEAR + 1, n)] > ahead[np.maximum(at - NEAR, 0)]).sum())
    count = lambda drop: size - len(text.translate(None, drop))
    return [
        np.log1p(n), np.log1p(size), np.log1p(lexicon), lexicon / n, np.log1p(stems), stems / n, np.log1p(hits), hits / n, most, np.log1p(hidden), hidden / n,
        near, near / n, second / n, capitals / n, count(UPPER) / size, text.count(b"!") / size, text.count(b"?") / size, count(PUNCTUATION) / size, count(SYMBOLS) / size, count(DIGITS) / size, broken / n,
    ]


# ---------------------------------------------------------------------------- boosting


@dataclass
class Trees:
    """Binary logistic boosting on binned features; trees are complete and of fixed depth."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    bins: int = 64
    least: int = 5
    penalty: float = 1.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, self.bins - 2))) for c in x.T]
        coded = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(coded, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._walk(coded, tree)
        return self

    def _grow(self, coded: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = 2**self.depth - 1
        which, cut = np.zeros(inner, int), np.full(inner, self.bins + 1)
        node = np.zeros(len(g), int)
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            for j in range(coded.shape[1]):
                key = (node - first) * (self.bins + 2) + coded[:, j]
                G, H, C = (np.bincount(key, w, n * (self.bins + 2)).reshape(n, -1).cumsum(1) for w in (g, h, None))
                tg, th, tc = G[:, -1:], H[:, -1:], C[:, -1:]
                gain = G**2 / (H + self.penalty) + (tg - G) ** 2 / (th - H + self.penalty) - tg**2 / (th + self.penalty)
                gain[(C < self.least) | (tc - C < self.least)] = -1
                at = gain.argmax(1)
                better = gain[np.arange(n), at] > best
                best[better] = gain[np.arange(n), at][better]
                which[first : first + n][better], cut[first : first + n][better] = j, at[better]
            node = 2 * node + 1 + (coded[np.arange(len(g)), which[node]] > cut[node])
        leaf = node - inner
        sums = [np.bincount(leaf, w, inner + 1) for w in (g, h)]
        return which, cut, self.rate * sums[0] / (sums[1] + self.penalty)

    def _walk(self, coded: np.ndarray, tree) -> np.ndarray:
        which, cut, value = tree
        node, rows = np.zeros(len(coded), int), np.arange(len(coded))
        for _ in range(self.depth):
            node = 2 * node + 1 + (coded[rows, which[node]] > cut[node])
        return value[node - len(which)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        coded = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        return self.base + sum((self._walk(coded, t) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (middle score, mean label) of each block, both ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([s, s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return np.array([(b[0] + b[1]) / 2 for b in blocks]), np.array([b[2] / b[3] for b in blocks])


@dataclass
class Model:
    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    trees: Trees | None = None
    at: np.ndarray | None = None
    share: np.ndarray | None = None
    constant: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        raw = self.trees.raw(x)
        # A hundredth of the trees' own probability keeps order within a block of equal calibration.
        return np.clip(0.99 * np.interp(raw, self.at, self.share) + 0.01 / (1 + np.exp(-raw)), 0, 1)


def boosted(xs: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> tuple[Trees, np.ndarray, np.ndarray]:
    """Trees of all rows (features xs[FOLDS]), and the calibration of the scores that the rows of
    each part k get from the other parts' trees (features xs[k], of a lexicon without part k)."""
    raw = np.empty(len(y))
    for k in np.unique(fold):
        raw[fold == k] = Trees().fit(xs[k][fold != k], y[fold != k]).raw(xs[k][fold == k])
    return Trees().fit(xs[FOLDS], y), *isotonic(raw, y)


# ---------------------------------------------------------------------------- Spark side


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, part, toxic documents, all documents) of one task's rows; stems end in '*'."""
    from collections import Counter

    toxic, every = [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]
    for batch in batches:
        for text, label, k in zip(utf8_column(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = {w.lower().strip(".,;:!?\"'()[]{}") for w in text.decode("utf-8", "replace").split()}
            terms = words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
            every[k].update(terms)
            if label:
                toxic[k].update(terms)
    for k in range(FOLDS):
        terms = [t for t in every[k] if t]
        cols = [pa.array(terms, pa.string()), pa.array([k] * len(terms), pa.int32()), pa.array([toxic[k][t] for t in terms], pa.int64()), pa.array([every[k][t] for t in terms], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "fold", "toxic", "n"])


Lexicon = tuple[frozenset[str], frozenset[str]]


def lexicons(sample: DataFrame, toxic_of: list[int]) -> list[Lexicon]:
    """Words and stems that all parts but k single out, for each part k, and those of all parts.
    ``toxic_of``: toxic documents of each part."""
    without = lambda c, k: F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0))
    sums = [without(c, k).alias(f"{c}{k}") for k in range(FOLDS + 1) for c in ("toxic", "n")]
    terms = staged(sample.select("text", "toxic", "fold").mapInArrow(_terms, "term string, fold int, toxic long, n long").groupBy("term").agg(*sums), "toxicity-terms")
    out = []
    for k in range(FOLDS + 1):
        toxic, n = F.col(f"toxic{k}"), F.col(f"n{k}")
        least = max(LEAST_TOXIC, TOXIC_SHARE * (sum(toxic_of) - (toxic_of[k] if k < FOLDS else 0)))
        best = [r[0] for r in terms.where((toxic >= least) & (toxic >= PRECISION * n)).orderBy(F.desc(toxic), "term").limit(MOST_TERMS).select("term").collect()]
        out.append((frozenset(t for t in best if not t.endswith("*")), frozenset(t[:-1] for t in best if t.endswith("*"))))
    unstaged(terms)
    return out


_JUDGES: dict[int, Judge] = {}


def judge_of(words: frozenset[str], stems: frozenset[str]) -> Judge:
    """The worker's own, kept from task to task."""
    key = hash((words, stems))
    if key not in _JUDGES or (_JUDGES[key].words, _JUDGES[key].stems) != (words | INSULTS, stems):
        _JUDGES.clear()
        _JUDGES[key] = Judge(words, stems)
    return _JUDGES[key]


def _rows(judge: Judge, texts) -> np.ndarray:
    if len(judge) > KEPT_WORDS:
        judge.clear()
    rows = [features(t, judge) for t in texts]
    return np.array(rows, dtype=float).reshape(len(rows), len(NAMES))


def _featured(chosen: list[Lexicon]):
    """The features of each lexicon, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = [Judge(*c) for c in chosen]
        for batch in batches:
            x = np.concatenate([_rows(judge, utf8_column(batch.column(0))) for judge in judges], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["toxic", "x", "fold"])

    return run


def id_crc(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, use, limit: int = TRAIN_DOCS) -> Model:
    """Learns from the labelled documents for whose doc_id ``use`` (a condition) holds."""
    order = F.md5(F.concat_ws(":", F.lit("toxicity"), F.col("doc_id").cast("string")))
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(use).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(order).limit(limit)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # limit rows at most
    sample = staged(labelled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", fold.alias("fold")), "toxicity-sample")
    n = {(r["fold"], r["toxic"] > 0): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    of = {c: [n.get((k, c), 0) for k in range(FOLDS)] for c in (False, True)}
    if any(sum(v) < 2 * Trees.least or sum(v) in v for v in of.values()):
        unstaged(sample)
        return Model(constant=sum(of[True]) / max(1, sum(n.values())))
    chosen_terms = lexicons(sample, of[True])
    seen = sample.select("text", "toxic", "fold").mapInArrow(_featured(chosen_terms), "toxic int, x array<double>, fold int").toArrow()
    unstaged(sample)
    x = np.array(seen.column("x").to_pylist(), dtype=float).reshape(seen.num_rows, -1)
    y, folds = np.asarray(seen.column("toxic")).astype(float), np.asarray(seen.column("fold"))
    arrived = np.lexsort(np.column_stack([x, y, folds]).T)  # the same trees however the rows arrive
    x, y, folds = x[arrived], y[arrived], folds[arrived]
    trees, at, share = boosted(np.split(x, FOLDS + 1, axis=1), y, folds)
    return Model(*chosen_terms[FOLDS], trees, at, share)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of(model.words, model.stems)
        for batch in batches:
            s = model.scores(_rows(judge, utf8_column(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows below the threshold, all their columns; texts don't move."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of(model.words, model.stems)
        for batch in batches:
            s = model.scores(_rows(judge, utf8_column(batch.column(place))))
            yield batch.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def training_rows():
    return id_crc() % 3 != 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels, training_rows())).select("doc_id", F.coalesce(id_crc() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
