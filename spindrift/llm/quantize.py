"""Vector codes by exact integer k-means: product quantisation with filtering Lloyd rounds.

Vectors are scaled to integers and cut into equal parts; each part position has a codebook of its
own. Rows are taken in blocks of ``BLOCK``. A block builds one kd-tree for each part position,
once: nodes split at the median of their widest dimension and hold the bounding box, the count and
the sum of their rows. The trees are written to the shared folder and read by every round.

A round walks each tree from the root with a list of candidate entries. The entry nearest to the
box's middle is kept; another one goes where even the box's corner farthest towards it is closer to
the kept one (on equal distance, where its index is larger). A node with one candidate left gives
its whole count and sum to it; a leaf compares its rows with those that are left. All arithmetic is
on integers, so blocks, partitions and retries can't change a result. Tasks send one row for each
entry and position they gave something to; the driver holds the codebooks alone (parts x entries x
width numbers, whatever the input).

Defined results: rows whose vector is null, empty, or holds null or non-finite components are left
out; so are vectors of another length than that of the first one kept (by id, then components, null
ids last). A length that the number of parts doesn't divide is filled up with zeros. With fewer
rows than entries each row's part is an entry; equal entries stay, and the lower index wins. An
empty table gives no rows. Null labels count as one label. Repeated ids are rows of their own.
Other columns are not read. Components too large for sums of squares in 64 bits are computed with
unbounded integers; an error above the largest long is returned as that long.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import staged, table, unstaged

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Rows of a block and of a tree's leaf.
BLOCK, LEAF = 4_096, 16
LARGEST = (1 << 63) - 1


def exact(x: np.ndarray, width: int) -> np.ndarray:
    """As 64-bit integers if sums of squared differences fit in them, else as Python's."""
    most = max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0
    return x.astype(np.int64) if (2 * most + 1) ** 2 * max(width, 1) * 4 < LARGEST else x.astype(object)


def scaled(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) of each component, in double precision."""
    x = np.floor(np.asarray(vectors, np.float64) * scale)
    if not np.isfinite(x).all():
        return np.array([[math.floor(v) * scale if math.isfinite(v) and not math.isfinite(v * scale) else math.floor(v * scale) for v in row] for row in vectors], object)
    return x.astype(np.int64) if np.abs(x).max(initial=0) < 2**62 else np.array([[int(v) for v in row] for row in x], object)


# ---------------------------------------------------------------------------- trees


class Tree:
    """order: rows of the block, so that each node's are start to end. left: 0 for a leaf; the right
    child follows the left one's subtree at ``right``."""

    FIELDS = ("order", "start", "end", "left", "right", "low", "high", "total")

    def __init__(self, **fields):
        self.__dict__.update(fields)

    @classmethod
    def of(cls, x: np.ndarray) -> Tree:
        order = np.arange(len(x))
        start, end, left, right, low, high, total = [], [], [], [], [], [], []

        def node(a: int, b: int) -> int:
            rows = x[order[a:b]]
            start.append(a), end.append(b), left.append(0), right.append(0)
            low.append(rows.min(axis=0)), high.append(rows.max(axis=0)), total.append(rows.sum(axis=0))
            return len(start) - 1

        todo = [node(0, len(x))] if len(x) else []
        while todo:
            i = todo.pop()
            a, b = start[i], end[i]
            spread = high[i] - low[i]
            at = int(np.argmax(spread))
            if b - a <= LEAF or not spread[at]:
                continue
            values = x[order[a:b], at]
            order[a:b] = order[a:b][np.argsort(values, kind="stable")]
            mid = (a + b) // 2
            left[i], right[i] = node(a, mid), node(mid, b)
            todo += [left[i], right[i]]
        stack = lambda v: np.stack(v) if v else np.zeros((0, x.shape[1]), x.dtype)
        return cls(order=order, start=np.array(start, np.int64), end=np.array(end, np.int64), left=np.array(left, np.int64), right=np.array(right, np.int64), low=stack(low), high=stack(high), total=stack(total))


def nearest(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The first of the nearest entries of each row."""
    gap = rows[:, None, :] - entries[None, :, :]
    return np.argmin((gap * gap).sum(axis=2), axis=1)


def filtered(tree: Tree, x: np.ndarray, book: np.ndarray, take) -> None:
    """Gives every row to its nearest entry: take(entry, node) for a whole node, take(entries,
    rows) for rows of a leaf."""
    todo = [(0, np.arange(len(book)))] if len(tree.start) else []
    while todo:
        i, some = todo.pop()
        low, high = tree.low[i], tree.high[i]
        if len(some) > 1:
            away = 2 * book[some] - (low + high)
            best = some[int(np.argmin((away * away).sum(axis=1)))]
            other, kept = book[some], book[best]
            # at the box's corner farthest towards an entry, is the kept one still closer?
            corner = np.where(other > kept, high, low)
            gap = ((other - corner) ** 2 - (kept - corner) ** 2).sum(axis=1)
            some = some[(gap < 0) | ((gap == 0) & (some < best)) | (some == best)]
        if len(some) == 1:
            take(int(some[0]), i, None)
        elif tree.left[i]:
            todo += [(tree.left[i], some), (tree.right[i], some)]
        else:
            rows = tree.order[tree.start[i] : tree.end[i]]
            take(some[nearest(x[rows], book[some])], None, rows)


def gathered(tree: Tree, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) of the rows of each entry."""
    count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, x.dtype)

    def take(entry, node, rows):
        if rows is None:
            count[entry] += tree.end[node] - tree.start[node]
            total[entry] += tree.total[node]
        else:
            np.add.at(count, entry, 1)
            np.add.at(total, entry, x[rows])

    filtered(tree, x, book, take)
    return count, total


def assigned(tree: Tree, x: np.ndarray, book: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(x), np.int64)

    def take(entry, node, rows):
        codes[tree.order[tree.start[node] : tree.end[node]] if rows is None else rows] = entry

    filtered(tree, x, book, take)
    return codes


def packed(parts: list[np.ndarray]) -> bytes:
    """The parts of a block and their trees, as one NumPy archive; unbounded integers as text."""
    held = {}
    for p, x in enumerate(parts):
        tree = Tree.of(x)
        held |= {f"{p}-x": x} | {f"{p}-{f}": getattr(tree, f) for f in Tree.FIELDS}
    out = io.BytesIO()
    np.savez(out, **{k: np.array(v.astype(str), "U") if v.dtype == object else v for k, v in held.items()})
    return out.getvalue()


def unpacked(data: bytes) -> list[tuple[Tree, np.ndarray]]:
    held = {k: v if v.dtype.kind != "U" else np.array([int(s) for s in v.ravel()], object).reshape(v.shape) for k, v in np.load(io.BytesIO(data)).items()}
    n = len({k.split("-")[0] for k in held})
    return [(Tree(**{f: held[f"{p}-{f}"] for f in Tree.FIELDS}), held[f"{p}-x"]) for p in range(n)]


# ---------------------------------------------------------------------------- rounds

BLOCKS = "ids array<bigint>, labels array<string>, trees binary"


def split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal consecutive parts; zeros fill up what is missing."""
    width = -(-x.shape[1] // parts)
    whole = np.zeros((len(x), width * parts), x.dtype)
    whole[:, : x.shape[1]] = x
    return [exact(whole[:, p * width : (p + 1) * width], width) for p in range(parts)]


def _blocks(parts: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows):
            trees = packed(split(scaled([v for _, _, v in rows], scale), parts))
            return pa.RecordBatch.from_arrays([pa.array([[i for i, _, _ in rows]], pa.list_(pa.int64())), pa.array([[s for _, s, _ in rows]], pa.list_(pa.string())), pa.array([trees], pa.binary())], names=["ids", "labels", "trees"])

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                del held[:BLOCK]
        if held:
            yield block(held)

    return run


def _sums(books: list[np.ndarray]):
    """Of a task's blocks: part, entry, pos, total; the count is at pos -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0, 0] for _ in books]
        for batch in batches:
            for data in batch.column(0):
                for p, (tree, x) in enumerate(unpacked(data.as_py())):
                    count, total = gathered(tree, x, books[p])
                    sums[p] = [sums[p][0] + count, sums[p][1] + total]
        rows = [(p, int(e), pos, str(int(v))) for p, (count, total) in enumerate(sums) if not isinstance(count, int) for e in np.flatnonzero(count) for pos, v in [(-1, count[e]), *enumerate(total[e])]]
        for k in range(0, len(rows), 1 << 16):
            part, entry, pos, total = zip(*rows[k : k + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(pos, pa.int32()), pa.array(total, pa.string())], names=["part", "entry", "pos", "total"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                codes, error = [], 0
                for p, (tree, x) in enumerate(unpacked(data.as_py())):
                    code = assigned(tree, x, books[p])
                    gap = x - books[p][code]
                    error = error + (gap * gap).sum(axis=1)
                    codes.append(code)
                text = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text, pa.string()), pa.array([min(int(e), LARGEST) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label (as text), vector (doubles) of the rows that take part, lengths aside."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("vector"))


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error of every row that takes part; the codebooks by part, entry and
    position). ``entries`` is 256 at most, so that an index is two hex digits."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = rows.sparkSession
    kept = usable(rows, id_col, vector_col, label_col)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), [[] for _ in range(parts)]
    kept = kept.where(F.size("vector") == len(first[0]["vector"]))
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()  # a codebook's size at most
    books = split(scaled([r["vector"] for r in start], scale), parts)
    blocks = staged(kept.mapInArrow(_blocks(parts, scale), BLOCKS), "trees")
    for _ in range(rounds):
        sums = blocks.select("trees").mapInArrow(_sums(books), "part int, entry int, pos int, total string")
        found = sums.groupBy("part", "entry", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a codebook's size
        at = {(r["part"], r["entry"], r["pos"]): int(r["total"]) for r in found}
        books = [exact(np.array([[at[p, e, k] // n if (n := at.get((p, e, -1))) else int(v) for k, v in enumerate(entry)] for e, entry in enumerate(book)], object), book.shape[1]) for p, book in enumerate(books)]
    coded = staged(blocks.mapInArrow(_codes(books), "vec_id long, label string, code string, error long"), "vector-codes")
    unstaged(blocks)
    return coded, [[[int(v) for v in e] for e in b] for b in books]


def books_digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def op13_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    per = coded.groupBy(F.col("label").alias("of")).agg(F.least(wide, F.lit(LARGEST)).cast("long").alias("label_error"))
    whole = coded.join(per, F.col("label").eqNullSafe(F.col("of")))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """Each round as tables of components: distances by component, the nearest entry by
    (distance, index), floors of means."""
    steps = [
        """kept AS (
  SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor(1024 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, v, len(v) // 4 AS w, unnest(range(1, len(v) + 1)) AS i FROM kept)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256
), book0 AS (
  SELECT part, entry, pos, x AS c FROM x JOIN first USING (vec_id)
)"""
    ]
    for r in range(5):
        steps.append(
            f"""near{r} AS (
  SELECT vec_id, part, min(d * 256 + entry) AS best
  FROM (SELECT vec_id, x.part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN book{r} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL)
  GROUP BY ALL
)"""
        )
        if r < 4:
            steps.append(
                f"""mean{r} AS (
  SELECT n.part, best % 256 AS entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS k
  FROM near{r} n JOIN x ON x.vec_id = n.vec_id AND x.part = n.part GROUP BY ALL
), book{r + 1} AS (
  SELECT b.part, b.entry, b.pos, CASE WHEN k IS NULL THEN c ELSE CAST((s - ((s % k) + k) % k) // k AS BIGINT) END AS c
  FROM book{r} b LEFT JOIN mean{r} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos
)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + """, coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(best % 256 AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM near4 GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book4
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN digest
"""
    )


OP13_SQL = _op13_sql()
