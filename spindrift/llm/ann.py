"""Nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Training (bounded): at most ``TRAIN_ROWS`` vectors, those of smallest md5 of the id, fit the
coarse centroids (k-means) and, on their residuals, one codebook of 256 entries per sub-vector.
The number of lists grows with the square root of the rows. Rows are placed and queries dealt in
blocks of bounded memory.

Index: every vector goes to its nearest centroid's list and is coded there. One pass over all rows
counts each list and finds its radius (the longest residual) and its longest vector. Small lists
share a cell, large ones are dealt into cells of about ``PART_ROWS`` rows by a hash of the id: a
list that a hot vector fills has many cells, each as large as any other.

Search: the k-th best of the training rows is a floor under a query's k-th best of all. A query
visits each list whose bound (centroid product and radius, or the longest vector) reaches its
floor; in a cell, asymmetric distance tables score the codes, and rows whose score and coding error
together reach the floor are rescored from the original vectors in double precision. The cell's best
k go on to one window over all cells of the query. So nothing near is missed, whatever the rows
are like: clustered vectors shut out most lists and rows, vectors without structure few.

Vectors that are null, all zero, or hold null or non-finite components take no part, nor do those
of another length than the commonest (of several such lengths, the smallest). Repeated
rows are separate candidates (a query's own id is none), but ask once; a query id with several
vectors gets the nearest found for any of them. A table with fewer candidates than k
returns all of them: there is no floor then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import table

K = 20
TRAIN_ROWS, ROUNDS = 16_384, 12
BOOK_ROWS, BOOK_ROUNDS = 8_192, 8
SUBVECTORS, CODES = 16, 256
PART_ROWS = 2048
#: What products and lengths may be off by, as a share of the longest product: rounding shuts nothing out.
SLACK = 1e-9
#: Distances computed at once, and rows put out at once: bounds of memory.
DISTANCES, OUT_ROWS = 1 << 21, 1 << 14
#: Queries scored together: bounds the distance tables in memory.
BLOCK = 256


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from distinct seeded rows; an empty cluster takes the farthest row."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centers = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        d = _distances(x, centers)
        own = d.argmin(1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        if not full.all():
            far = d.min(1).argsort()[::-1][: int((~full).sum())]
            centers[~full] = x[far]
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)


def nearest_centre(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    step = max(1, DISTANCES // len(centers))
    return np.concatenate([_distances(x[i : i + step], centers).argmin(1) for i in range(0, len(x), step)])


class Quantiser:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int):
        dim = sample.shape[1]
        self.centers = kmeans(sample, lists)
        m = max(d for d in range(1, SUBVECTORS + 1) if dim % d == 0)
        self.split = (m, dim // m)
        sample = sample[:BOOK_ROWS]
        residuals = sample - self.centers[nearest_centre(sample, self.centers)]
        self.books = [kmeans(residuals[:, i * self.split[1] : (i + 1) * self.split[1]], CODES, BOOK_ROUNDS, 11 + i) for i in range(m)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of what the codes leave of the residual) of each row."""
        own = nearest_centre(x, self.centers)
        residuals, width = x - self.centers[own], self.split[1]
        codes = np.stack([_distances(residuals[:, i * width : (i + 1) * width], b).argmin(1) for i, b in enumerate(self.books)], 1)
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return own, codes.astype(np.uint8), _lengths(residuals - decoded)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, sub-vector, code) inner products."""
        width = self.split[1]
        out = np.full((len(q), len(self.books), CODES), -np.inf)
        for i, b in enumerate(self.books):
            out[:, i, : len(b)] = q[:, i * width : (i + 1) * width] @ b.T
        return out


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


@dataclass
class Lists:
    """Of each list: its rows, radius and longest vector, its first cell and its number of cells."""

    radius: np.ndarray
    longest: np.ndarray
    first: np.ndarray
    cells: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray, radius: np.ndarray, longest: np.ndarray, part_rows: int = PART_ROWS) -> Lists:
        first, cells = np.zeros(len(n), np.int64), np.maximum(1, -(-n // part_rows))
        at, held = -1, part_rows + 1  # the cell that small lists fill
        last = -1
        for i, rows in enumerate(n.tolist()):
            if cells[i] > 1:
                first[i], last = last + 1, last + int(cells[i])
                continue
            if held + rows > part_rows:
                at, last, held = last + 1, last + 1, 0
            first[i], held = at, held + rows
        return cls(np.where(n > 0, radius, -np.inf), np.where(n > 0, longest, -np.inf), first, cells)

    def visited(self, model: Quantiser, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) pairs, each once: cells of lists that may hold a row at a query's floor or above."""
        long = _lengths(q)[:, None]
        filled = self.longest > -np.inf
        most = np.where(filled, self.longest, 0.0)
        bound = np.minimum(q @ model.centers.T + long * np.where(filled, self.radius, 0.0), long * most)
        at, lists = np.nonzero((bound + SLACK * long * (most + _lengths(model.centers)) >= floor[:, None]) & filled)
        n = self.cells[lists]
        each = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        pairs = np.unique(np.stack([np.repeat(at, n), np.repeat(self.first[lists], n) + each], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def floors(q: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k-th largest product with rows of the sample of other ids, less what rounding may be off by; -inf if there are fewer."""
    if len(sample) < k:
        return np.full(len(q), -np.inf)
    out, longest = [], _lengths(sample).max()
    step = max(1, DISTANCES // len(sample))
    for i in range(0, len(q), step):
        score = q[i : i + step] @ sample.T
        score[ids[i : i + step, None] == sample_ids[None, :]] = -np.inf
        out.append(np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k])
    return np.concatenate(out) - SLACK * _lengths(q) * longest


def usable(vectors: DataFrame, is_query, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _place(model: Quantiser, lists: Lists, sample: np.ndarray, sample_ids: np.ndarray, k: int):
    """Rows of the index (kind 0) and, for queries, a row for each cell visited (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, x, is_query, salt = np.asarray(batch.column(0)), _matrix(batch.column(1)), np.asarray(batch.column(2)), np.asarray(batch.column(3))
            own, codes, error = model.assign(x)
            yield _placed(lists.first[own] + salt % lists.cells[own], np.zeros(len(ids), np.int8), ids, x, error, own, codes)
            at = np.flatnonzero(is_query)
            for i in range(0, len(at), BLOCK):
                some = at[i : i + BLOCK]
                floor = floors(x[some], ids[some], sample, sample_ids, k)
                who, cells = lists.visited(model, x[some], floor)
                for j in range(0, len(who), OUT_ROWS):
                    w, c = who[j : j + OUT_ROWS], cells[j : j + OUT_ROWS]
                    yield _placed(c, np.ones(len(w), np.int8), ids[some[w]], x[some[w]], floor[w], None, None)

    return run


#: edge: a row's coding error, a query's floor.
PLACED = "cell long, kind tinyint, vec_id long, v binary, edge double, list int, codes binary"


def _placed(cells, kind, ids, x, edge, lists, codes) -> pa.RecordBatch:
    width = x.shape[1] * 8
    raw = np.ascontiguousarray(x, dtype="<f8").tobytes()
    vectors = [raw[i * width : (i + 1) * width] for i in range(len(x))]
    coded = [None] * len(x) if codes is None else [c.tobytes() for c in codes]
    of = pa.nulls(len(x), pa.int32()) if lists is None else pa.array(lists, pa.int32())
    cols = [pa.array(cells, pa.int64()), pa.array(kind, pa.int8()), pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(edge, pa.float64()), of, pa.array(coded, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["cell", "kind", "vec_id", "v", "edge", "list", "codes"])


def _search(model: Quantiser, k: int):
    """One cell at a time."""

    def run(t: pa.Table) -> pa.Table:
        kind = np.asarray(t.column("kind"))
        ids, raw, edge = np.asarray(t.column("vec_id")), t.column("v").to_pylist(), np.asarray(t.column("edge"))
        rows, asking = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(rows) and len(asking):
            rows = rows[np.argsort(ids[rows], kind="stable")]
            asking = np.array(sorted({(ids[i], raw[i]): i for i in asking.tolist()}.values(), key=lambda i: (ids[i], raw[i])))
            own, error = ids[rows], edge[rows]
            x = np.frombuffer(b"".join(raw[i] for i in rows), "<f8").reshape(len(rows), -1)
            lists, held = t.column("list").to_pylist(), t.column("codes").to_pylist()
            of = np.array([lists[i] for i in rows])
            codes = np.frombuffer(b"".join(held[i] for i in rows), np.uint8).reshape(len(rows), -1)
            longest = _lengths(x).max() + _lengths(model.centers).max()
            for b in range(0, len(asking), BLOCK):
                some = asking[b : b + BLOCK]
                q = np.frombuffer(b"".join(raw[i] for i in some), "<f8").reshape(len(some), -1)
                long, floor = _lengths(q)[:, None], edge[some][:, None]
                slack = SLACK * long * longest
                look = model.tables(q)
                most = (q @ model.centers.T)[:, of]
                for m in range(codes.shape[1]):
                    most += look[:, m, :][:, codes[:, m]]
                most += long * error[None, :] + slack
                may = (most >= floor) & (own[None, :] != ids[some][:, None])  # a query is no candidate of its own
                out += [(ids[some[at]], own[row], score) for at, row, score in _rescored(q, x, may, floor, slack, k)]
        found = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"query_id": found[0].astype(np.int64), "vec_id": found[1].astype(np.int64), "score": found[2]})

    return run


def _rescored(q: np.ndarray, x: np.ndarray, may: np.ndarray, floor: np.ndarray, slack: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, rows, scores) of each query's best k of the rows it ``may`` have, in the order of rows where scores tie.
    A product of matrices, whose sums may differ in their last bits, only shuts out what lies below the floor or the k-th by more than that."""
    about = np.where(may, q @ x.T, -np.inf)
    if about.shape[1] > k:
        kth = np.partition(about, about.shape[1] - k, axis=1)[:, about.shape[1] - k][:, None]
        floor = np.maximum(floor, kth - 2 * slack)
    at, row = np.nonzero(may & (about >= floor - slack))
    step = max(1, DISTANCES // x.shape[1])
    score = np.concatenate([np.zeros(0), *[(x[row[i : i + step]] * q[at[i : i + step]]).sum(1) for i in range(0, len(at), step)]])
    order = np.lexsort((row, -score, at))
    at, row, score = at[order], row[order], score[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    yield at[nth < k], row[nth < k], score[nth < k]


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k nearest."""
    spark = vectors.sparkSession
    rows = usable(vectors, is_query, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows, n = rows.where(F.size("v") == lengths["length"]), lengths["count"]
    order = F.md5(F.concat_ws(":", F.lit("ann"), F.col("vec_id").cast("string")))
    sample = rows.orderBy(order, "vec_id").select("vec_id", "v").limit(TRAIN_ROWS).toArrow()  # bounded
    seen, seen_ids = _matrix(sample.column("v")), np.asarray(sample.column("vec_id"))
    model = Quantiser(seen, max(1, int(n**0.5 / 2)))
    salted = rows.select("vec_id", "v", "q", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(1 << 30)).alias("salt"))
    # rows, radius and longest vector of each list
    counted = rows.select("vec_id", "v").mapInArrow(_lists(model), "list int, n long, radius double, longest double").groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("longest").alias("longest")).collect()
    of = np.zeros((3, len(model.centers)))
    for r in counted:
        of[:, r["list"]] = r["n"], r["radius"], r["longest"]
    lists = Lists.of(of[0].astype(np.int64), of[1], of[2])
    placed = salted.mapInArrow(_place(model, lists, seen, seen_ids, k), PLACED)
    found = placed.groupBy("cell").applyInArrow(_search(model, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _lists(model: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                own = nearest_centre(x, model.centers)
                lists, at, n = np.unique(own, return_inverse=True, return_counts=True)
                most = [np.zeros(len(lists)), np.zeros(len(lists))]
                np.maximum.at(most[0], at, _lengths(x - model.centers[own]))
                np.maximum.at(most[1], at, _lengths(x))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(n, pa.int64()), *map(pa.array, most)], names=["list", "n", "radius", "longest"])

    return run


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
