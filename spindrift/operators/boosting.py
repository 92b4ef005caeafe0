"""Boosted regression trees in DataFrame steps, on exact integers.

Targets are rounded to millionths, predictions and leaves are whole millionths, so every sum is
exact and a fit doesn't depend on partitions, retries or the engine that replays it.

A row carries a code for each feature: of a category the value itself, of a number how many of the
feature's cut points lie below it (the values at even places of the training rows), null being a
code of its own below all others. For each level of a tree one aggregation counts and sums the
residuals of all its nodes by feature and code, summed up before the shuffle; the best split of
each node is found from these few rows, and only that is collected. A node splits where the
squared error falls most, both sides keep ``least`` rows, and of equal splits the first feature's
lowest code wins. Numbers split at a code (up to it: left), categories by one value (it: left).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators.ranks import order_statistics
from spindrift.sources.staging import unwritten, written

UNIT = 1_000_000
BINS, DEPTH, LEAST = 64, 4, 40
#: Trees whose values are added to the rows before these are written anew.
STEP = 10


@dataclass
class Boosted:
    categorical: list[str]
    numeric: list[str]
    cuts: dict[str, list[float]]
    base: int = 0
    #: (splits: node -> (feature, code), leaves: node -> value); node 1 is the root, 2n and 2n + 1 below n.
    trees: list[tuple[dict[int, tuple[int, str]], dict[int, int]]] = field(default_factory=list)

    def codes(self) -> Column:
        """The codes of a row, categories first."""
        text = [F.concat(F.when(F.col(c).isNull(), "").otherwise("="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in self.categorical]
        return F.array(*text, *[self._number_code(c) for c in self.numeric])

    def _number_code(self, c: str) -> Column:
        x = F.col(c).cast("double")
        if not self.cuts[c]:
            return F.when(x.isNull(), "000").otherwise("001")
        below = F.size(F.filter(F.array(*map(F.lit, self.cuts[c])), lambda cut: cut < x))
        return F.when(x.isNull(), "000").otherwise(F.lpad((below + 1).cast("string"), 3, "0"))

    def place(self, splits: dict[int, tuple[int, str]], node: int = 1) -> Column:
        """The node a row (column codes) comes to."""
        if node not in splits:
            return F.lit(node)
        f, code = splits[node]
        own = F.get("codes", f)
        left = own == code if f < len(self.categorical) else own <= code
        return F.when(left, self.place(splits, 2 * node)).otherwise(self.place(splits, 2 * node + 1))

    def value(self, tree) -> Column:
        splits, leaves = tree
        at = F.create_map(*[F.lit(x) for node, v in leaves.items() for x in (node, v)])
        return F.element_at(at, self.place(splits)).cast("long")


def rounded_half(x: float) -> int:
    """The nearest whole number, halves away from zero."""
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def cut_points(rows: DataFrame, numeric: list[str], bins: int) -> dict[str, list[float]]:
    """Of each feature the distinct values at the places j * (n - 1) div bins, without the last value."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in numeric])).alias("p")).select("p.*")
    found = order_statistics(long, ["feature"], "x", lambda n: {j * (n - 1) // bins for j in range(1, bins + 1)})
    out = {}
    for c in numeric:
        n, known = found.get((c,), (0, {}))
        out[c] = sorted({v for place, v in known.items() if v < known[n - 1]}) if n else []
    return out


def best_splits(rows: DataFrame, categories: int, least: int) -> dict[int, tuple]:
    """node -> (feature, code, rows and sum on the left, rows and sum of all); rows: node, g, codes."""
    each = rows.select("node", "g", F.posexplode("codes").alias("f", "code")).groupBy("node", "f", "code").agg(F.count("*").alias("n"), F.sum("g").alias("s"))
    upto = Window.partitionBy("node", "f").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)  # the codes of a feature
    own = Window.partitionBy("node", "f")
    by_value = F.col("f") < categories
    told = each.withColumns(
        {
            "nl": F.when(by_value, F.col("n")).otherwise(F.sum("n").over(upto)),
            "sl": F.when(by_value, F.col("s")).otherwise(F.sum("s").over(upto)),
            "na": F.sum("n").over(own),
            "sa": F.sum("s").over(own),
        }
    ).where((F.col("nl") >= least) & (F.col("na") - F.col("nl") >= least))
    square = lambda s, n: s.cast("double") * s.cast("double") / n.cast("double")
    gain = square(F.col("sl"), F.col("nl")) + square(F.col("sa") - F.col("sl"), F.col("na") - F.col("nl")) - square(F.col("sa"), F.col("na"))
    order = F.struct((-F.col("gain")).alias("o"), "f", "code")
    best = told.withColumn("gain", gain).where("gain > 0").groupBy("node").agg(F.min_by(F.struct("f", "code", "nl", "sl", "na", "sa"), order).alias("b"))
    return {r["node"]: tuple(r["b"]) for r in best.collect()}  # the nodes of a level


def fit(rows: DataFrame, target: str, categorical: list[str], numeric: list[str], rounds: int, rate: float, depth: int = DEPTH, least: int = LEAST, bins: int = BINS) -> Boosted:
    """``rows`` with a target; at most 998 bins."""
    model = Boosted(list(categorical), list(numeric), cut_points(rows, list(numeric), bins) if numeric else {})
    t = F.round(F.col(target) * UNIT).cast("long")
    held = written(rows.where(F.col(target).isNotNull()).select(t.alias("t"), model.codes().alias("codes"), F.lit(0).cast("long").alias("f")), "boosting")
    n, total = held.agg(F.count("*"), F.sum("t")).first()
    model.base = rounded_half(total / n) if n else 0
    start = model.base
    now = held.withColumn("f", F.lit(start).cast("long"))
    for k in range(rounds):
        residual = now.select("codes", (F.col("t") - F.col("f")).alias("g"))
        splits: dict[int, tuple[int, str]] = {}
        sums: dict[int, tuple[int, int]] = {}
        level = [1]
        for _ in range(depth):
            at = residual.select("codes", "g", model.place(splits).alias("node")).where(F.col("node").isin(level))
            found = best_splits(at, len(categorical), least)
            level = []
            for node, (f, code, nl, sl, na, sa) in sorted(found.items()):
                splits[node] = (f, code)
                sums |= {2 * node: (nl, sl), 2 * node + 1: (na - nl, sa - sl)}
                level += [2 * node, 2 * node + 1]
            if not level:
                break
        if not splits:
            break  # nothing lowers the error
        tree = (splits, {node: rounded_half(rate * (s / m)) for node, (m, s) in sums.items() if node not in splits})
        model.trees.append(tree)
        now = now.withColumn("f", F.col("f") + model.value(tree))
        if (k + 1) % STEP == 0 and k + 1 < rounds:
            again = written(now, "boosting")
            unwritten(held)
            held = now = again
    unwritten(held)
    return model


def _predicting(model: Boosted, columns: int):
    """Adds the prediction to rows whose last column is codes."""
    first_number = len(model.categorical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(columns)
            width = len(model.categorical) + len(model.numeric)
            flat = np.asarray(codes.flatten().to_numpy(zero_copy_only=False), object).reshape(len(batch), width)
            by = [flat[:, f] if f < first_number else flat[:, f].astype(int) for f in range(width)]
            out = np.full(len(batch), model.base, np.int64)
            for splits, leaves in model.trees:
                node = np.ones(len(batch), np.int64)
                for n in sorted(splits):
                    f, code = splits[n]
                    here = np.flatnonzero(node == n)
                    own = by[f][here]
                    left = own == code if f < first_number else own <= int(code)
                    node[here] = np.where(left.astype(bool), 2 * n, 2 * n + 1)
                most = max(leaves)
                table = np.zeros(most + 1, np.int64)
                table[list(leaves)] = list(leaves.values())
                out += table[node]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(out / UNIT)], names=[*batch.schema.names[:columns], "prediction"])

    return run


def predict(model: Boosted, rows: DataFrame) -> DataFrame:
    """Adds ``prediction``; a category that training hasn't seen is none of those split off."""
    n = len(rows.columns)
    schema = T.StructType([*rows.schema, T.StructField("prediction", T.DoubleType())])
    return rows.withColumn("codes", model.codes()).mapInArrow(_predicting(model, n), schema)
