"""Exact order statistics, ranks, row numbers and samples of tables that no task holds whole.

``quantiles`` narrows histograms: counts of equal bins, then of the bin that holds the wanted rank,
and so on until few values are left. ``numbered`` and ``average_ranks`` deal rows by ranges of
their order, count each range, and add to a row's place in its range what the ranges before it
hold. ``first_by_hash`` finds from counts of hash prefixes which prefix the last wanted row has, and
ranks the rows of that prefix alone. Groups (``by``) are few: the driver, and a broadcast, hold a
row for each group and rank; no window is wider than a range or a prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.staging import unwritten, written

#: Bins of a round, and values of a bin that are sorted at once.
BINS, FEW = 2_048, 10_000
PREFIX = 4  # hex digits


def _same(a: list, b: list):
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def order_statistics(df: DataFrame, by: list[str], column: str, places, least: int = 0) -> dict[tuple, tuple[int, dict[int, float]]]:
    """group -> (n, {place: value}): of the ascending values of each group those at the places (from 0)
    that ``places`` gives for n. Nulls don't count; groups of fewer than ``least`` values are left out.

    Places that lie in one interval share its bins, so a row meets no more intervals than it lies in."""
    spark = df.sparkSession
    x = df.select(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by)], F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    keys = [f"by{i}" for i in range(len(by))]
    schema = "".join(f"{k} {dict(x.dtypes)[k]}, " for k in keys)
    spans = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where(F.col("n") >= least).collect()
    found: dict[tuple, tuple[int, dict[int, float]]] = {}
    open_: dict[tuple, list[tuple[int, int]]] = {}  # (group, lo, hi, values in it) -> [(place, place in it)]
    for r in spans:
        g = tuple(r[k] for k in keys)
        found[g] = (r["n"], {})
        open_[g, r["lo"], r["hi"], r["n"]] = [(p, p) for p in sorted(set(places(r["n"])))]
    while True:
        for g, lo, hi, n in [t for t in open_ if t[1] == t[2]]:
            found[g][1].update(dict.fromkeys((p for p, _ in open_.pop((g, lo, hi, n))), lo))
        if not open_:
            return found
        intervals = list(open_.items())
        held = spark.createDataFrame([(k, *g, lo, hi, n <= FEW) for k, ((g, lo, hi, n), _) in enumerate(intervals)], f"part long, {schema}lo double, hi double, few boolean").withColumnsRenamed({k: f"of_{k}" for k in keys})
        sought = spark.createDataFrame([(k, p, within) for k, (_, some) in enumerate(intervals) for p, within in some], "part long, place long, within long")
        inside = x.join(F.broadcast(held), _same([F.col(k) for k in keys], [F.col(f"of_{k}") for k in keys]) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))  # a row an interval
        open_ = {}
        if any(t[0][3] > FEW for t in intervals):
            step = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
            bins = inside.where("not few").groupBy("part", step.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            upto = F.sum("n").over(Window.partitionBy("part").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows
            holds = bins.withColumn("upto", upto).join(F.broadcast(sought), "part").where((F.col("upto") > F.col("within")) & (F.col("upto") - F.col("n") <= F.col("within")))  # a row a place
            for r in holds.collect():
                open_.setdefault((intervals[r["part"]][0][0], r["lo"], r["hi"], r["n"]), []).append((r["place"], r["within"] - r["upto"] + r["n"]))
        if any(t[0][3] <= FEW for t in intervals):
            small = inside.where("few").groupBy("part").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # FEW values
            for r in small.join(F.broadcast(sought), "part").select("part", "place", F.get("xs", F.col("within").cast("int")).alias("x")).collect():
                found[intervals[r["part"]][0][0]][1][r["place"]] = r["x"]


def quantiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float], least: int = 0) -> DataFrame:
    """A row for each group with a value: ``by``, n, and for each name its exact quantile, between
    two values in proportion. The result has a row a group and is at hand (no job is left to run)."""

    def places(n: int) -> set[int]:
        return {p for s in shares.values() for p in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))}

    def value(n: int, known: dict[int, float], share: float) -> float:
        at = share * (n - 1)
        low = int(at)
        a, b = known[low], known[min(low + 1, n - 1)]
        return a if at == low or a == b else (low + 1 - at) * a + (at - low) * b

    found = order_statistics(df, by, column, places, least)
    kinds = {c: df.schema[c].dataType.simpleString() for c in by}
    schema = "".join(f"by{i} {kinds[c]}, " for i, c in enumerate(by)) + "n long" + "".join(f", q{i} double" for i in range(len(shares)))
    out = df.sparkSession.createDataFrame([(*g, n, *(value(n, known, s) for s in shares.values())) for g, (n, known) in found.items()], schema)
    return out.select(*[F.col(f"by{i}").alias(c) for i, c in enumerate(by)], "n", *[F.col(f"q{i}").alias(name) for i, name in enumerate(shares)])


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` as a written table in ranges of ``order``, with range_."""
    names = [f"order{i}_" for i in range(len(order))]
    told = df.withColumns(dict(zip(names, order, strict=True)))
    return written(told.repartitionByRange(*names).withColumn("range_", F.spark_partition_id()).drop(*names), "ranges")


def _before(ranged: DataFrame, by: list[str], weight) -> DataFrame:
    """by, range_, before_: the sum of ``weight`` over the earlier ranges of a group. Has a row for each range and group."""
    per = ranged.groupBy(*by, "range_").agg(F.sum(weight).alias("sum_"))
    earlier = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    return per.select(*by, "range_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("before_"))


def _joined(ranged: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    names = {c: f"of_{c}" for c in [*by, "range_"]}
    told = F.broadcast(before.withColumnsRenamed(names))  # a row for each range and group
    return ranged.join(told, _same([F.col(c) for c in names], [F.col(n) for n in names.values()])).drop(*names.values())


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds ``out``, the row's number from 0 in ``order`` (columns whose values tell all rows apart)."""
    ranged = _ranged(df, order)
    own = Window.partitionBy("range_").orderBy(*order)
    rows = _joined(ranged, _before(ranged, [], F.lit(1)), [])
    return rows.withColumn(out, F.col("before_") + F.row_number().over(own) - 1).drop("before_", "range_")


def average_ranks(values: DataFrame, by: list[str], column: str, times: str, out: str) -> DataFrame:
    """``values``: a row for each group and distinct value, seen ``times`` times. Adds ``out``, the
    value's rank from 1, the average of those of its copies."""
    ranged = _ranged(values, [*[F.col(c) for c in by], F.col(column)])
    own = Window.partitionBy("range_", *by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    rows = _joined(ranged, _before(ranged, by, F.col(times)), by)
    below = F.col("before_") + F.coalesce(F.sum(times).over(own), F.lit(0))
    return rows.withColumn(out, below + (F.col(times) + 1) / 2).drop("before_", "range_")


def first_by_hash(pool: DataFrame, by: str, digest: str, order: list[str], want: DataFrame) -> DataFrame:
    """Of each group the ``want`` (by, want) first rows by ``digest`` (hex text), ties by ``order``;
    groups that ``want`` lacks give none. ``pool`` is read twice."""
    told = pool.withColumn("prefix_", F.substring(digest, 1, PREFIX))
    counts = told.groupBy(by, "prefix_").agg(F.count("*").alias("many_"))
    earlier = Window.partitionBy(by).orderBy("prefix_").rowsBetween(Window.unboundedPreceding, -1)  # 16**PREFIX rows
    left = F.col("want") - F.coalesce(F.sum("many_").over(earlier), F.lit(0))
    open_ = counts.join(F.broadcast(want), by).withColumn("left_", left).where("left_ > 0").select(F.col(by).alias("of_"), F.col("prefix_").alias("at_"), "many_", "left_")
    rows = told.join(open_, (F.col(by) == F.col("of_")) & (F.col("prefix_") == F.col("at_")))
    own = Window.partitionBy(by, "prefix_").orderBy(digest, *order)
    whole = rows.where("many_ <= left_").select(pool.columns)
    part = rows.where("many_ > left_").withColumn("nth_", F.row_number().over(own)).where("nth_ <= left_").select(pool.columns)
    return whole.unionByName(part)
