"""Price-curve shapes: resampled excess curves, their names, clusters and what marks a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.mining import measured, unpivoted
from spindrift.operators.series import BY_SERIES, GROUP, SERIES, dense_panel, last_month
from spindrift.sources.staging import written

POINTS, HORIZON, MIN_MONTHS = 24, 60, 36


def excess_panel(history: DataFrame, index: DataFrame) -> DataFrame:
    """The dense panel with e, the log price over the index level."""
    level = index.select(*GROUP, "month", "level")
    return dense_panel(history).join(F.broadcast(level), [*GROUP, "month"], "left").withColumn("e", F.col("logp") - F.coalesce("level", F.lit(0.0)))


def curve_matrix(history: DataFrame, index: DataFrame, points: int = POINTS, horizon: int = HORIZON, min_months: int = MIN_MONTHS) -> DataFrame:
    """console, condition, game_id, curve: excess over the last ``horizon`` months on an even grid
    of ``points``, interpolated between observations, level outside them, starting at 0."""
    asof = F.lit(last_month(history)).cast("date")
    inside = (F.col("month") >= F.add_months(asof, -horizon)) & (F.col("month") <= asof)
    sliced = written(excess_panel(history, index).where(inside).select(*SERIES, "month", "e"), "curve-panel")  # read for the spans and for the rows
    span = sliced.groupBy(*GROUP).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    seen = sliced.where(F.col("e").isNotNull()).join(F.broadcast(span), GROUP)  # a row per console and condition
    t = F.datediff("month", "lo") / F.datediff("hi", "lo")
    # each observation puts out the grid points from itself up to the next; the first also those
    # before it, the last those after it
    steps = points - 1
    w = Window.partitionBy(*BY_SERIES).orderBy("t")
    rows = seen.select(*SERIES, t.alias("t"), F.col("e").alias("y")).withColumns({"t2": F.lead("t").over(w), "y2": F.lead("y").over(w), "nth": F.row_number().over(w)})
    low = F.when(F.col("nth") == 1, F.lit(0)).otherwise(F.ceil(F.col("t") * steps))
    high = F.when(F.col("t2").isNull(), F.lit(steps)).otherwise(F.ceil(F.col("t2") * steps) - 1)
    grid = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    g = lambda i: i / F.lit(float(steps))
    between = lambda i: F.col("y") + (F.col("y2") - F.col("y")) * F.try_divide(g(i) - F.col("t"), F.col("t2") - F.col("t"))
    level = lambda i: F.col("t2").isNull() | (g(i) <= F.col("t"))
    drawn = F.transform(grid, lambda i: F.struct(i.alias("i"), F.when(level(i), F.col("y")).otherwise(between(i)).alias("y")))
    per = rows.select(*SERIES, drawn.alias("drawn")).groupBy(*BY_SERIES).agg(F.count("*").alias("n"), F.array_sort(F.flatten(F.collect_list("drawn"))).alias("raw")).where(F.col("n") >= min_months)
    return per.select(*SERIES, F.transform("raw", lambda p: p["y"] - F.element_at("raw", 1)["y"]).alias("curve"))


def shape_of(curve):
    """The name of a curve, as an expression on an array column."""
    c = curve
    n = F.size(c)
    first, last = F.element_at(c, 1), F.element_at(c, -1)
    total, peak = last - first, F.array_max(c)
    top = F.array_position(c, peak) - 1
    late = F.element_at(c, F.floor(n * 2 / 3).cast("int") + 1)
    spike = (top >= 0.15 * n) & (top <= 0.85 * n) & (last < peak - 0.5 * (peak - first)) & (peak - first > 0.2)
    flat = (F.abs(total) < 0.1) & (peak - F.array_min(c) < 0.2)
    surge = (total > 0) & (F.try_divide(last - late, total) > 0.6)
    return F.when(flat, "flat").when(spike, "spike & fade").when(total <= -0.1, "decliner").when(surge, "late surge").otherwise("steady climber")


STRENGTHS = ("strong", "moderate", "mild")


def named_shapes(centers: DataFrame) -> DataFrame:
    """``centers``: cluster, centroid. Adds shape: of equal shapes the strongest ends come first,
    told apart by strength, from the fourth on by rank."""
    rows = centers.withColumn("base", shape_of(F.col("centroid")))
    same = Window.partitionBy("base")
    rank = F.row_number().over(same.orderBy(F.desc(F.abs(F.element_at("centroid", -1))), "cluster"))
    many = F.count("*").over(same)
    strength = F.when(rank <= 3, F.concat(F.element_at(F.array(*map(F.lit, STRENGTHS)), F.least(rank, F.lit(3))), F.lit(" "), "base")).otherwise(F.concat("base", F.lit(" #"), rank.cast("string")))
    return rows.withColumn("shape", F.when(many > 1, strength).otherwise(F.col("base"))).drop("base")


def _distance(curve, center: list[float]):
    """Squared, summed up in order of points."""
    gaps = F.transform(curve, lambda y, i: (y - F.get(F.array(*map(F.lit, center)), i)) * (y - F.get(F.array(*map(F.lit, center)), i)))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def _nearest(curve, centers: list[list[float]]):
    """The index of the nearest center, of equally near ones the first."""
    return F.array_min(F.array(*[F.struct(F.round(_distance(curve, c), 9).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers)]))


def farthest_points(curves: DataFrame, k: int) -> list[list[float]]:
    """``k`` curves, the first by series, then each the one farthest from all before it, ties by series."""
    found = [list(curves.groupBy().agg(F.min_by("curve", F.struct(*SERIES))).first()[0])]
    while len(found) < k:
        far = _nearest(F.col("curve"), found)["d"]
        found.append(list(curves.groupBy().agg(F.min_by("curve", F.struct((-far).alias("d"), *SERIES))).first()[0]))
    return found


def lloyd_round(curves: DataFrame, centers: list[list[float]]) -> list[list[float]]:
    """Means of what each center is nearest to, to nine places; one that has nothing stays."""
    points = len(centers[0])
    near = curves.select(_nearest(F.col("curve"), centers)["k"].alias("k"), "curve")
    mean = F.array(*[F.round(F.avg(F.get("curve", i)), 9) for i in range(points)])
    moved = {r["k"]: list(r["m"]) for r in near.groupBy("k").agg(mean.alias("m")).collect()}  # a row a center
    return [moved.get(i, c) for i, c in enumerate(centers)]


def cluster_curves(curves: DataFrame, k: int = 5, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(assignment: series, cluster, shape; summary: cluster, shape, n, share, end_value, centroid)
    by k-means from farthest points, at most ``rounds`` rounds, fewer if nothing moves. Nothing is drawn by chance: equal
    inputs give equal clusters, in any partitioning. Fewer than k curves give empty frames."""
    spark = curves.sparkSession
    data = written(curves, "curves")
    n = data.count()
    if n < k:
        none = spark.createDataFrame([], "cluster int, shape string, n long, share double, end_value double, centroid array<double>")
        return curves.select(*SERIES, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("string").alias("shape")).limit(0), none
    centers = farthest_points(data, k)
    for _ in range(rounds):
        before, centers = centers, lloyd_round(data, centers)
        if centers == before:
            break
    named = named_shapes(spark.createDataFrame([(i, c) for i, c in enumerate(centers)], "cluster int, centroid array<double>"))
    assigned = data.select(*SERIES, _nearest(F.col("curve"), centers)["k"].alias("cluster"))
    assigned = assigned.join(F.broadcast(named.select("cluster", "shape")), "cluster").select(*SERIES, "cluster", "shape")  # k rows
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    summary = named.join(sizes, "cluster").select("cluster", "shape", "n", (F.col("n") / n).alias("share"), F.element_at("centroid", -1).alias("end_value"), F.transform("centroid", lambda x: F.bround(x, 4)).alias("centroid"))
    return assigned, summary


def profile_clusters(assigned: DataFrame, factors: DataFrame, columns: list[str], min_support: int = 20, top: int = 5) -> DataFrame:
    """Per cluster the factors whose share of it is surely above the average, the five strongest:
    k of a factor value's n series lie in the cluster, and the cluster's share of all is the base."""
    rows = assigned.select(*SERIES, "cluster").join(factors.drop("rising", "console"), ["game_id", "condition"])
    counted = unpivoted(rows, ["cluster"], columns).where(F.col("value").isNotNull()).groupBy("factor", "value", "cluster").agg(F.count("*").cast("double").alias("k"))
    kept = counted.where(~(F.col("factor").startswith("kw_") & (F.col("value") == "no"))).withColumn("n", F.sum("k").over(Window.partitionBy("factor", "value")).cast("long")).where(F.col("n") >= min_support)
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("m"))
    base = sizes.select("cluster", (F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1)))).alias("base"))  # k rows
    lifts = measured(kept.join(F.broadcast(base), "cluster")).where("lift_lo > 1")  # k rows
    nth = Window.partitionBy("cluster").orderBy(F.desc("lift"), "factor", "value")
    return lifts.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= top).select("cluster", "nth", "factor", "value", "n", "k", "rate", "lift", "lift_lo", "lift_hi")
