"""What the months before a breakout look like: features, breakouts and controls, their contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import unit_normal_two_sided
from spindrift.operators.curves import excess_panel
from spindrift.operators.ranks import average_ranks, first_by_hash, quantiles
from spindrift.operators.series import BY_SERIES, SERIES
from spindrift.sources.staging import written

SIGNALS = ["trend_12m", "acceleration", "volatility_12m", "drawdown_24m", "cib_loose_change_12m"]
LEAST_EACH = 10


def cib_loose_change(history: DataFrame) -> DataFrame:
    """console, game_id, month, cib_loose_change_12m: the twelve-month change of ln(cib / loose)."""
    # the largest price of a month, as in dense_panel; a month without a price has no ratio
    of = lambda c: F.max(F.when(F.col("condition") == c, F.log("price_cents")))
    both = history.where(F.col("condition").isin("loose", "cib")).groupBy("game_id", "console", "month").agg((of("cib") - of("loose")).alias("gap")).where(F.col("gap").isNotNull())
    before = both.select("console", "game_id", F.add_months("month", 12).alias("month"), F.col("gap").alias("old"))
    return both.join(before, ["console", "game_id", "month"]).select("console", "game_id", "month", (F.col("gap") - F.col("old")).alias("cib_loose_change_12m"))


def pre_features(history: DataFrame, index: DataFrame, horizon: int = 6) -> DataFrame:
    """Per series and month: what was known by then, and fwd, the next ``horizon`` months."""
    w = Window.partitionBy(*BY_SERIES).orderBy("month")
    year, two = w.rowsBetween(-11, 0), w.rowsBetween(-23, 0)
    e = F.col("e")
    rows = excess_panel(history, index).select(*SERIES, "month", "e").withColumn("d", e - F.lag("e").over(w))
    trend = e - F.lag("e", 12).over(w)
    rows = rows.withColumns(
        {
            "trend_12m": trend,
            "acceleration": (e - F.lag("e", 3).over(w)) * 4 - trend,
            "volatility_12m": F.when(F.count("d").over(year) >= 8, F.stddev_samp("d").over(year)),
            "drawdown_24m": F.when(F.count("e").over(two) >= 12, e - F.max("e").over(two)),
            "fwd": F.lead("e", horizon).over(w) - e,
        }
    ).drop("d", "e")
    some = F.coalesce("trend_12m", "acceleration", "volatility_12m", "drawdown_24m", "fwd").isNotNull()
    return rows.where(some).join(cib_loose_change(history), ["console", "game_id", "month"], "left")


def thinned(months, gap: int = 12):
    """Of sorted months the first, then each that lies ``gap`` months after the last one kept."""
    keep = lambda acc, m: (F.size(acc) == 0) | (m >= F.add_months(F.element_at(acc, -1), gap))
    return F.aggregate(months, F.array().cast("array<date>"), lambda acc, m: F.when(keep(acc, m), F.array_append(acc, m)).otherwise(acc))


def breakouts(features: DataFrame, top: float = 0.05, gap: int = 12, controls_per: int = 3) -> DataFrame:
    """series, month, breakout (1 or 0): thinned months of the top forward returns, and ordinary
    months away from any breakout of their series, three for each, in md5 order."""
    known = features.where(F.col("fwd").isNotNull())
    bars = quantiles(known, ["condition"], "fwd", {"bar": 1.0 - top, "mid": 0.5})
    rows = known.join(F.broadcast(bars), "condition")  # a row per condition
    hot = rows.where(F.col("fwd") >= F.col("bar")).groupBy(*BY_SERIES).agg(F.sort_array(F.collect_list("month")).alias("months"))
    breaks = written(hot.select(*SERIES, F.explode(thinned(F.col("months"), gap)).alias("month")), "breaks")
    away = breaks.select(*SERIES, F.col("month").alias("broke"))
    near = F.abs(F.datediff(F.col("r.month"), F.col("b.broke"))) <= gap * 31
    same = (F.col("r.console") == F.col("b.console")) & (F.col("r.condition") == F.col("b.condition")) & (F.col("r.game_id") == F.col("b.game_id"))
    digest = F.md5(F.concat_ws("|", F.col("game_id").cast("string"), "condition", F.col("month").cast("string")))
    pool = rows.where(F.col("fwd") < F.col("mid")).alias("r").join(away.alias("b"), same & near, "left_anti").select(*SERIES, "month", digest.alias("digest"))
    many = breaks.groupBy("condition").agg((F.count("*") * controls_per).alias("want"))
    want = bars.select("condition").join(many, "condition", "left").select("condition", F.coalesce("want", F.lit(controls_per)).alias("want"))
    controls = first_by_hash(written(pool, "controls"), "condition", "digest", ["game_id", "month"], want)
    return breaks.withColumn("breakout", F.lit(1)).unionByName(controls.select(*SERIES, "month", F.lit(0).alias("breakout")))


def compare(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per condition and signal: sizes, means, Cohen's d, and Mann-Whitney's U and z (ties and
    continuity corrected) of breakouts against controls; at least LEAST_EACH on either side."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("x")) for c in columns]))
    long = rows.select("condition", "breakout", pair.alias("s")).select("condition", "breakout", "s.signal", "s.x").where(F.col("x").isNotNull())
    key = ["condition", "signal"]
    # ranks by value: a value's average rank follows from the counts below it
    values = long.groupBy(*key, "x").agg(F.count("*").alias("t"), F.sum("breakout").alias("b"))
    ranked = average_ranks(values, key, "x", "t", "rank")
    ranks = ranked.groupBy(*key).agg(F.sum(F.col("rank") * F.col("b")).alias("rank_sum"), F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"))
    on, off = F.col("breakout") == 1, F.col("breakout") == 0
    stats = long.groupBy(*key).agg(
        F.count(F.when(on, 1)).alias("n_break"),
        F.count(F.when(off, 1)).alias("n_control"),
        F.avg(F.when(on, F.col("x"))).alias("mean_break"),
        F.avg(F.when(off, F.col("x"))).alias("mean_control"),
        F.var_samp(F.when(on, F.col("x"))).alias("v1"),
        F.var_samp(F.when(off, F.col("x"))).alias("v0"),
    )
    n1, n0 = F.col("n_break"), F.col("n_control")
    n = (n1 + n0).cast("double")
    rows_ = stats.where((n1 >= LEAST_EACH) & (n0 >= LEAST_EACH)).join(ranks, key)
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (n1 + n0 - 2))
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n0 / 2.0) - 0.5, F.lit(0.0)), spread) * F.signum(u - n1 * n0 / 2.0)
    d = F.coalesce(F.try_divide(F.col("mean_break") - F.col("mean_control"), F.nullif(pooled, F.lit(0.0))), F.lit(0.0))
    return rows_.select(*key, "n_break", "n_control", "mean_break", "mean_control", d.alias("d"), u.alias("u"), F.coalesce(z, F.lit(0.0)).alias("z"))


def pre_breakout_signals(history: DataFrame, index: DataFrame, horizon: int = 6, top: float = 0.05) -> DataFrame:
    features = written(pre_features(history, index, horizon), "pre-features")
    tagged = written(breakouts(features, top).join(features, [*SERIES, "month"]), "tagged")  # read for its ranks and for its means
    return compare(tagged, SIGNALS)


def with_p_values(compared: DataFrame) -> DataFrame:
    """Adds p to the few rows of ``compare``; Spark has no error function, so the driver adds it."""
    rows = compared.collect()
    schema = compared.schema.add("p", "double")
    return compared.sparkSession.createDataFrame([(*r, unit_normal_two_sided(r["z"])) for r in rows], schema)
