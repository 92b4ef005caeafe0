"""Price series: returns, the median index, dense panels, series metrics and the rising label.

Everything stays long. A series is (console, condition, game_id); its dense calendar is the
console x condition group's, from the group's first month to its last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.ranks import quantiles
from spindrift.sources.staging import written

GROUP = ["console", "condition"]
SERIES = [*GROUP, "game_id"]
#: The same with the title first: sorts tell most rows apart by a number, and rows that lie by title stay where they are.
BY_SERIES = ["game_id", "condition", "console"]
#: Months a price is carried forward.
GAP = 2
WINDOWS = (12, 36, 60)
TREND, LEAST_TREND = 36, 12


def month_number(column):
    return F.year(column) * 12 + F.month(column)


def by_title(history: DataFrame) -> DataFrame:
    """``history``, dealt by title, sorted by series and month: kept so, it needs no further shuffle or sort by series."""
    return history.sortWithinPartitions(*BY_SERIES, "month", "price_cents")


def calendars(history: DataFrame) -> DataFrame:
    """console, condition, lo, hi: a row per group."""
    return history.groupBy(*GROUP).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))


def monthly_returns(history: DataFrame) -> DataFrame:
    """Log returns between adjacent months; a gap breaks the chain."""
    w = Window.partitionBy(*BY_SERIES).orderBy("month")
    logp = F.log("price_cents")
    rows = history.withColumn("ret", logp - F.lag(logp).over(w)).withColumn("before", F.lag("month").over(w))
    return rows.where(F.add_months("before", 1) == F.col("month")).select(*SERIES, "month", "ret")


def console_index(history: DataFrame, min_games: int = 5) -> DataFrame:
    """console, condition, month, ret, n, level on the group's full calendar."""
    by_month = monthly_returns(history).groupBy(*GROUP, "month").agg(F.median("ret").alias("med"), F.count("*").alias("n"))
    full = calendars(history).select(*GROUP, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    rows = full.join(by_month, [*GROUP, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("ret", F.when(F.col("n") >= min_games, F.col("med")))
    along = Window.partitionBy(*GROUP).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*GROUP, "month", "ret", "n", F.sum(F.coalesce("ret", F.lit(0.0))).over(along).alias("level"))


def dense_panel(history: DataFrame) -> DataFrame:
    """A row per series and calendar month: logp is null in gaps, ``filled`` carries the last
    price over at most GAP months. One shuffle by series: each observed month puts out itself and
    the gap up to the next one, the first also the months before it."""
    w = Window.partitionBy(*BY_SERIES)
    ahead = w.orderBy("month", "price_cents")
    rows = history.select(*SERIES, "month", "price_cents").withColumns({"next_": F.lead("month").over(ahead), "first_": F.min("month").over(w)})
    rows = rows.where(F.col("next_").isNull() | (F.col("next_") > F.col("month")))  # of prices of one month the largest stays
    rows = rows.join(F.broadcast(calendars(history)), GROUP)  # a row per console and condition
    start = F.when(F.col("month") == F.col("first_"), F.col("lo")).otherwise(F.col("month"))
    months = F.explode(F.sequence(start, F.coalesce(F.add_months("next_", -1), F.col("hi")), F.expr("interval 1 month")))
    dense = rows.select(*SERIES, "price_cents", F.col("month").alias("seen_"), months.alias("month"))
    dense = dense.select(*SERIES, "month", F.when(F.col("month") == F.col("seen_"), F.log("price_cents")).alias("logp"))
    near = Window.partitionBy(*BY_SERIES).orderBy("month").rowsBetween(-GAP, 0)
    return dense.withColumn("filled", F.last("logp", ignorenulls=True).over(near))


def last_month(history: DataFrame):
    return history.agg(F.max("month")).first()[0]


def series_metrics(history: DataFrame, index: DataFrame, asof=None) -> DataFrame:
    """One row per series with an observed month by ``asof`` (default: the last month of all)."""
    asof = asof or last_month(history)
    end = F.lit(asof).cast("date")
    w = Window.partitionBy(*BY_SERIES).orderBy("month")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    start = F.add_months(end, -TREND)
    inside = F.col("month") >= start
    rows = (
        dense_panel(history)
        .where(F.col("month") <= end)
        .withColumn("diff", F.col("logp") - F.lag("logp").over(w))
        .withColumn("jump", F.col("logp") - F.lag("logp", 3).over(w))
        .withColumn("fall", F.col("logp") - F.max("logp").over(so_far))
    )
    seen = F.col("logp").isNotNull()
    at = lambda back: F.max(F.when(F.col("month") == F.add_months(end, -back), F.col("filled")))
    trend = F.when(inside, F.col("logp"))
    per = rows.groupBy(*BY_SERIES).agg(
        at(0).alias("p_0"),
        *[at(k).alias(f"p_{k}") for k in WINDOWS],
        F.min(F.when(seen, F.col("month"))).alias("first_month"),
        F.max(F.when(seen, F.col("month"))).alias("last_month"),
        F.min_by("logp", F.when(seen, F.col("month"))).alias("first_logp"),
        F.max_by("logp", F.when(seen, F.col("month"))).alias("last_logp"),
        F.count("logp").alias("n_months"),
        F.count(trend).alias("obs_36m"),
        F.regr_slope(trend, month_number("month") / 12.0).alias("slope"),
        (F.stddev_pop(F.when(F.col("month") > start, F.col("diff"))) * F.sqrt(F.lit(12.0))).alias("vol_36m"),
        (F.exp(F.min("fall")) - 1).alias("max_drawdown"),
        F.max("jump").alias("jump_size"),
        F.min_by("month", F.when(F.col("jump").isNotNull(), F.struct(-F.col("jump"), F.col("month")))).alias("jump_month"),
    )
    per = per.where("n_months > 0")
    lv = lambda back: F.max(F.when(F.col("month") == F.add_months(end, -back), F.col("level")))
    levels = index.groupBy(*GROUP).agg(lv(0).alias("l_0"), *[lv(k).alias(f"l_{k}") for k in WINDOWS])
    edge = lambda name: index.select(*GROUP, F.col("month").alias(f"{name}_month"), F.col("level").alias(f"{name}_level"))
    per = per.join(levels, GROUP, "left").join(edge("first"), [*GROUP, "first_month"], "left").join(edge("last"), [*GROUP, "last_month"], "left")
    ret = {k: F.col("p_0") - F.col(f"p_{k}") for k in WINDOWS}
    whole = F.col("last_logp") - F.col("first_logp")
    return per.select(
        "game_id",
        *GROUP,
        end.alias("asof"),
        *[ret[k].alias(f"ret_{k}m") for k in WINDOWS],
        *[(ret[k] - (F.col("l_0") - F.col(f"l_{k}"))).alias(f"excess_{k}m") for k in WINDOWS],
        whole.alias("ret_all"),
        (whole - (F.col("last_level") - F.col("first_level"))).alias("excess_all"),
        F.when(F.col("obs_36m") >= LEAST_TREND, F.col("slope")).alias("slope_36m"),
        "vol_36m",
        "obs_36m",
        "n_months",
        "first_month",
        "last_month",
        "max_drawdown",
        "jump_size",
        "jump_month",
    )


def label_rising(metrics: DataFrame, window: int = 36, top: float = 0.2, min_obs: int = 24, min_group: int = 10) -> DataFrame:
    """Adds ``rising``: 1 from the group's (1 - top) percentile of excess return up, ties and all;
    0 below; null for series or groups with too little to go by."""
    excess = F.when(F.col("n_months") >= min_obs, F.col(f"excess_{window}m"))
    rows = written(metrics.withColumn("eligible", excess), "metrics")  # read for the bars and for the rows
    bars = quantiles(rows, GROUP, "eligible", {"bar": 1.0 - top}, least=min_group)
    rows = rows.join(F.broadcast(bars), GROUP, "left")  # a row per console and condition
    rising = F.when(F.col("bar").isNotNull() & F.col("eligible").isNotNull(), (F.col("eligible") >= F.col("bar")).cast("double"))
    return rows.withColumn("rising", rising).drop("eligible", "bar", "n")
