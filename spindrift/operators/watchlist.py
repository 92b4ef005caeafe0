"""Titles that match rising patterns now, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.mining import match_patterns
from spindrift.operators.ranks import quantiles
from spindrift.sources.staging import written


COLUMNS = ["condition", "game_id", "name", "console", "price_cents", "score", "pattern_score", "model_pred", "matched", "already_rising", "genre", "publisher", "region", "platform"]


def zscored(df: DataFrame, x: str, out: str, by: str = "condition") -> DataFrame:
    """Adds standard scores within a group (population deviation); 0 where it doesn't vary. Groups
    are few: their means are summed up before the shuffle and joined by broadcast."""
    per = df.groupBy(F.col(by).alias("by_")).agg(F.avg(x).alias("mean_"), F.stddev_pop(x).alias("sd_"))
    joined = df.join(F.broadcast(per), F.col(by).eqNullSafe(F.col("by_")))  # a row per group
    return joined.withColumn(out, F.coalesce(F.try_divide(F.col(x) - F.col("mean_"), F.nullif("sd_", F.lit(0.0))), F.lit(0.0))).drop("by_", "mean_", "sd_")


def watchlist(now: DataFrame, patterns: DataFrame, labeled: DataFrame, games: DataFrame, history: DataFrame, predictions: DataFrame | None = None, top: int = 50) -> DataFrame:
    """``now``: factors as of today. ``patterns``: with nth, their order. ``predictions``: game_id,
    condition, model_pred."""
    row = ["game_id", "condition"]
    hits = match_patterns(now, patterns)
    rows = now.select(*row, "console", "genre", "publisher", "region", "platform").join(hits, row)
    model = predictions is not None
    rows = rows.join(predictions.select(*row, "model_pred"), row, "left") if model else rows.withColumn("model_pred", F.lit(None).cast("double"))
    rows = rows.where((F.col("pattern_score") > 0) | F.col("model_pred").isNotNull())
    rows = zscored(written(rows, "watch-rows"), "pattern_score", "z_")  # read for the means and for the rows
    if model:
        middle = quantiles(rows, ["condition"], "model_pred", {"middle_": 0.5}).select(F.col("condition").alias("of_"), "middle_")
        rows = rows.join(F.broadcast(middle), F.col("condition") == F.col("of_"), "left").withColumn("filled_", F.coalesce("model_pred", "middle_"))  # a row per condition
        rows = zscored(rows, "filled_", "m_").withColumn("z_", F.col("z_") + F.when(F.col("middle_").isNotNull(), F.col("m_")).otherwise(0.0))
    rows = rows.withColumn("score", F.col("z_"))
    latest = history.groupBy(*row).agg(F.max_by("price_cents", "month").alias("price_cents"))
    flags = labeled.select(*row, (F.coalesce("rising", F.lit(0.0)) == 1).alias("already_rising"))
    names = games.select(F.col("id").alias("game_id"), "name")
    nth = Window.partitionBy("condition").orderBy(F.desc(F.round("score", 9)), "game_id")  # sums differ in their last bits
    best = rows.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= top)
    whole = best.join(latest, row, "left").join(flags, row, "left").join(names, "game_id", "left")
    return whole.withColumn("already_rising", F.coalesce("already_rising", F.lit(False))).select(*COLUMNS)
