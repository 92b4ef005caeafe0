"""Does what is known at a January predict the window that follows? Samples, split, trees, measures."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import boosting
from spindrift.operators.factors import GAP, game_factors
from spindrift.operators.ranks import average_ranks, numbered, quantiles
from spindrift.operators.series import GROUP, SERIES, dense_panel
from spindrift.sources.staging import unwritten, written

# The model's features and its bounds.
CATEGORICAL = ["condition", "region", "platform", "genre", "publisher", "esrb", "lifecycle", "franchise", "release_era", "kw_budget_reprint", "kw_limited", "kw_collector"]
NUMERIC = ["log_price_t0", "momentum_12m", "cib_loose_ratio", "age_years", "lifecycle_pos", "release_year"]
MIN_TRAIN, MIN_TEST = 200, 50
SIGNAL_SPEARMAN = 0.1
#: Rounds of boosting and repetitions of a permutation.
ROUNDS, REPEATS = 300, 5


def build_samples(history: DataFrame, index: DataFrame, games: DataFrame, window: int = 36, t0s: list | None = None, with_target: bool = True, **named) -> DataFrame:
    """(series, t0) with price, momentum and attributes at t0 and, wanted, the window's excess
    return. t0: every January of the group's calendar whose window lies inside it, or ``t0s``."""
    w = Window.partitionBy(*SERIES).orderBy("month")
    level = index.select(*GROUP, "month", "level")
    rows = dense_panel(history).join(F.broadcast(level), [*GROUP, "month"], "left")  # a row per group and month
    rows = rows.withColumns(
        {
            "before": F.lag("filled", 12).over(w),
            "level_before": F.lag("level", 12).over(w),
            "after": F.lead("filled", window).over(w),
            "level_after": F.lead("level", window).over(w),
        }
    )
    rows = rows.where(F.col("month").isin([str(t) for t in t0s]) if t0s else F.month("month") == 1)
    target = F.col("after") - F.col("filled") - (F.col("level_after") - F.col("level"))
    momentum = F.col("filled") - F.col("before") - (F.col("level") - F.col("level_before"))
    rows = rows.where(F.col("filled").isNotNull() & (target.isNotNull() if with_target else F.lit(True)))
    rows = rows.select(*SERIES, F.col("month").alias("t0"), F.col("filled").alias("log_price_t0"), momentum.alias("momentum_12m"), *([target.alias("target")] if with_target else []))
    # cib and loose prices within the tolerance before t0, for all t0 at once
    t0 = rows.select("t0").distinct()
    near = history.where(F.col("condition").isin("cib", "loose")).join(F.broadcast(t0), (F.col("month") <= F.col("t0")) & (F.col("month") >= F.add_months("t0", -GAP)))  # t0s: one a year
    at = lambda c: F.max_by(F.when(F.col("condition") == c, F.col("price_cents")), F.when(F.col("condition") == c, F.col("month")))
    ratio = near.groupBy("game_id", "t0").agg(F.try_divide(at("cib"), at("loose")).alias("cib_loose_ratio"))
    begun = games.select(F.col("id").alias("game_id"), F.col("release_date").alias("released"))
    out = rows.join(ratio, ["game_id", "t0"], "left").join(game_factors(games, **named), "game_id", "left").join(begun, "game_id", "left")
    return out.withColumn("age_years", F.datediff("t0", "released") / 365.25).drop("released")


def split_by_time(samples: DataFrame, window: int = 36, test_periods: int = 2) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last periods are the test; training windows end before they begin."""
    t0s = [r[0] for r in samples.select("t0").distinct().orderBy(F.desc("t0")).limit(test_periods).collect()]
    if not t0s:
        return samples, samples
    first = F.lit(min(t0s))
    return samples.where(F.add_months("t0", window) <= first), samples.where(F.col("t0") >= first)


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks from 1, ties sharing their average: cumulative counts over the distinct values."""
    ranked = average_ranks(df.groupBy(column).agg(F.count("*").alias("t_")), [], column, "t_", out)
    return df.join(ranked.drop("t_"), column)


def spearman(df: DataFrame, a: str, b: str) -> float | None:
    ranked = average_rank(average_rank(df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "ra"), b, "rb")
    return ranked.agg(F.corr("ra", "rb")).first()[0]


def r_squared(df: DataFrame, target: str, predicted) -> float | None:
    mean = df.agg(F.avg(target)).first()[0]
    if mean is None:
        return None
    err, all_ = F.sum((F.col(target) - predicted) ** 2), F.sum((F.col(target) - mean) ** 2)
    return df.agg((1 - F.try_divide(err, all_)).alias("r2")).first()[0]


def top_quintile_precision(df: DataFrame, least: int = 25) -> float | None:
    """Of a condition's top fifth by prediction, the share in its top fifth by target; averaged."""
    bars = quantiles(df, ["condition"], "target", {"t": 0.8}, least).drop("n").join(quantiles(df, ["condition"], "prediction", {"p": 0.8}, least), "condition")
    top = df.join(F.broadcast(bars), "condition").where(F.col("prediction") >= F.col("p"))  # a row per condition
    per = top.groupBy("condition").agg(F.avg((F.col("target") >= F.col("t")).cast("double")).alias("share"))
    return per.agg(F.avg("share")).first()[0]


@dataclass
class Fitted:
    summary: dict
    model: boosting.Boosted | None = None
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    importance: list[tuple[str, float, float]] = field(default_factory=list)


def fit_model(samples: DataFrame, window: int = 36, seed: int = 0, rounds: int = ROUNDS, repeats: int = REPEATS, rate: float = 0.05) -> Fitted:
    """Boosted trees (operators.boosting) on the training split, judged on the test split. Features
    that don't vary in training are left out."""
    samples = written(samples, "samples")
    train, test = split_by_time(samples, window)
    n_train, n_test = train.count(), test.count()
    summary = {"n_train": n_train, "n_test": n_test, "window": window}
    if n_train < MIN_TRAIN or n_test < MIN_TEST:
        return Fitted(summary | {"status": "insufficient data", "signal": False})
    counts = train.agg(*[F.countDistinct(c).alias(c) for c in CATEGORICAL + NUMERIC]).first()
    cats = [c for c in CATEGORICAL if counts[c] > 1]
    nums = [c for c in NUMERIC if counts[c] > 1]
    fitted = Fitted(summary, boosting.fit(train, "target", cats, nums, rounds, rate), cats, nums)
    scored = predict(fitted, test).select(*SERIES, "t0", "target", "prediction", *[c for c in cats + nums if c not in SERIES])
    scored = written(scored, "scored")
    middle = quantiles(train, [], "target", {"middle": 0.5}).first()["middle"]
    rho, r2, flat = spearman(scored, "target", "prediction"), r_squared(scored, "target", F.col("prediction")), r_squared(scored, "target", F.lit(middle))
    signal = (rho or 0) > SIGNAL_SPEARMAN and (r2 or 0) > (flat or 0)
    fitted.summary |= {"status": "ok", "spearman": rho, "r2": r2, "r2_baseline": flat, "top_quintile_precision": top_quintile_precision(scored), "signal": signal}
    fitted.importance = permutation_importance(fitted, scored, r2, repeats, seed)
    return fitted


def predict(fitted: Fitted, samples: DataFrame) -> DataFrame:
    """Adds ``prediction``."""
    return boosting.predict(fitted.model, samples)


def permutation_importance(fitted: Fitted, scored: DataFrame, r2: float, repeats: int, seed: int) -> list[tuple[str, float, float]]:
    """(feature, mean, deviation) of the loss in R2 when a feature's values change rows.

    Rows are numbered in a seeded order; in a repetition each row takes the value of the row that
    lies a drawn number of places on, around the end: a permutation without fixed points. One join
    by number brings a row its partners, and one aggregation scores all features and repetitions."""
    features = fitted.categorical + fitted.numeric
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*SERIES, "t0")]))
    rows = written(numbered(scored.drop("prediction").withColumn("digest_", digest), [F.col("digest_"), *map(F.col, SERIES), F.col("t0")], "nr_").drop("digest_"), "numbered")
    n, mean = rows.agg(F.count("*"), F.avg("target")).first()
    shifts = random.Random(seed).sample(range(1, n), min(repeats, n - 1)) if n > 1 else []
    if not shifts:
        return [(c, 0.0, 0.0) for c in features]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rep"), F.lit(s).alias("by")) for k, s in enumerate(shifts)])).alias("s")
    partner = rows.select(each, "nr_", F.struct(*features).alias("other_")).select(F.col("s.rep").alias("rep"), F.pmod(F.col("nr_") + F.col("s.by"), F.lit(n)).alias("nr_"), "other_")
    moved = rows.join(partner, "nr_").withColumn("moved_", F.explode(F.array(*map(F.lit, features))))
    moved = moved.withColumns({c: F.when(F.col("moved_") == c, F.col(f"other_.{c}")).otherwise(F.col(c)) for c in features})
    lost = 1 - F.sum((F.col("target") - F.col("prediction")) ** 2) / F.sum((F.col("target") - mean) ** 2)
    per = predict(fitted, moved.drop("other_")).groupBy("moved_", "rep").agg(lost.alias("r2"))
    found = {r[0]: (r[1], r[2]) for r in per.groupBy("moved_").agg(F.avg(r2 - F.col("r2")), F.stddev_pop(F.lit(r2) - F.col("r2"))).collect()}  # a row a feature
    unwritten(rows)
    return sorted(((c, *found[c]) for c in features), key=lambda x: (-x[1], x[0]))
