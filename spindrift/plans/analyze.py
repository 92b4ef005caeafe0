"""The batch analysis: one lazy graph over the history, persisted as derived tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import curves, forecast, mining, series, signals
from spindrift.operators.factors import CATEGORICAL, lasting_factors, priced_factors, start_of
from spindrift.operators.watchlist import watchlist
from spindrift.plans.store import Store
from spindrift.sources.staging import written

CORE = ["console_index", "series_metrics", "factor_lift", "patterns"]
OPTIONAL = ["curve_clusters", "cluster_summary", "cluster_profile", "pre_breakout", "watchlist", "model_importance"]
PATTERN_FACTORS = [c for c in CATEGORICAL if c != "developer"]
MOST_SUPPORT, LEAST_SUPPORT, SUPPORT_SHARE = 30, 5, 0.02


@dataclass
class Analysis:
    params: dict
    games: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    model: dict = field(default_factory=dict)
    fitted: forecast.Fitted | None = None


def in_order(patterns: DataFrame) -> DataFrame:
    """Adds nth, a pattern's place in its condition: strongest surely-lifted first."""
    from pyspark.sql import Window

    return patterns.withColumn("nth", F.row_number().over(Window.partitionBy("condition").orderBy(F.desc("lift_lo"), "items")))


def analyze(history: DataFrame, games: DataFrame, sales: DataFrame, window: int = 36, top: float = 0.2, asof=None, min_support: int = MOST_SUPPORT, model: bool = True, clusters: int = 5, min_games: int = 5, min_group: int = 10, rounds: int = forecast.ROUNDS, repeats: int = forecast.REPEATS, **named) -> Analysis:
    """Everything downstream of a history (series.py's long form). The driver learns only the last
    month, counts and the fitted models."""
    spark: SparkSession = history.sparkSession
    history = written(history, "history")
    last = series.last_month(history)
    if last is None:
        raise ValueError("no price history to analyse")
    asof = date.fromisoformat(str(asof)) if asof else last
    index = written(series.console_index(history, min_games), "index")
    metrics = written(series.label_rising(series.series_metrics(history, index, asof), window, top, min_group=min_group), "metrics")
    n_series, n_labeled, base_rate = metrics.agg(F.count("*"), F.count("rising"), F.avg("rising")).first()
    support = max(LEAST_SUPPORT, min(min_support, int(SUPPORT_SHARE * n_labeled)))
    lasting = written(lasting_factors(metrics, games, sales, asof, window, **named), "lasting")
    factors = written(priced_factors(lasting, history, start_of(asof, window)), "factors")
    lift = mining.factor_lift(factors, CATEGORICAL, support)
    patterns = written(in_order(mining.mine_patterns(factors, PATTERN_FACTORS, f"excess_{window}m", support)), "patterns")
    out = Analysis(
        {
            "asof": str(asof),
            "window": window,
            "top": top,
            "consoles": sorted(r[0] for r in metrics.select("console").distinct().collect()),
            "conditions": sorted(r[0] for r in metrics.select("condition").distinct().collect()),
            "min_support": support,
            "n_series": n_series,
            "n_labeled": n_labeled,
            "base_rate": base_rate or 0.0,
        },
        games,
        {"console_index": index, "series_metrics": metrics, "factor_lift": lift, "patterns": patterns},
    )
    assigned, summary = curves.cluster_curves(curves.curve_matrix(history, index), clusters)
    out.tables |= {"curve_clusters": assigned, "cluster_summary": summary, "cluster_profile": curves.profile_clusters(assigned, factors, CATEGORICAL)}
    out.tables["pre_breakout"] = signals.with_p_values(signals.pre_breakout_signals(history, index))
    predictions = None
    if model:
        out.fitted = forecast.fit_model(forecast.build_samples(history, index, games, window, **named), window, rounds=rounds, repeats=repeats)
        out.model = out.fitted.summary
        out.tables["model_importance"] = spark.createDataFrame(out.fitted.importance, "feature string, importance double, deviation double")
        if out.model["signal"]:
            today = forecast.build_samples(history, index, games, window, [asof], with_target=False, **named)
            predictions = forecast.predict(out.fitted, today).select("game_id", "condition", F.col("prediction").alias("model_pred"))
    now = priced_factors(lasting, history, start_of(asof, start=asof))
    out.tables["watchlist"] = watchlist(now, patterns, metrics, games, history, predictions)
    return out


def persist(store: Store, done: Analysis) -> int:
    """Writes all derived tables (an empty one replaces the last run's) and logs the run."""
    for name in CORE + OPTIONAL:
        if (df := done.tables.get(name)) is None:
            df = store.spark.createDataFrame([], "none string")
        store.replace(name, df)
    summary = [(k, str(v)) for k, v in done.model.items()]
    store.replace("model_summary", store.spark.createDataFrame(summary, "name string, value string"))
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return store.append_run("analysis_runs", {"ran_at": stamp} | done.params)


def _typed(text: str):
    if text in ("True", "False", "None"):
        return {"True": True, "False": False, "None": None}[text]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def load_stored(store: Store, games: DataFrame) -> Analysis | None:
    """The last persisted analysis; None if a core table or the run is missing."""
    if not all(store.exists(n) for n in [*CORE, "analysis_runs"]):
        return None
    run = store.read("analysis_runs").orderBy(F.desc("id")).first().asDict()
    tables = {n: df for n in CORE + OPTIONAL if (df := store.read(n)) is not None}
    summary = store.read("model_summary")
    model = {r["name"]: _typed(r["value"]) for r in summary.collect()} if summary is not None else {}
    return Analysis(run, games, tables, model)
