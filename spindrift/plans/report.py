"""What a report shows, as one JSON-ready context; each part is a small ranked DataFrame first."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import percent_of
from spindrift.plans.analyze import Analysis
from spindrift.plans.serve import names_lookup

TOP_FACTORS, TOP_PATTERNS, TOP_WATCH, TOP_IMPORTANCE = 15, 20, 25, 10


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("condition").orderBy(*order))).where(F.col("nth") <= n)


def top_factors(lift: DataFrame, n: int = TOP_FACTORS) -> DataFrame:
    return _top(lift.where("lift_lo > 1"), n, F.desc("lift"), "factor", "value")


def index_traces(index: DataFrame) -> DataFrame:
    """condition, console, x, y: the index of each console as percentages, in month order."""
    pts = F.array_sort(F.collect_list(F.struct("month", percent_of(F.col("level")).alias("y"))))
    rows = index.groupBy("condition", "console").agg(pts.alias("p"))
    return rows.select("condition", "console", F.transform("p", lambda p: p["month"].cast("string")).alias("x"), F.transform("p", lambda p: p["y"]).alias("y"))


def factor_bars(lift: DataFrame, n: int = TOP_FACTORS) -> DataFrame:
    """condition and parallel arrays of the top factors, weakest first as a bar chart draws them."""
    r = lambda c: F.bround(c, 3).alias(c)
    row = F.struct((-F.col("nth")).alias("o"), F.concat("factor", F.lit("="), "value").alias("label"), r("lift"), r("lift_lo"), r("lift_hi"), "n")
    rows = top_factors(lift, n).groupBy("condition").agg(F.array_sort(F.collect_list(row)).alias("b"))
    part = lambda c: F.transform("b", lambda x: x[c])
    return rows.select("condition", part("label").alias("labels"), part("lift").alias("lift"), part("lift_lo").alias("lo"), part("lift_hi").alias("hi"), part("n").alias("n"))


def cluster_rows(summary: DataFrame, profile: DataFrame) -> DataFrame:
    """shape, n, share, end (as a change), centroid, traits; strongest end first."""
    trait = F.concat("factor", F.lit("="), "value", F.lit(" ("), F.format_number("lift", 1), F.lit("×)"))
    traits = profile.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", trait.alias("t")))), lambda x: x["t"]).alias("traits"))
    return summary.join(traits, "cluster", "left").select("shape", "n", "share", (F.exp("end_value") - 1).alias("end"), "centroid", F.coalesce("traits", F.array().cast("array<string>")).alias("traits")).orderBy(F.desc("end"))


def top_patterns(patterns: DataFrame, games: DataFrame, n: int = TOP_PATTERNS) -> DataFrame:
    """The first ``n`` patterns of each condition (nth: their order) with their examples' names."""
    first = patterns.where(F.col("nth") <= n).withColumn("key", F.concat_ws("|", "condition", "items"))
    return first.join(names_lookup(first, games, "key"), "key", "left").drop("key")


def ordered_signals(compared: DataFrame) -> DataFrame:
    """Adds nth: of a condition's signals the one of the largest difference first."""
    return compared.withColumn("nth", F.row_number().over(Window.partitionBy("condition").orderBy(F.desc(F.abs("d")), "signal")).cast("long"))  # a row a signal


def _dicts(df: DataFrame | None) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()] if df is not None else []


def _by_condition(rows: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r.pop("condition"), []).append(r)
    return out


def context(done: Analysis) -> dict:
    """All parts, collected; every one is bounded by a top-k, the clusters or consoles x months."""
    t = done.tables
    named = top_patterns(t["patterns"], done.games).orderBy("condition", "nth")
    watch = _top(t["watchlist"], TOP_WATCH, F.desc("score"), "game_id").orderBy("condition", "nth") if "score" in t["watchlist"].columns else None
    return {
        "params": done.params,
        "factors": _by_condition(_dicts(top_factors(t["factor_lift"]).orderBy("condition", "nth"))),
        "patterns": _by_condition(_dicts(named)),
        "index": _by_condition(_dicts(index_traces(t["console_index"]).orderBy("condition", "console"))),
        "bars": _by_condition(_dicts(factor_bars(t["factor_lift"]).orderBy("condition"))),
        "clusters": _dicts(cluster_rows(t["cluster_summary"], t["cluster_profile"])),
        "watch": _by_condition(_dicts(watch)),
        "signals": _by_condition(_dicts(ordered_signals(t["pre_breakout"]).orderBy("condition", "nth"))),
        "model": done.model,
        "importance": _dicts(t["model_importance"].limit(TOP_IMPORTANCE)) if "model_importance" in t else [],
    }


def render(ctx: dict) -> str:
    """A plain HTML page of the context: a table per part, its data as JSON that can't end a script."""
    out = ["<!doctype html><meta charset='utf-8'><title>Rising titles</title>", f"<h1>Rising titles, {html.escape(str(ctx['params']['asof']))}</h1>"]
    for part in ("factors", "patterns", "watch", "signals"):
        for condition, rows in ctx[part].items():
            if rows:
                heads = list(dict.fromkeys(k for r in rows for k in r))
                out.append(f"<h2>{part}: {html.escape(condition)}</h2><table><tr>{''.join(f'<th>{html.escape(h)}</th>' for h in heads)}</tr>")
                out += [f"<tr>{''.join(f'<td>{html.escape(str(r.get(h, "")))}</td>' for h in heads)}</tr>" for r in rows]
                out.append("</table>")
    data = json.dumps({k: ctx[k] for k in ("index", "bars", "clusters")}, sort_keys=True).replace("</", "<\\/")
    return "\n".join([*out, f"<script type='application/json' id='charts'>{data}</script>"])
