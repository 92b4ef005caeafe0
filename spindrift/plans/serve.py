"""Read queries over the base and derived tables. Each returns a lazy DataFrame.

Derived tables are optional: functions that need one take it as an argument, None if analysis
hasn't run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import ascii_lower, condition_order, name_contains, percent_of, split_matched
from spindrift.sources.model import CONDITIONS, console_table

FILTERS = ("console", "platform", "region", "genre")
SORTS = ("price", "rank", "name", "excess")
WATCH_SORTS = ("score", "price", "name", "model")
PER_PAGE, MOVERS, SALES, RUNS = 50, 15, 60, 20


def _one_of(value: str, allowed, what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")


def console_ordered(df: DataFrame, column: str = "console") -> DataFrame:
    """Registry order, other consoles after it by name."""
    known = console_table(df.sparkSession).select(F.col("slug").alias(column), "ord")
    return df.join(F.broadcast(known), column, "left").orderBy(F.col("ord").asc_nulls_last(), column).drop("ord")  # 48 rows


def latest_prices(prices: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """game_id, loose_cents, cib_cents, new_cents: the newest snapshot that has the price (of one
    day the detail page's), else the last month's."""
    of = lambda c: F.max_by(F.when(F.col("condition") == c, F.col("price_cents")), F.when(F.col("condition") == c, F.col("month")))
    monthly = prices.groupBy("game_id").agg(*[of(c).alias(f"{c}_cents") for c in CONDITIONS])
    if snapshots is None:
        return monthly
    newest = lambda c: F.max_by(f"{c}_cents", F.when(F.col(f"{c}_cents").isNotNull(), F.struct("captured_on", (F.col("source") == "detail").alias("d"))))
    crawled = snapshots.groupBy("game_id").agg(*[newest(c).alias(f"{c}_now") for c in CONDITIONS])
    both = monthly.join(crawled, "game_id", "full_outer")
    return both.select("game_id", *[F.coalesce(f"{c}_now", f"{c}_cents").alias(f"{c}_cents") for c in CONDITIONS])


def coverage(games: DataFrame, prices: DataFrame, now, stale_days: float = 30) -> DataFrame:
    """Per console: titles listed, fetched, stale, never fetched, with history; newest dates."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(0), secs=F.lit(stale_days * 86400.0))
    have = prices.select(F.col("game_id").alias("h_id")).distinct()
    rows = games.join(have, F.col("id") == F.col("h_id"), "left")
    return rows.groupBy("console").agg(
        F.min("platform").alias("platform"),
        F.min("region").alias("region"),
        F.count("*").alias("listed"),
        F.count("last_detail_at").alias("fetched"),
        F.count_if(F.col("last_detail_at") < limit).alias("stale"),
        F.count_if(F.col("last_detail_at").isNull()).alias("never"),
        F.count("h_id").alias("with_history"),
        F.max("last_list_at").alias("last_list_at"),
        F.max("last_detail_at").alias("last_detail_at"),
    )


def coverage_totals(covered: DataFrame) -> DataFrame:
    return covered.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("listed", "fetched", "stale", "never", "with_history")])


def recent_runs(runs: DataFrame, limit: int = RUNS) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(limit)


def last_analysis(runs: DataFrame) -> DataFrame:
    return recent_runs(runs, 1)


def facets(games: DataFrame) -> DataFrame:
    """facet, value: the distinct non-null values of the filter columns, in one pass."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in FILTERS]))
    return games.select(pair.alias("f")).select("f.facet", "f.value").where(F.col("value").isNotNull()).distinct()


def matching_games(games: DataFrame, q: str | None = None, **filters: str | None) -> DataFrame:
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    rows = games.where(name_contains(F.col("name"), q)) if q else games
    for column, value in filters.items():
        rows = rows.where(F.col(column) == value) if value else rows
    return rows


def _order(sort: str, cond: str) -> list[Column]:
    return {
        "price": [F.desc_nulls_last(f"{cond}_cents")],
        "rank": [F.asc_nulls_last("list_rank")],
        "name": [ascii_lower(F.col("name")).asc()],
        "excess": [F.desc_nulls_last("excess_36m")],
    }[sort]


def search_games(games: DataFrame, prices: DataFrame, snapshots: DataFrame | None = None, metrics: DataFrame | None = None, q: str | None = None, sort: str = "price", cond: str = "loose", page: int = 1, per_page: int = PER_PAGE, **filters: str | None) -> DataFrame:
    """One page of matching titles. The page of ids is found first, from what its sort needs; the
    rest is looked up for that page alone."""
    _one_of(sort, SORTS, "sort")
    _one_of(cond, CONDITIONS, "condition")
    rows = matching_games(games, q, **filters)
    cut = lambda df, by: df.orderBy(*_order(by, cond), "id").offset((max(page, 1) - 1) * per_page).limit(per_page)
    joined = lambda df, other: df.join(other.withColumnRenamed("game_id", "id"), "id", "left")
    measured = metrics.where(F.col("condition") == cond).select("game_id", "excess_36m") if metrics is not None else None
    sort = "price" if sort == "excess" and measured is None else sort
    if sort == "price":
        some = cut(joined(rows, latest_prices(prices, snapshots)), sort)
    else:
        some = cut(joined(rows, measured) if sort == "excess" else rows, sort)
    ids = F.broadcast(some.select(F.col("id").alias("game_id")))  # per_page rows
    own = lambda df: df.join(ids, "game_id", "left_semi")
    if sort != "price":
        some = joined(some, latest_prices(own(prices), own(snapshots) if snapshots is not None else None))
    if sort != "excess":
        some = joined(some, own(measured)) if measured is not None else some.withColumn("excess_36m", F.lit(None).cast("double"))
    return some.orderBy(*_order(sort, cond), "id")


def game(games: DataFrame, prices: DataFrame, game_id: int, snapshots: DataFrame | None = None) -> DataFrame:
    """The title with its current prices; no row if there is none."""
    own = lambda df: df.where(F.col("game_id") == game_id)
    found = latest_prices(own(prices), own(snapshots) if snapshots is not None else None)
    return games.where(F.col("id") == game_id).join(found.withColumnRenamed("game_id", "id"), "id", "left")


def history(prices: DataFrame, game_id: int) -> DataFrame:
    return prices.where(F.col("game_id") == game_id).select("condition", "month", "price_cents").orderBy("condition", "month")


def history_table(prices: DataFrame, game_id: int) -> DataFrame:
    """month, loose, cib, new: newest first."""
    return prices.where(F.col("game_id") == game_id).groupBy("month").pivot("condition", list(CONDITIONS)).agg(F.max("price_cents")).orderBy(F.desc("month"))


def sales(rows: DataFrame, game_id: int, limit: int = SALES) -> DataFrame:
    return rows.where(F.col("game_id") == game_id).orderBy(F.desc("sale_date"), "condition", *[c for c in ("sale_id", "price_cents") if c in rows.columns]).limit(limit)


def game_metrics(metrics: DataFrame | None, game_id: int, clusters: DataFrame | None = None) -> DataFrame | None:
    """The title's series metrics with its curve's shape, by condition; None before analysis."""
    if metrics is None:
        return None
    rows = metrics.where(F.col("game_id") == game_id)
    if clusters is None:
        rows = rows.withColumn("shape", F.lit(None).cast("string"))
    else:
        rows = rows.join(clusters.where(F.col("game_id") == game_id).select("condition", "shape"), "condition", "left")
    return rows.orderBy(condition_order(F.col("condition")))


def with_patterns(watch: DataFrame) -> DataFrame:
    return watch.withColumn("patterns", split_matched(F.col("matched")))


def game_watch(watch: DataFrame | None, game_id: int) -> DataFrame | None:
    return None if watch is None else with_patterns(watch.where(F.col("game_id") == game_id)).orderBy(F.desc("score"))


def rebased_index(games: DataFrame, prices: DataFrame, index: DataFrame, game_id: int) -> DataFrame:
    """condition, month, y: the console's index scaled to the title's first price, over its months;
    conditions whose first month the index lacks are left out."""
    own = prices.where(F.col("game_id") == game_id).groupBy("condition").agg(F.min("month").alias("lo"), F.max("month").alias("hi"), F.min_by("price_cents", "month").alias("first_cents"))
    home = games.where(F.col("id") == game_id).select("console")
    level = index.where(F.col("level").isNotNull()).join(home, "console").select("condition", "month", "level")
    rows = level.join(own, "condition").where((F.col("month") >= F.col("lo")) & (F.col("month") <= F.col("hi")))
    base = level.select("condition", F.col("month").alias("lo"), F.col("level").alias("base"))
    return rows.join(base, ["condition", "lo"]).select("condition", "month", F.bround(F.col("first_cents") / 100 * F.exp(F.col("level") - F.col("base")), 2).alias("y")).orderBy("condition", "month")


def console_index_series(index: DataFrame, console: str) -> DataFrame:
    rows = index.where((F.col("console") == console) & F.col("level").isNotNull())
    return rows.select("condition", "month", percent_of(F.col("level")).alias("y")).orderBy(condition_order(F.col("condition")), "month")


def movers(games: DataFrame, prices: DataFrame, metrics: DataFrame, console: str, cond: str, n: int = MOVERS, rising: bool = True, snapshots: DataFrame | None = None) -> DataFrame:
    _one_of(cond, CONDITIONS, "condition")
    rows = metrics.where((F.col("console") == console) & (F.col("condition") == cond) & F.col("excess_36m").isNotNull())
    by = F.desc("excess_36m") if rising else F.asc("excess_36m")
    top = rows.select(F.col("game_id").alias("id"), "excess_36m", "ret_36m", "rising").join(games.select("id", "name", "console", "genre"), "id").orderBy(by, "id").limit(n)
    ids = F.broadcast(top.select(F.col("id").alias("game_id")))  # n rows
    now = latest_prices(prices.join(ids, "game_id", "left_semi"), snapshots.join(ids, "game_id", "left_semi") if snapshots is not None else None)
    priced = top.join(now.select(F.col("game_id").alias("id"), F.col(f"{cond}_cents").alias("price_cents")), "id", "left")
    return priced.select("id", "name", "console", "genre", "excess_36m", "ret_36m", "rising", "price_cents").orderBy(by, "id")


def watchlist(watch: DataFrame | None, cond: str = "loose", console: str | None = None, sort: str = "score") -> DataFrame | None:
    if watch is None:
        return None
    _one_of(sort, WATCH_SORTS, "sort")
    rows = watch.where(F.col("condition") == cond)
    rows = rows.where(F.col("console") == console) if console else rows
    order = {"score": F.desc("score"), "price": F.desc("price_cents"), "name": ascii_lower(F.col("name")).asc(), "model": F.desc_nulls_last("model_pred")}[sort]
    return with_patterns(rows).orderBy(order, "game_id")


def watchlist_consoles(watch: DataFrame) -> DataFrame:
    return console_ordered(watch.select("console").distinct())


def compare_series(games: DataFrame, prices: DataFrame, ids: list[int], cond: str = "loose", mode: str = "raw", index: DataFrame | None = None) -> DataFrame | None:
    """id, name, console, month, y of the titles asked for. raw: dollars; rebased: 100 at the
    latest first month of all; index: rebased and divided by the console's index."""
    _one_of(cond, CONDITIONS, "condition")
    _one_of(mode, ("raw", "rebased", "index"), "mode")
    if mode == "index" and index is None:
        return None
    rows = prices.where(F.col("game_id").isin(ids) & (F.col("condition") == cond)).select(F.col("game_id").alias("id"), "month", "price_cents")
    rows = rows.join(games.where(F.col("id").isin(ids)).select("id", "name", "console"), "id")
    if mode == "raw":
        return rows.select("id", "name", "console", "month", (F.col("price_cents") / 100).alias("y")).orderBy("id", "month")
    if mode == "index":
        level = index.where((F.col("condition") == cond) & F.col("level").isNotNull()).select("console", "month", "level")
        rows = rows.join(level, ["console", "month"])
    else:
        rows = rows.withColumn("level", F.lit(0.0))
    own = Window.partitionBy("id")
    rows = rows.withColumn("first", F.min("month").over(own)).withColumn("start", F.max("first").over(Window.partitionBy(F.lit(1))))  # rows of MAX_IDS titles
    rows = rows.where(F.col("month") >= F.col("start"))
    c0, l0 = F.min_by("price_cents", "month").over(own), F.min_by("level", "month").over(own)
    return rows.select("id", "name", "console", "month", F.bround(100 * F.col("price_cents") / c0 * F.exp(l0 - F.col("level")), 3).alias("y")).orderBy("id", "month")


def names_lookup(ids: DataFrame, games: DataFrame, key: str, column: str = "examples") -> DataFrame:
    """key, names: 'name (console)' of comma-separated ids, in their order; unknown ones left out."""
    each = ids.select(key, F.posexplode(F.split(column, ",")).alias("nth", "one")).withColumn("id", F.col("one").try_cast("long"))
    named = each.join(games.select("id", F.concat("name", F.lit(" ("), "console", F.lit(")")).alias("label")), "id")
    return named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "label"))), lambda x: x["label"]).alias("names"))


def healthz(games: DataFrame) -> DataFrame:
    return games.agg(F.count("*").alias("games"))
