"""Candidate factors of a rise: attributes of the title, its price at the start, its sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import binned
from spindrift.operators.series import GAP

# Franchise and keyword patterns (case-insensitive, first franchise wins), bins.
FRANCHISES = {
    "mario": r"\bmario\b",
    "zelda": r"\bzelda\b",
    "pokemon": r"\bpok[eé]mon\b",
    "metroid": r"\bmetroid\b",
    "kirby": r"\bkirby\b",
    "donkey kong": r"\bdonkey kong\b",
    "mega man": r"\bmega ?man\b|\brockman\b",
    "castlevania": r"\bcastlevania\b|\bakumajo\b",
    "final fantasy": r"\bfinal fantasy\b",
    "dragon quest": r"\bdragon (quest|warrior)\b",
    "resident evil": r"\bresident evil\b|\bbiohazard\b",
    "sonic": r"\bsonic\b",
    "street fighter": r"\bstreet fighter\b",
    "fire emblem": r"\bfire emblem\b",
    "persona": r"\bpersona\b",
    "shin megami tensei": r"\bshin megami tensei\b|\bmegami\b",
    "metal gear": r"\bmetal gear\b",
    "kingdom hearts": r"\bkingdom hearts\b",
    "halo": r"\bhalo\b",
    "contra": r"\bcontra\b|\bprobotector\b",
    "ninja gaiden": r"\bninja gaiden\b",
    "earthbound": r"\bearthbound\b|\bmother\b",
    "star fox": r"\bstar ?fox\b",
    "animal crossing": r"\banimal crossing\b",
    "xenoblade": r"\bxeno(blade|saga|gears)\b",
    "tales of": r"\btales of\b",
    "suikoden": r"\bsuikoden\b",
    "silent hill": r"\bsilent hill\b",
    "monster hunter": r"\bmonster hunter\b",
    "harvest moon": r"\bharvest moon\b|\bstory of seasons\b",
    "atelier": r"\batelier\b",
    "disgaea": r"\bdisgaea\b",
    "pikmin": r"\bpikmin\b",
    "smash bros": r"\bsmash bros",
    "wario": r"\bwario",
    "yoshi": r"\byoshi",
    "crash": r"\bcrash bandicoot\b",
    "spyro": r"\bspyro\b",
}
KEYWORDS = {
    "limited": r"\blimited\b",
    "collector": r"\bcollector'?s?\b",
    "special_edition": r"\bspecial edition\b",
    "test_or_proto": r"\btest\b|\bprototype\b|\bdebug\b",
    "competition": r"\bcompetition\b|\bchampionship",
    "promo": r"\bpromo\b|\bnot for resale\b|\bnfr\b",
    "demo": r"\bdemo\b|\bkiosk\b",
    "budget_reprint": r"greatest hits|player'?s choice|\bplatinum\b|nintendo selects|\bclassics\b|\bbest\b",
    "bundle": r"\bbundle\b|\bcombo\b|\b\d ?in ?1\b",
}
INF = float("inf")
PRICE_BINS = ([0, 2000, 10000, 50000, INF], ["<$20", "$20-100", "$100-500", "$500+"])
RATIO_BINS = ([0, 1.5, 3, INF], ["<1.5x", "1.5-3x", "3x+"])
SALES_BINS = ([-1, 0, 4, 14, INF], ["0", "1-4", "5-14", "15+"])
LIFECYCLE_BINS = ([-0.01, 0.2, 0.8, 1.01], ["early", "mid", "late"])
TOP_N = 25

KEYWORD_COLUMNS = [f"kw_{k}" for k in KEYWORDS]
CATEGORICAL = ["region", "platform", "genre", "publisher", "developer", "esrb", "release_era", "lifecycle", "franchise", *KEYWORD_COLUMNS, "price_bucket", "cib_loose", "new_cib", "liquidity"]
NUMERIC = ["release_year", "lifecycle_pos", "log_price_start", "cib_loose_ratio", "new_cib_ratio", "sales_12m", "age_years"]


def franchise(name, patterns: dict[str, str] = FRANCHISES):
    named = [F.when(F.coalesce(name, F.lit("")).rlike("(?iu)" + p), k) for k, p in patterns.items()]
    return F.coalesce(*named, F.lit("none"))


def keyword_flags(name, patterns: dict[str, str] = KEYWORDS) -> list:
    return [F.when(F.coalesce(name, F.lit("")).rlike("(?iu)" + p), "yes").otherwise("no").alias(f"kw_{k}") for k, p in patterns.items()]


def top_n(df: DataFrame, column: str, n: int = TOP_N) -> DataFrame:
    """The n most frequent values stay (ties by value), others become 'other', null 'unknown'."""
    kept = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(F.col(column).alias("top_"))
    named = df.join(F.broadcast(kept), F.col(column) == F.col("top_"), "left")  # n rows
    return named.withColumn(column, F.when(F.col(column).isNull(), "unknown").otherwise(F.coalesce("top_", F.lit("other")))).drop("top_")


def with_lifecycle_position(games: DataFrame) -> DataFrame:
    """Adds lifecycle_pos: where a release lies between its console's first and last, 0 to 1; null without a span."""
    span = games.where(F.col("console").isNotNull()).groupBy(F.col("console").alias("of_")).agg(F.min("release_date").alias("first_"), F.max("release_date").alias("last_"))
    rows = games.join(F.broadcast(span), F.col("console") == F.col("of_"), "left")  # a row per console
    share = F.datediff("release_date", "first_") / F.datediff("last_", "first_")
    return rows.withColumn("lifecycle_pos", F.when(F.col("last_") > F.col("first_"), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))).drop("of_", "first_", "last_")


def game_factors(games: DataFrame, top: int = TOP_N, franchises: dict[str, str] = FRANCHISES, words: dict[str, str] = KEYWORDS) -> DataFrame:
    """Per game_id: categorical attributes without nulls, release_year and lifecycle_pos."""
    for c in ("esrb", "developer"):
        if c not in games.columns:
            games = games.withColumn(c, F.lit(None).cast("string"))
    rows = with_lifecycle_position(top_n(top_n(games, "publisher", top), "developer", top))
    year = F.year("release_date")
    era = F.floor(year / 5) * 5
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return rows.select(
        F.col("id").alias("game_id"),
        *[known(c) for c in ("region", "platform", "genre", "publisher", "developer", "esrb")],
        F.coalesce(F.concat(era.cast("string"), F.lit("-"), (era + 4).cast("string")), F.lit("unknown")).alias("release_era"),
        binned(F.col("lifecycle_pos"), *LIFECYCLE_BINS, right=True).alias("lifecycle"),
        franchise(F.col("name"), franchises).alias("franchise"),
        *keyword_flags(F.col("name"), words),
        year.cast("long").alias("release_year"),
        "lifecycle_pos",
    )


def price_at(history: DataFrame, when) -> DataFrame:
    """game_id, condition, price: the last price in the GAP months up to ``when``."""
    day = F.lit(when).cast("date")
    near = history.where((F.col("month") <= day) & (F.col("month") >= F.add_months(day, -GAP)))
    return near.groupBy("game_id", "condition").agg(F.max_by("price_cents", "month").alias("price"))


def price_factors(history: DataFrame, start) -> DataFrame:
    """Per game and condition that has a price at ``start``: its bucket and the game's ratios."""
    price = price_at(history, start)
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("price")))
    ratios = price.groupBy("game_id").agg(F.try_divide(of("cib"), of("loose")).alias("cib_loose_ratio"), F.try_divide(of("new"), of("cib")).alias("new_cib_ratio"))
    return price.join(ratios, "game_id").select(
        "game_id",
        "condition",
        binned(F.col("price"), *PRICE_BINS, right=False).alias("price_bucket"),
        binned(F.col("cib_loose_ratio"), *RATIO_BINS, right=False).alias("cib_loose"),
        binned(F.col("new_cib_ratio"), *RATIO_BINS, right=False).alias("new_cib"),
        F.log("price").alias("log_price_start"),
        "cib_loose_ratio",
        "new_cib_ratio",
    )


def sales_factors(sales: DataFrame, asof) -> DataFrame:
    """Sales in the twelve months up to ``asof``."""
    day = F.lit(asof).cast("date")
    recent = sales.where((F.col("sale_date") > F.add_months(day, -12)) & (F.col("sale_date") <= day))
    return recent.groupBy("game_id", "condition").agg(F.count("*").alias("sales_12m"))


def lasting_factors(labeled: DataFrame, games: DataFrame, sales: DataFrame, asof, window: int = 36, **named) -> DataFrame:
    """Of each labelled series what doesn't depend on where its prices are taken, and released."""
    begun = games.select(F.col("id").alias("game_id"), F.col("release_date").alias("released"))
    rows = labeled.select("game_id", "console", "condition", "rising", f"excess_{window}m")
    rows = rows.join(game_factors(games, **named), "game_id", "left").join(sales_factors(sales, asof), ["game_id", "condition"], "left").join(begun, "game_id", "left")
    return rows.withColumn("sales_12m", F.coalesce("sales_12m", F.lit(0))).withColumn("liquidity", binned(F.col("sales_12m"), *SALES_BINS, right=True))


def priced_factors(lasting: DataFrame, history: DataFrame, day) -> DataFrame:
    """``lasting_factors`` with prices and age as of a day."""
    rows = lasting.join(price_factors(history, day), ["game_id", "condition"], "left")
    rows = rows.withColumn("age_years", F.datediff(day, "released") / 365.25).drop("released")
    return rows.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("price_bucket", "cib_loose", "new_cib")})


def start_of(asof, window: int = 36, start=None):
    """``start``, or where the window that ends at ``asof`` began."""
    return F.lit(start).cast("date") if start is not None else F.add_months(F.lit(asof).cast("date"), -window)


def build_factors(labeled: DataFrame, games: DataFrame, history: DataFrame, sales: DataFrame, asof, window: int = 36, start=None, **named) -> DataFrame:
    """Factors of each labelled series; prices as of ``start`` (default: where the window began)."""
    return priced_factors(lasting_factors(labeled, games, sales, asof, window, **named), history, start_of(asof, window, start))
