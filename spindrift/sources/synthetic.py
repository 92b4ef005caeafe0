"""A seeded price panel with planted effects, made by Spark expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the generator: extra log return a month from 2019 on.
PLANTED = {"genre": ("RPG", 0.015), "publisher": ("SmallCo", 0.010), "year": (1993, 0.008), "name": ("Super Mario", 0.005)}
GENRES, PUBLISHERS = ["RPG", "Action", "Sports", "Puzzle"], ["Nintendo", "Capcom", "Konami", "SmallCo"]
START, END = "2010-01-01", "2026-09-01"


def _unit(*salt):
    """A uniform number from a hash of the arguments."""
    return F.pmod(F.xxhash64(*[F.lit(s) if isinstance(s, str) else s for s in salt]), F.lit(1_000_003)) / 1_000_003.0


def _normal(*salt):
    return F.sqrt(-2 * F.log(F.greatest(_unit("a", *salt), F.lit(1e-9)))) * F.cos(2 * 3.141592653589793 * _unit("b", *salt))


def synthetic(spark: SparkSession, titles: int = 120, signal: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(games, price_history, sales) of two consoles."""
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.floor(_unit(salt, F.col("id")) * len(values)) + 1).cast("int"))
    g = spark.range(1, 2 * titles + 1)
    g = g.withColumn("console", F.when(F.col("id") <= titles, "nes").otherwise("pal-nes")).withColumn("platform", F.lit("nes"))
    g = g.withColumn("region", F.when(F.col("console") == "nes", "ntsc-u").otherwise("pal")).withColumn("slug", F.concat(F.lit("game-"), "id"))
    g = g.withColumn("name", F.concat(F.when(_unit("mario", F.col("id")) < 0.15, "Super Mario Game ").otherwise("Game "), "id"))
    g = g.withColumn("genre", pick(GENRES, "genre")).withColumn("publisher", pick(PUBLISHERS, "publisher"))
    year = (F.lit(1985) + F.floor(_unit("year", F.col("id")) * 10)).cast("int")
    games = g.withColumn("release_date", F.make_date(year, (F.floor(_unit("m", F.col("id")) * 12) + 1).cast("int"), F.lit(1))).withColumn("list_rank", F.col("id").cast("int"))
    boost = (
        F.when(F.col("genre") == "RPG", PLANTED["genre"][1]).otherwise(0.0)
        + F.when(F.col("publisher") == "SmallCo", PLANTED["publisher"][1]).otherwise(0.0)
        + F.when(F.year("release_date") >= 1993, PLANTED["year"][1]).otherwise(0.0)
        + F.when(F.col("name").startswith("Super Mario"), PLANTED["name"][1]).otherwise(0.0)
    ) * (1.0 if signal else 0.0)
    each = games.select("id", "console", boost.alias("boost"), F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(m).alias("times"), F.lit(p).alias("share")) for c, m, p in (("loose", 1.0, 1.0), ("cib", 2.2, 0.9), ("new", 5.0, 0.6))])).alias("c"))
    each = each.where(_unit("has", F.col("id"), F.col("c.condition")) < F.col("c.share"))
    late = F.floor(_unit("late", F.col("id"), F.col("c.condition")) * 24).cast("int")
    months = F.explode(F.sequence(F.add_months(F.lit(START).cast("date"), late), F.lit(END).cast("date"), F.expr("interval 1 month")))
    rows = each.select("id", "console", "boost", F.col("c.condition").alias("condition"), F.col("c.times").alias("times"), months.alias("month"))
    step = 0.003 + 0.01 * _normal("market", F.col("console"), F.col("month").cast("string")) + 0.02 * _normal("own", F.col("id"), F.col("condition"), F.col("month").cast("string"))
    step = step + F.when(F.col("month") >= F.lit("2019-01-01").cast("date"), F.col("boost")).otherwise(0.0)
    along = Window.partitionBy("id", "condition").orderBy("month")
    base = F.log(500 + 4500 * _unit("base", F.col("id"))) + F.log("times")
    history = rows.withColumn("logp", base + F.sum(step).over(along)).select(F.col("id").alias("game_id"), "condition", "month", F.round(F.exp("logp")).cast("long").alias("price_cents"))
    n = F.floor(_unit("sold", F.col("id")) * 12).cast("int")
    sales = games.where(n > 0).select(F.col("id").alias("game_id"), F.lit("loose").alias("condition"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    sales = sales.select("game_id", "condition", F.concat(F.lit("s-"), "i").alias("sale_id"), F.make_date(F.lit(2026), (F.col("i") % 9 + 1).cast("int"), F.lit(15)).alias("sale_date"), F.lit(1000).cast("long").alias("price_cents"), F.lit("ebay").alias("source"))
    return games, history, sales
