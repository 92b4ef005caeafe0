"""The data model: table schemas, the console registry, and loaders."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.sources import sqlite

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    """'name type, ...' without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


#: Base tables.
SCHEMAS = {
    "games": _schema(
        "id long, console string, platform string, region string, slug string, name string, image_url string, genre string, release_date date, "
        "esrb string, publisher string, developer string, model_number string, player_count string, upc string, asin string, epid string, "
        "list_rank int, first_seen_at timestamp, last_list_at timestamp, last_detail_at timestamp"
    ),
    "price_snapshots": _schema("game_id long, captured_on date, source string, loose_cents long, cib_cents long, new_cents long"),
    "price_history": _schema("game_id long, condition string, month date, price_cents long"),
    "sales": _schema("game_id long, condition string, sale_id string, sale_date date, title string, price_cents long, source string, url string, first_seen_at timestamp"),
    "crawl_runs": _schema("id long, stage string, console string, started_at timestamp, finished_at timestamp, ok int, failed int, error string"),
}
#: The columns that name a row of each table.
KEYS = {"games": ["id"], "price_snapshots": ["game_id", "captured_on", "source"], "price_history": ["game_id", "condition", "month"], "sales": ["game_id", "condition", "sale_id"], "crawl_runs": ["id"]}

# Conditions in display order, regions, and platforms with their base slugs.
CONDITIONS = ("loose", "cib", "new")
REGIONS = ("ntsc-u", "pal", "ntsc-j")
PLATFORMS = {
    "nes": "nes", "snes": "super-nintendo", "gba": "gameboy-advance", "ds": "nintendo-ds", "3ds": "nintendo-3ds", "gamecube": "gamecube",
    "wii": "wii", "wiiu": "wii-u", "ps1": "playstation", "ps2": "playstation-2", "psp": "psp", "vita": "playstation-vita",
    "ps3": "playstation-3", "switch": "nintendo-switch", "xbox": "xbox", "xbox360": "xbox-360",
}
JAPANESE_NAMES = {"nes": "famicom", "snes": "super-famicom"}


def console_slug(platform: str, region: str) -> str:
    base = PLATFORMS[platform]
    return {"ntsc-u": base, "pal": "pal-" + base, "ntsc-j": JAPANESE_NAMES.get(platform, "jp-" + base)}[region]


#: slug -> (platform, region), in display order.
CONSOLES = {console_slug(p, r): (p, r) for p, r in itertools.product(PLATFORMS, REGIONS)}


def resolve_consoles(names: list[str] | None = None, regions: list[str] | None = None) -> list[str]:
    """Slugs of the named platforms (in the chosen regions) and consoles (whatever the region), in
    order, each once. No names: every platform."""
    picked: dict[str, None] = {}
    for name in names or PLATFORMS:
        if name in PLATFORMS:
            picked.update(dict.fromkeys(console_slug(name, r) for r in REGIONS if r in (regions or REGIONS)))
        elif name in CONSOLES:
            picked[name] = None
        else:
            raise ValueError(f"no console or platform is called {name!r}; platforms: {', '.join(PLATFORMS)}")
    return list(picked)


def console_table(spark: SparkSession) -> DataFrame:
    """slug, platform, region, ord: 48 rows, safe to broadcast."""
    return spark.createDataFrame([(s, p, r, i) for i, (s, (p, r)) in enumerate(CONSOLES.items())], "slug string, platform string, region string, ord int")


def in_filter(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows whose column is one of ``values``; none given, no filter."""
    return df.where(F.col(column).isin(list(values))) if values else df


def scan_history(prices: DataFrame, games: DataFrame, consoles: list[str] | None = None, conditions: list[str] | None = None) -> DataFrame:
    """game_id, console, condition, month, price_cents of positive prices of known games."""
    kept = in_filter(prices.where("price_cents > 0"), "condition", conditions).select("game_id", "condition", "month", "price_cents")
    known = in_filter(games, "console", consoles).select(F.col("id").alias("game_id"), "console")
    return kept.join(known, "game_id").select("game_id", "console", "condition", F.col("month").cast("date").alias("month"), "price_cents")


def as_date(column):
    """A date from a date or text; what is no date is null."""
    return F.try_to_timestamp(F.col(column).cast("string")).cast("date")


def scan_games(games: DataFrame) -> DataFrame:
    return games.withColumn("release_date", as_date("release_date"))


def scan_sales(sales: DataFrame) -> DataFrame:
    return sales.select("game_id", "condition", as_date("sale_date").alias("sale_date"), "price_cents", "source")


def migrated(games: DataFrame) -> DataFrame:
    """Older games tables: absent columns are added; platform and region are set from the registry
    where either is missing (both are then overwritten)."""
    for field in SCHEMAS["games"]:
        if field.name not in games.columns:
            games = games.withColumn(field.name, F.lit(None).cast(field.dataType))
    known = console_table(games.sparkSession).select(F.col("slug").alias("console"), F.col("platform").alias("p_"), F.col("region").alias("r_"))
    lacking = (F.col("platform").isNull() | F.col("region").isNull()) & F.col("p_").isNotNull()
    filled = games.join(F.broadcast(known), "console", "left")
    for c, own in (("platform", "p_"), ("region", "r_")):
        filled = filled.withColumn(f"{c}_", F.when(lacking, F.col(own)).otherwise(F.col(c)))
    return filled.drop("platform", "region", "p_", "r_").withColumnsRenamed({"platform_": "platform", "region_": "region"}).select([f.name for f in SCHEMAS["games"]])


def import_sqlite(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """The base tables of an SQLite file, or of a folder of such files, typed. Executors read ranges
    of rows by themselves; the driver sees names of tables and columns alone. ``options``: those of
    sources.sqlite."""
    present = set().union(*map(sqlite.tables_of, sqlite.files_of({"path": path, **options})))
    out = {}
    for name, schema in SCHEMAS.items():
        if name in present:
            df = sqlite.typed(sqlite.sqlite_table(spark, path, name, **options), schema)
            out[name] = migrated(df) if name == "games" else df
    return out


# ---------------------------------------------------------------------------- driver tables


class Panel:
    """The data model on top of the driver's tables: a supplier is a title, its region the console,
    the return flag the condition, the largest extended price of a month the month's price."""

    #: Both 36-month endpoints of nearly every series lie within the two-month tolerance here.
    ASOF = "2001-06-01"

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _condition(self):
        flag = F.col("l_returnflag")
        return F.when(flag == "A", "loose").when(flag == "N", "cib").when(flag == "R", "new")

    def prices(self) -> DataFrame:
        """price_history"""
        month = F.trunc("l_shipdate", "month")
        rows = self.raw("lineitem").select(F.col("l_suppkey").alias("game_id"), self._condition().alias("condition"), month.alias("month"), "l_extendedprice")
        # few rows of a month lie together: dealt by title before they are grouped, they need no further shuffle
        return rows.repartition("game_id").groupBy("game_id", "condition", "month").agg(F.round(F.max("l_extendedprice") * 100).cast("long").alias("price_cents"))

    def _consoles(self) -> DataFrame:
        nation = self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
        return self.raw("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))

    def games(self) -> DataFrame:
        base = self._consoles().select(F.col("s_suppkey").alias("id"), F.col("r_name").alias("console"), F.col("n_name").alias("platform"), F.col("r_name").alias("region"))
        part = self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("genre"), F.col("p_brand").alias("publisher"), F.col("p_size").alias("list_rank"))
        order = self.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("release_date"))
        return base.join(part, "id", "left").join(order, "id", "left").withColumn("slug", F.concat(F.lit("title-"), "id"))

    def history(self) -> DataFrame:
        return scan_history(self.prices(), self._consoles().select(F.col("s_suppkey").alias("id"), F.col("r_name").alias("console")))

    def sales(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_suppkey").alias("game_id"), self._condition().alias("condition"), F.col("l_shipdate").cast("date").alias("sale_date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price_cents"))
