"""Landed payloads to rows: list JSON, embedded chart JSON, detail pages."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import clean_text, iso_date, price_cents
from spindrift.sources.pages import LABELS, PRICE_IDS, SALE, read_page
from spindrift.sources.staging import written

# Keys of the payloads.
LIST_SCHEMA = "id string, consoleUri string, productUri string, productName string, imageUri string, price1 string, price2 string, price3 string"
CHART_KEYS = {"used": "loose", "cib": "cib", "new": "new"}
CHART_NAME = "chart_data"


def list_products(payloads: DataFrame, column: str = "json") -> DataFrame:
    """One row per product: price1 is loose, price2 new, price3 complete."""
    p = F.from_json(column, LIST_SCHEMA)
    return payloads.select(p.alias("p")).select(
        F.col("p.id").try_cast("long").alias("id"),
        F.col("p.consoleUri").alias("console"),
        F.col("p.productUri").alias("slug"),
        F.col("p.productName").alias("name"),
        F.nullif("p.imageUri", F.lit("")).alias("image_url"),
        price_cents(F.col("p.price1")).alias("loose_cents"),
        price_cents(F.col("p.price3")).alias("cib_cents"),
        price_cents(F.col("p.price2")).alias("new_cents"),
    )


def chart_points(pages: DataFrame, column: str = "html") -> DataFrame:
    """game_id, condition, month, price_cents of the chart object in a page; zeros are dropped."""
    text = F.regexp_extract(column, CHART_NAME + r"\s*=\s*(\{[^{}]*\})", 1)
    chart = F.from_json(text, "used array<array<bigint>>, cib array<array<bigint>>, new array<array<bigint>>")
    some = pages.select("game_id", chart.alias("chart"))

    def points(key: str, condition: str):
        pairs = F.coalesce(F.col(f"chart.{key}"), F.array().cast("array<array<bigint>>"))
        return F.transform(pairs, lambda p: F.struct(F.lit(condition).alias("condition"), F.get(p, 0).alias("ms"), F.get(p, 1).alias("cents")))

    parts = F.concat(*[points(k, c) for k, c in CHART_KEYS.items()])
    each = some.select("game_id", F.explode(parts).alias("p")).where("p.cents is not null and p.cents != 0")
    month = F.trunc(F.timestamp_millis("p.ms").cast("date"), "MM")
    return each.groupBy("game_id", F.col("p.condition").alias("condition"), month.alias("month")).agg(F.max_by("p.cents", "p.ms").alias("price_cents"))


_FIELDS = list(LABELS.values())
RAW = f"game_id long, {', '.join(f'{c} string' for c in _FIELDS)}, {', '.join(f'{c}_price string' for c in PRICE_IDS.values())}, own_id string, sales array<struct<{','.join(f'{c}:string' for c in SALE)}>>"


#: Pages turned to Arrow at once, or fewer once they have so many sales.
PAGES, SALES = 1_000, 50_000


def _read_pages(sales: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first, held = [], 0, 0
            for i, page in enumerate(batch.column(1)):
                found.append(read_page(page.as_py(), sales))
                held += len(found[-1]["sales"])
                if len(found) >= PAGES or held >= SALES:
                    yield _as_arrow(batch.column(0).slice(first, len(found)), found)
                    found, first, held = [], i + 1, 0
            if found:
                yield _as_arrow(batch.column(0).slice(first, len(found)), found)

    return run


def _as_arrow(ids: pa.Array, found: list[dict]) -> pa.RecordBatch:
    text = pa.string()
    columns = [ids]
    columns += [pa.array([d["fields"].get(c) for d in found], text) for c in _FIELDS]
    columns += [pa.array([d["prices"][c] for d in found], text) for c in PRICE_IDS.values()]
    rows = [s for d in found for s in d["sales"]]
    parts = zip(*rows, strict=True) if rows else [()] * len(SALE)
    ends = itertools.accumulate((len(d["sales"]) for d in found), initial=0)
    sales = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, text) for c in parts], names=list(SALE)))
    columns += [pa.array([d["own_id"] for d in found], text), sales]
    return pa.RecordBatch.from_arrays(columns, names=["game_id", *_FIELDS, *[f"{c}_price" for c in PRICE_IDS.values()], "own_id", "sales"])


def raw_pages(pages: DataFrame, sales: bool = True) -> DataFrame:
    """What each page (game_id, html) shows, as texts; a null page shows nothing. Without ``sales``
    pages are read for their details alone."""
    return pages.select(F.col("game_id").cast("long").alias("game_id"), F.col("html").cast("string").alias("html")).mapInArrow(_read_pages(sales), RAW)


def page_details(raw: DataFrame) -> DataFrame:
    """A row for each page: game_id, pc_id (the page's own number), its fields and current prices."""
    return raw.select(
        "game_id",
        F.regexp_extract(F.trim("own_id"), r"^\d+$", 0).try_cast("long").alias("pc_id"),
        *[iso_date(F.col(c)).alias(c) if c == "release_date" else clean_text(F.col(c)).alias(c) for c in _FIELDS],
        *[price_cents(F.col(f"{c}_price")).alias(f"{c}_cents") for c in PRICE_IDS.values()],
    )


def page_sales(raw: DataFrame) -> DataFrame:
    """A row for each completed sale that a page lists."""
    s = raw.select("game_id", F.explode("sales").alias("s"))
    title, cents = clean_text(F.col("s.title")), price_cents(F.col("s.price"))
    tag = F.nullif(F.lower(F.regexp_extract("s.cell", r"\[([^\]]+)\]", 1)), F.lit(""))
    return s.select(
        "game_id",
        F.col("s.condition").alias("condition"),
        sale_id(F.col("s.row_id"), F.col("s.sale_date"), title, cents).alias("sale_id"),
        F.col("s.sale_date").try_cast("date").alias("sale_date"),
        title.alias("title"),
        cents.alias("price_cents"),
        F.when(F.length("s.row_id") > 0, F.substring_index("s.row_id", "-", 1)).when(F.col("s.cell").isNotNull(), F.coalesce(tag, F.lit("private"))).alias("source"),
        F.col("s.url").alias("url"),
    )


def detail_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(details, sales) of pages (game_id, html), which are read once into a written table."""
    raw = written(raw_pages(pages), "pages")
    return page_details(raw), page_sales(raw)


def sale_id(row_id, day, title, cents):
    """The row's own id, else a hash of what it shows (a missing value reads None)."""
    shown = [F.coalesce(c.cast("string"), F.lit("None")) for c in (day, title, cents)]
    hashed = F.concat(F.lit("h-"), F.substring(F.sha1(F.concat_ws("|", *shown).cast("binary")), 1, 16))
    return F.coalesce(F.nullif(row_id, F.lit("")), hashed)
