"""An extension: landed detail payloads as a stream, each sale once, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.plans.store import Store
from spindrift.sources.model import KEYS, SCHEMAS
from spindrift.sources.staging import unwritten, written

PAGE = "game_id long, html string, landed_at timestamp"


def landed_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGE).json(folder)


def sale_stream(sales: DataFrame, delay: str = "2 days") -> DataFrame:
    """A stream of sales (first_seen_at: event time) without repeats inside the watermark."""
    return sales.withWatermark("first_seen_at", delay).dropDuplicatesWithinWatermark(KEYS["sales"])


def upsert_batches(store: Store, table: str, sink: str = "stream"):
    """A foreachBatch sink: each batch is merged into a stored table, whose untouched buckets stay
    as they are. The commit holds the number of the batch, so one that runs again changes nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select([F.col(f.name).cast(f.dataType) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])
        held = written(rows, "batch")  # read for its buckets and for its rows
        sale = table == "sales"
        store.upsert(table, held, KEYS[table], keep=("first_seen_at",) if sale else (), order="first_seen_at" if sale else None, sink=sink, batch_id=batch_id)
        unwritten(held)

    return put
