"""Upserts, the work queue, the run log, and derived tables on Parquet."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.sources.model import CONDITIONS, CONSOLES, KEYS, SCHEMAS

LIST_COLUMNS = ["console", "platform", "region", "slug", "name", "image_url", "list_rank"]
DETAIL_COLUMNS = ["genre", "release_date", "esrb", "publisher", "developer", "model_number", "player_count", "upc", "asin", "epid"]


def _last(batch: DataFrame, keys: list[str], order: str | None, within: tuple[str, ...] = ()) -> DataFrame:
    """Of rows with one key the last by ``order``, ties (and all, without one) by their columns.
    ``within``: columns that follow from the key and by which the rows lie together already."""
    nth = Window.partitionBy(*within, *keys).orderBy(*_latest_first(batch, [*within, *keys], order))
    return batch.withColumn("nth_", F.row_number().over(nth)).where("nth_ = 1").drop("nth_")


def _latest_first(batch: DataFrame, keys: list[str], order: str | None) -> list:
    plain = [c for c, kind in batch.dtypes if c not in keys and not kind.startswith(("map", "variant"))]
    return [*([F.desc_nulls_last(order)] if order else []), *[F.desc_nulls_last(c) for c in plain]]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` replacing those of equal key; ``keep``: columns whose old
    value survives a replacement. Nulls of new rows overwrite, as any other value."""
    fresh = _last(new, keys, order)
    cols = old.columns
    lacking = [c for c in cols if c not in fresh.columns]
    fresh = fresh.withColumns({c: F.lit(None).cast(old.schema[c].dataType) for c in lacking}) if lacking else fresh
    a, b = old.alias("o"), fresh.select(cols).withColumn("new_", F.lit(True)).alias("n")
    match = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = a.join(b, match, "full_outer")
    pick = lambda c: F.when(F.col("new_"), F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select([pick(c) for c in cols])


def _upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...], order: str | None, within: tuple[str, ...], placed) -> DataFrame:
    """``upsert`` by one shuffle of both frames together: ``placed`` adds ``within``, columns that
    follow from the key, and deals the rows by them. The result has them too and lies by them."""
    cols = old.columns
    both = placed(old.withColumn("new_", F.lit(False)).unionByName(new.withColumn("new_", F.lit(True)), allowMissingColumns=True))
    # a key with a null equals no other: new rows of one are told from old ones
    lacking = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    both = both.withColumn("apart_", F.when(lacking, F.col("new_")))
    nth = Window.partitionBy(*within, *keys, "apart_").orderBy(F.desc("new_"), *_latest_first(both.drop("new_", "apart_"), [*within, *keys], order))
    every = nth.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumns({"nth_": F.row_number().over(nth), "top_": F.first(F.struct("new_", *cols)).over(every), "olds_": F.count(F.when(~F.col("new_"), 1)).over(every)})
    # an old row takes the values of its key's last new row; that row itself stays where there is no old one
    kept = both.where(~F.col("new_") | ((F.col("nth_") == 1) & (F.col("olds_") == 0)))
    pick = lambda c: F.when(F.col("top_.new_"), F.coalesce(F.when(~F.col("new_"), F.col(c)), f"top_.{c}") if c in keep else F.col(f"top_.{c}")).otherwise(F.col(c)).alias(c)
    return kept.select(*[pick(c) for c in cols], *within)


def upsert_games(games: DataFrame, listed: DataFrame, now) -> DataFrame:
    """List pages own a title's list columns only: what detail pages found stays. ``listed``: id,
    console, slug, name, image_url, list_rank."""
    place = F.create_map(*[x for s, (p, r) in CONSOLES.items() for x in (F.lit(s), F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")))])
    at = F.try_element_at(place, F.col("console"))
    rows = listed.withColumns({"platform": at["p"], "region": at["r"], "last_list_at": F.lit(now).cast("timestamp"), "first_seen_at": F.lit(now).cast("timestamp")})
    own = ["id", *LIST_COLUMNS, "last_list_at", "first_seen_at"]
    rows = rows.withColumns({c: F.lit(None).cast(SCHEMAS["games"][c].dataType) for c in own if c not in rows.columns})
    return upsert(games, rows.select(own), ["id"], keep=("first_seen_at", "last_detail_at", *DETAIL_COLUMNS))


def list_snapshots(listed: DataFrame, day) -> DataFrame:
    return listed.select(F.col("id").alias("game_id"), F.lit(day).cast("date").alias("captured_on"), F.lit("list").alias("source"), *[f"{c}_cents" for c in CONDITIONS])


def upsert_detail(games: DataFrame, details: DataFrame, now, order: str | None = None) -> DataFrame:
    """Detail pages overwrite all detail columns, with null too, of titles that exist; of several
    pages of a title the last by ``order`` (its landing time)."""
    fresh = _last(details, ["game_id"], order).select(F.col("game_id").alias("d_id"), *[F.col(c).alias(f"d_{c}") for c in DETAIL_COLUMNS], F.lit(True).alias("hit_"))
    joined = games.join(fresh, F.col("id") == F.col("d_id"), "left")
    pick = {c: F.when(F.col("hit_"), F.col(f"d_{c}")).otherwise(F.col(c)) for c in DETAIL_COLUMNS} | {"last_detail_at": F.when(F.col("hit_"), F.lit(now).cast("timestamp")).otherwise(F.col("last_detail_at"))}
    return joined.withColumns(pick).select(games.columns)


def upsert_rows(table: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """price_snapshots, price_history or sales; a sale keeps when it was first seen. Of several
    sales of one key in a batch the last seen stays."""
    sale = table == "sales"
    return upsert(old, new, KEYS[table], keep=("first_seen_at",) if sale else (), order="first_seen_at" if sale else None)


def checked_details(details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): a page whose own id isn't the title's is set aside."""
    wrong = F.col("pc_id").isNotNull() & (F.col("pc_id") != F.col("game_id"))
    return details.where(~wrong), details.where(wrong)


def games_due(games: DataFrame, now, stale_days: float = 30, limit: int | None = None) -> DataFrame:
    """The work queue: titles never fetched first, then the stalest."""
    edge = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(stale_days * 86400.0))
    due = games.where(F.col("last_detail_at").isNull() | (F.col("last_detail_at") < edge))
    due = due.orderBy(F.col("last_detail_at").isNotNull(), "last_detail_at", F.asc_nulls_first("list_rank"), "id")
    return due.limit(limit) if limit else due


def list_fresh(runs: DataFrame, now, hours: float = 20) -> DataFrame:
    """Consoles whose list was read without error and with some title in the last hours."""
    edge = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(hours * 3600.0))
    return runs.where((F.col("stage") == "list") & F.col("error").isNull() & (F.col("ok") > 0) & (F.col("finished_at") > edge)).select("console").distinct()


def run_log(events: DataFrame) -> DataFrame:
    """The latest row of each run id."""
    return _last(events, ["id"], "at")


#: Buckets of a new table, bytes of a bucket before their number doubles, folders of a log before
#: they are put together, commits that stay readable, and hours before what no commit names is removed.
BUCKETS, BUCKET_BYTES, MOST_FOLDERS, READABLE, ORPHAN_HOURS = 64, 256 << 20, 50, 2, 48
#: Pieces of all buckets for each shuffle partition: a bucket is spread over tasks, each writes few files.
PIECES = 4


@dataclass
class Commit:
    """What a table is at one number: its folders, by bucket (a table without keys: by a running
    name), their bytes, its schema, and the last batch that each sink has put in."""

    number: int
    folders: dict[str, str]
    sizes: dict[str, int]
    schema: str
    keys: list[str] = field(default_factory=list)
    buckets: int = 0
    next_id: int = 1
    applied: dict[str, int] = field(default_factory=dict)

    def next(self, **changed) -> Commit:
        return replace(self, number=self.number + 1, **changed)


class Store:
    """Named tables below one folder, each a row of numbered commits.

    A commit is a small file that appears whole or not at all and is never overwritten; it lists the
    folders of the table's rows. A reader takes the newest (or a given) number and keeps to it. A
    writer puts new folders beside the old ones and then tries the next number: if another writer
    has taken it, the loser removes its folders, reads what is there now, and works anew. Upserts
    deal rows to buckets by a hash of their key and rewrite no bucket but those a batch touches.

    The commit is atomic on local and shared mounts (a hard link) and on HDFS (a rename that fails
    where the name exists). Object stores without such a rename need one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------------ commits

    def _file(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/_commits/{number:012d}.json"

    def versions(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}/_commits")
        if not self._fs.exists(folder):
            return []
        names = (st.getPath().getName() for st in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def commit_of(self, name: str, version: int | None = None) -> Commit | None:
        while True:
            known = self.versions(name)
            if not known or (version is not None and version not in known):
                return None
            try:
                stream = self._fs.open(self._path(self._file(name, known[-1] if version is None else version)))
            except Exception as e:  # it was the oldest and has just gone
                if version is None and "FileNotFound" in str(e):
                    continue
                raise
            try:
                return Commit(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()

    def _commit(self, name: str, commit: Commit) -> bool:
        """Whether this commit took its number."""
        done = self._path(self._file(name, commit.number))
        draft = self._path(f"{done.getParent()}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(commit)).encode()))
        out.close()
        try:
            if self._fs.getScheme() != "file":
                return self._fs.rename(draft, done)
            local = lambda p: self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.String, 0))
            try:
                self._jvm.java.nio.file.Files.createLink(local(done), local(draft))
                return True
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
        finally:
            self._fs.delete(draft, False)

    def _clean(self, name: str) -> None:
        """Removes commits that aren't readable any more and folders that none of the others names."""
        old = self.versions(name)[:-READABLE]
        if not old:
            return
        gone = [c for n in old if (c := self.commit_of(name, n))]
        kept = {f for n in self.versions(name)[-READABLE:] if (c := self.commit_of(name, n)) for f in c.folders.values()}
        for commit in gone:
            self._fs.delete(self._path(self._file(name, commit.number)), False)
            for folder in set(commit.folders.values()) - kept:
                self._fs.delete(self._path(f"{self.root}/{name}/{folder}"), True)
        written = self._path(f"{self.root}/{name}/rows")
        edge = (time.time() - ORPHAN_HOURS * 3600) * 1000
        for st in self._fs.listStatus(written) if self._fs.exists(written) else []:
            top = f"rows/{st.getPath().getName()}"
            if st.getModificationTime() < edge and not any(f == top or f.startswith(f"{top}/") for f in kept):
                self._fs.delete(st.getPath(), True)

    def _loop(self, name: str, attempt) -> int:
        """``attempt``: from the newest commit to (the next one, its new folder), or None for nothing
        to do. Repeated until the number is taken."""
        while True:
            now = self.commit_of(name)
            try:
                made = attempt(now)
            except Exception:
                newest = self.commit_of(name)
                if now and newest and newest.number >= now.number + READABLE:  # what it read has been removed meanwhile
                    continue
                raise
            if made is None:
                return now.number if now else 0
            commit, folder = made
            if self._commit(name, commit):
                self._clean(name)
                return commit.number
            self._fs.delete(self._path(f"{self.root}/{name}/{folder}"), True)

    def _written(self, name: str, df: DataFrame, by: str | None = None) -> tuple[str, dict[str, str], dict[str, int]]:
        """(folder, folders by bucket, their bytes) of rows put down."""
        folder = f"rows/v-{uuid.uuid4().hex}"
        whole = f"{self.root}/{name}/{folder}"
        if by is None:
            df.write.parquet(whole)
            parts = {folder.rpartition("-")[2]: folder}
        else:
            df.write.option("compression", "zstd").partitionBy(by).parquet(whole)
            found = (st.getPath().getName() for st in self._fs.listStatus(self._path(whole)))
            parts = {n.partition("=")[2]: f"{folder}/{n}" for n in found if n.startswith(f"{by}=")}
        return folder, parts, {k: self._fs.getContentSummary(self._path(f"{self.root}/{name}/{f}")).getLength() for k, f in parts.items()}

    def _rows(self, name: str, commit: Commit, buckets: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(commit.schema))
        folders = [f for k, f in commit.folders.items() if buckets is None or k in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in folders])

    # ------------------------------------------------------------------ tables

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The table as of its newest commit, or of ``version``; None where there is none. A frame
        stays with its commit, whose folders last for the next READABLE - 1 commits."""
        commit = self.commit_of(name, version)
        return None if commit is None else self._rows(name, commit)

    def replace(self, name: str, df: DataFrame) -> int:
        """All rows anew; returns the commit's number."""
        folder, parts, sizes = self._written(name, df)

        def attempt(now: Commit | None):
            held = {"folders": parts, "sizes": sizes, "schema": df.schema.json(), "keys": [], "buckets": 0}
            return (now.next(**held) if now else Commit(1, **held)), "rows/none"  # the rows don't depend on what was there

        return self._loop(name, attempt)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: str | None = None, sink: str | None = None, batch_id: int = 0, buckets: int = BUCKETS) -> int:
        """``upsert`` of the stored rows with ``rows``; returns the commit's number. ``sink`` and
        ``batch_id``: a batch that this sink has put in already (or a later one) changes nothing."""

        def attempt(now: Commit | None):
            if sink and now and now.applied.get(sink, -1) >= batch_id:
                return None
            kept = now is not None and now.keys == keys and now.buckets > 0
            many = now.buckets if kept else buckets
            whole = not kept
            if kept and sum(now.sizes.values()) > many * BUCKET_BYTES:
                many, whole = 2 * many, True
            bucket = F.pmod(F.xxhash64(*keys), F.lit(many)).cast("int")
            touched = None if whole else [str(r[0]) for r in rows.select(bucket.alias("b")).distinct().collect()]  # the number of buckets at most
            # rows are shuffled once, by bucket and a piece of it, and are written where they are merged
            pieces = -(-PIECES * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // many)
            within = ("bucket_", "piece_")
            placed = lambda df: df.withColumns({"bucket_": bucket, "piece_": F.pmod(F.hash(*keys), F.lit(pieces))}).repartition(*within)
            if now:
                merged = _upserted(self._rows(name, now, touched), rows, keys, keep, order, within, placed)
            else:
                merged = _last(placed(rows), keys, order, within)
            merged = merged.drop("piece_")
            folder, parts, sizes = self._written(name, merged, "bucket_")
            merged = merged.drop("bucket_")
            if kept and not whole:
                parts = {k: f for k, f in now.folders.items() if k not in touched} | parts
                sizes = {k: n for k, n in now.sizes.items() if k not in touched} | sizes
            held = {"folders": parts, "sizes": sizes, "schema": merged.schema.json(), "keys": keys, "buckets": many}
            held["applied"] = (now.applied if now else {}) | ({sink: batch_id} if sink else {})
            return (now.next(**held) if now else Commit(1, **held)), folder

        return self._loop(name, attempt)

    def append_run(self, name: str, row: dict) -> int:
        """Adds a row with the next id, which is returned; of two that write at once both stay."""
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), list: T.ArrayType(T.StringType())}
        taken = 0

        def attempt(now: Commit | None):
            nonlocal taken
            known = T.StructType.fromJson(json.loads(now.schema)) if now else T.StructType()
            taken = now.next_id if now else 1
            if now and now.next_id == 1 and "id" in known.names:  # a table that was put there whole
                taken = (self._rows(name, now).agg(F.max("id")).first()[0] or 0) + 1
            whole = {"id": taken} | row
            schema = T.StructType([T.StructField(k, kinds.get(type(v), T.StringType())) for k, v in whole.items()])
            fresh = self.spark.createDataFrame([tuple(whole.values())], schema)
            fresh = fresh.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in known if f.name in whole})
            merged = T.StructType([*known, *[f for f in fresh.schema if f.name not in known.names]])
            old, sizes = (now.folders, now.sizes) if now else ({}, {})
            if len(old) >= MOST_FOLDERS:
                fresh, old, sizes = self._rows(name, now).unionByName(fresh, allowMissingColumns=True).coalesce(1), {}, {}
            folder, parts, size = self._written(name, fresh)
            held = {"folders": old | parts, "sizes": sizes | size, "schema": merged.json(), "next_id": taken + 1}
            return (now.next(**held) if now else Commit(1, **held)), folder

        self._loop(name, attempt)
        return taken
