"""Sharding by a Feistel permutation with cycle walking over global row numbers.

``shard_rows`` numbers all rows 0..N-1, permutes the numbers with a keyed Feistel network on
Z_a x Z_b (a*b is N or a little more; numbers at N or above walk on along their cycle), and deals
the permuted number p to shard ``p mod n_shards``, slot ``p div n_shards``. Shard sizes differ by
one row at most, slots have no gaps, and both can be computed from a row number alone
(``permuted`` in Python, the same expression in SQL).

The plan is built-in DataFrame expressions only. Two scans: one counts rows by a bucket of the id
(column-pruned to the id), one ranks rows in their bucket. Only narrow rows (id, size, checksums)
are exchanged, never texts, and the only broadcast table has ``BUCKETS`` rows whatever the input.

Defined results: a null id is numbered like id 0, after the true 0; equal ids are put in order of
checksum and digest (identical rows are interchangeable); an empty table gives no rows; a null
text counts 0 bytes with the checksum of an empty text; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import table, text_or_empty

#: Buckets that carry the numbering: a fixed bound on the offsets table.
BUCKETS = 4096
#: The prime of the round function and of the bucket hash (2**31 - 1, so products fit in 63 bits).
PRIME = 2147483647
ROUNDS = 8
#: Steps of the guarded walk. At most a - 1 numbers lie at N or above, so for N < 4096 a walk is
#: shorter than this; beyond, one this long has a chance under 64**-64. It is never cut silently.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """(factor, offset) of each round, from a linear congruential sequence."""
    keys, x = [], (seed * 2654435761 + 97) % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 11) % PRIME
        factor = x % (PRIME - 2) + 2
        x = (x * 48271 + 11) % PRIME
        keys.append((factor, x))
    return keys


def domain(n: int) -> tuple[int, int]:
    """The smallest near-square a x b that holds n numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: int, n: int, seed: int) -> int:
    """The permutation for one row number; the reference for the Column form."""
    a, b = domain(n)
    keys = round_keys(seed)
    while True:
        left, right = divmod(x, b)
        for i, (factor, offset) in enumerate(keys):
            if i % 2 == 0:
                left = (left + (right % PRIME * factor + offset) % PRIME // 8) % a
            else:
                right = (right + (left % PRIME * factor + offset) % PRIME // 8) % b
        x = left * b + right
        if x < n:
            return x


def _network(x: Column, n: int, seed: int) -> Column:
    a, b = domain(n)
    p = F.lit(PRIME).cast("long")

    def mixed(v: Column, factor: int, offset: int) -> Column:
        return F.shiftright((v % p * F.lit(factor).cast("long") + F.lit(offset).cast("long")) % p, 3)

    base = F.lit(b).cast("long")
    right = x % base
    left = F.floor((x - right) / base).cast("long")
    for i, (factor, offset) in enumerate(round_keys(seed)):
        if i % 2 == 0:
            left = (left + mixed(right, factor, offset)) % F.lit(a).cast("long")
        else:
            right = (right + mixed(left, factor, offset)) % base
    return left * base + right


def permuted_column(x: Column, n: int, seed: int) -> Column:
    """The permuted number of row number ``x`` in 0..n-1."""
    size = F.lit(n).cast("long")
    once = _network(x, n, seed)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        once,
        lambda acc, _: F.when(acc >= size, _network(acc, n, seed)).otherwise(acc),
        lambda acc: F.when(acc < size, acc).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")),
    )
    return F.when(once < size, once).otherwise(walk)


def bucket_of(id_col: Column, checksum: Column) -> Column:
    """By the id and a checksum of the rest: rows that share one id, or have none, are dealt over all buckets too."""
    p = F.lit(PRIME).cast("long")
    mixed = (F.pmod(F.coalesce(id_col.cast("long"), F.lit(0).cast("long")), p) * F.lit(1103515245).cast("long") + F.lit(12345).cast("long")) % p
    return ((mixed % F.lit(BUCKETS) + F.pmod(checksum, F.lit(BUCKETS))) % F.lit(BUCKETS)).cast("int")


def numbered(rows: DataFrame, id_name: str, ties: list[str]) -> DataFrame:
    """Adds ``row_number`` 0..N-1: by bucket of the id and the first of ``ties``, then id (null last), then ``ties``."""
    bucket = bucket_of(F.col(id_name), F.col(ties[0]))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.select(bucket.alias("bucket"))
        .groupBy("bucket")
        .count()
        .select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_number"))
    )
    order = Window.partitionBy("bucket").orderBy(F.col(id_name).asc_nulls_last(), *ties)
    ranked = rows.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(order))
    return (
        ranked.join(F.broadcast(offsets), "bucket")  # BUCKETS rows at most
        .withColumn("row_number", F.col("first_number") + F.col("rank") - 1)
        .drop("bucket", "rank", "first_number")
    )


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, permuted."""
    n = docs.count()
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("digest"),
    )
    shards = F.lit(n_shards).cast("long")
    return (
        numbered(rows, "doc_id", ["text_crc32", "size", "digest"])
        .withColumn("permuted", permuted_column(F.col("row_number"), max(n, 1), seed))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            (F.col("permuted") % shards).cast("int").alias("shard"),
            F.floor((F.col("permuted") - F.col("permuted") % shards) / shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "row_number",
            "permuted",
        )
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    """CRC-32 of each single byte without start and end value: eight steps by the polynomial."""
    found = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        found.append(byte)
    return found


#: The same numbering, network (one round a step of ``net``, walking on while the number is N or above) and checksum.
#: Rows of one id, size and checksum would also need the digest.
OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents
), c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, list_extract({_crc_table()}, CAST((xor(c, b) & 255) + 1 AS BIGINT))))) AS text_crc32
  FROM d
), dealt AS (
  SELECT *, (((coalesce(doc_id, 0) % {PRIME} + {PRIME}) % {PRIME} * 1103515245 + 12345) % {PRIME} % {BUCKETS} + text_crc32 % {BUCKETS}) % {BUCKETS} AS bucket FROM c
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS LAST, text_crc32, size) - 1 AS num FROM dealt
), dims AS (
  SELECT n, side, greatest(1, (n + side - 1) // side) AS base
  FROM (SELECT count(*) AS n, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS side FROM documents)
), keys(step, factor, shift) AS (
  VALUES {", ".join(str((i, *key)) for i, key in enumerate(round_keys(20)))}
), net AS (
  SELECT num, num // base AS l, num % base AS r, 0 AS i FROM numbered, dims
  UNION ALL
  SELECT num, CASE WHEN i % 2 = 0 THEN (l + ((r % {PRIME} * factor + shift) % {PRIME} >> 3)) % side ELSE l END,
         CASE WHEN i % 2 = 1 THEN (r + ((l % {PRIME} * factor + shift) % {PRIME} >> 3)) % base ELSE r END, i + 1
  FROM net JOIN keys ON step = i % {ROUNDS}, dims
  WHERE i = 0 OR i % {ROUNDS} <> 0 OR l * base + r >= n
), done AS (
  SELECT num, l * base + r AS permuted FROM net, dims WHERE i > 0 AND i % {ROUNDS} = 0 AND l * base + r < n
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(permuted % 40 AS INTEGER) AS shard, CAST(permuted // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard,
       CAST(num AS BIGINT) AS row_number, CAST(permuted AS BIGINT) AS permuted
FROM numbered JOIN done USING (num)
"""
