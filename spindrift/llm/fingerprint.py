"""Document fingerprints: a canonical exact digest, built-in SQL functions only.

A text is put into canonical form (NFKC, upper then lower case, NFKC again, every run of white space one
space, none at the ends); its fingerprint is two 64-bit xxhashes of that form with different
seeds, in hex. Texts with equal hashes form a bucket; inside each bucket of two or more rows the
canonical bytes themselves are compared: the bucket's distinct forms are numbered in byte order,
and all but the first get ``-number`` after their hashes. So fingerprints are equal exactly where
canonical forms are.

``with_next`` puts each document next to the one that follows it by id. Ids alone are sorted and
linked; texts move once by id, and of the next document only the code points that the edit needs
move a second time. Byte comparison moves the texts of buckets with company alone, one per task
and form (a group of exact copies is summed up before the shuffle).

Defined results: a null text is empty; a null id comes after all others; equal ids follow each
other in order of their texts' hashes, and rows with equal id and text are one document that is
returned as often as it occurs; a single document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import staged, table, text_or_empty

#: All that counts as white space: the Unicode property, and the ASCII controls among it.
BLANK = r"[\p{IsWhite_Space}\x1C-\x1F]+"


def normal_form(text: Column) -> Column:
    """NFKC; a text of ASCII alone is in that form already."""
    # ICU comes with Spark; the call is an SQL function and stays in the JVM
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(composed)


def canonical(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(normal_form(F.lower(F.upper(normal_form(text)))))
    return F.trim(F.regexp_replace(folded, BLANK, " "))


def hashes(form: Column) -> list[Column]:
    return [F.xxhash64(form), F.xxhash64(F.lit("wide"), form)]


def hexed(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def followed(known: DataFrame) -> DataFrame:
    """``known``: doc_id, key, n, times, h1, h2. Adds the next row's (next_*), in order of id (null
    last) and key; the last row's next is the first. Rows are dealt by ranges of the id; the
    ranges' first rows (one a partition) link them."""
    spark = known.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = known.withColumn("last", F.col("doc_id").isNull().cast("int")).repartitionByRange(parts, "last", "doc_id", "key")
    placed = staged(ordered.withColumn("part", F.spark_partition_id()), "ranges")
    me = F.struct("last", "doc_id", "key", "h1", "h2")
    firsts = placed.groupBy("part").agg(F.min(me).alias("first"))  # one row a partition
    along = Window.orderBy("part")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = firsts.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(whole)).alias("over"))
    after = F.coalesce(F.lead(me).over(Window.partitionBy("part").orderBy("last", "doc_id", "key")), F.col("over"))
    linked = placed.join(F.broadcast(over), "part").withColumn("after", after)
    return linked.select(*known.columns, *[F.col(f"after.{c}").alias(f"next_{c}") for c in ("doc_id", "key", "h1", "h2")])


def _same(id1: Column, key1: Column, id2: Column, key2: Column) -> Column:
    return id1.eqNullSafe(id2) & (key1 == key2)


def with_next(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n, own hashes h1, h2, the next document's, the
    edited text's e1, e2 and SHA-256, whether its canonical bytes are the text's own, and ``form``,
    the canonical text of rows whose bucket has company."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    h1, h2 = hashes(canonical(F.col("text")))
    known = staged(rows.select("doc_id", "key", F.char_length("text").cast("long").alias("n"), h1.alias("h1"), h2.alias("h2")).groupBy("doc_id", "key", "n", "h1", "h2").agg(F.count("*").alias("times")), "hashes")
    links = staged(followed(known), "links")

    company = known.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2", F.lit(True).alias("dup"))
    asked = links.select(F.col("next_doc_id").alias("to_id"), F.col("next_key").alias("to_key"), F.col("doc_id").alias("for_id"), F.col("key").alias("for_key"), F.floor(F.col("n") / 2).alias("need"))
    plan = staged(links.join(company, ["h1", "h2"], "left").join(asked, _same(F.col("doc_id"), F.col("key"), F.col("to_id"), F.col("to_key"))).drop("to_id", "to_key"), "edits")

    own = rows.withColumnsRenamed({"doc_id": "own_id", "key": "own_key"}).join(plan, _same(F.col("own_id"), F.col("own_key"), F.col("doc_id"), F.col("key")))
    heads = own.select(F.col("for_id").alias("at_id"), F.col("for_key").alias("at_key"), F.left("text", F.col("need").cast("int")).alias("head")).dropDuplicates(["at_id", "at_key"])
    both = own.join(heads, _same(F.col("doc_id"), F.col("key"), F.col("at_id"), F.col("at_key")))
    edited = F.concat(F.left("text", (F.col("n") - F.floor(F.col("n") / 2)).cast("int")), F.col("head"))
    e = both.withColumn("edited", edited).withColumn("edited_form", canonical(F.col("edited")))
    e1, e2 = hashes(F.col("edited_form"))
    e = e.withColumn("e1", e1).withColumn("e2", e2).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    form = canonical(F.col("text"))
    like = F.when((F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")), form == F.col("edited_form")).otherwise(F.lit(False))
    return staged(
        e.select("doc_id", "key", "n", "h1", "h2", "next_doc_id", "next_key", "next_h1", "next_h2", "e1", "e2", "edited_sha256", like.alias("like_edited"), F.when(F.col("dup"), form).alias("form")),
        "fingerprints",
    )


def collisions(found: DataFrame) -> DataFrame:
    """doc_id, key, number of the documents whose canonical bytes are not the first of their
    bucket: the byte comparison inside equal buckets. Empty unless two forms share 128 bits."""
    forms = found.where(F.col("form").isNotNull()).groupBy("h1", "h2", "form").agg(F.count("*").alias("rows"))
    split = forms.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    numbered = forms.join(split, ["h1", "h2"]).withColumn("number", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("form")) - 1)
    return found.where(F.col("form").isNotNull()).join(numbered.where("number > 0").select("h1", "h2", "form", "number"), ["h1", "h2", "form"]).select("doc_id", "key", "number").distinct()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    found = with_next(docs)
    odd = staged(collisions(found), "collisions")
    zero = F.lit(0)
    if odd.limit(1).count():
        theirs = odd.withColumnsRenamed({"doc_id": "odd_id", "key": "odd_key", "number": "next_number"})
        mine = odd.withColumnsRenamed({"doc_id": "my_id", "key": "my_key"})
        found = found.join(theirs, _same(F.col("next_doc_id"), F.col("next_key"), F.col("odd_id"), F.col("odd_key")), "left").join(mine, _same(F.col("doc_id"), F.col("key"), F.col("my_id"), F.col("my_key")), "left")
        number, next_number = F.coalesce("number", zero), F.coalesce("next_number", zero)
    else:
        number = next_number = zero
    suffix = F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(F.lit(""))
    own = F.concat(hexed(F.col("h1"), F.col("h2")), suffix)
    return found.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        own.alias("fingerprint"),
        F.when(F.col("like_edited"), own).otherwise(hexed(F.col("e1"), F.col("e2"))).alias("edited_fingerprint"),
        F.col("like_edited").cast("double").alias("near_edited"),
        ((F.col("h1") == F.col("next_h1")) & (F.col("h2") == F.col("next_h2")) & (number == next_number)).cast("double").alias("near_next"),
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
