"""Exact deduplication by progressive refinement.

Rows are grouped by byte length, those that share a length by a hash of their
first bytes, and only those that share both by the SHA-256 of the whole text.
The first two levels move a few bytes a row. Which keys survive them is told to
the readers by a bitmap of fixed size (``BUCKETS`` x 4 KB), so the whole text of a
row is hashed where it lies if its key's bit is set; a bit that two keys share
only costs a hash. The groups themselves are counted by the hashes, with map-side
aggregation, and joined back by an equi-join that adaptive execution splits where
one group is hot. Texts are never shuffled for it.

Cases: null texts equal empty ones. Texts are equal when identical, byte for
byte; very long ones are hashed whole. The row with the largest id stays; null
ids lose to any other; of rows that tie, repeating both id and text, one stays.
An empty table gives no rows. Only the id and the text are read, so clashing
column names do no harm; ``drop_copies`` keeps all columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty, without

PREFIX = 128
#: Parts of the bitmap, of 32,768 bits each: 8 MB in all.
BUCKETS = 2048


def _surviving(heads: DataFrame) -> DataFrame:
    """(bucket, bits): the bitmap of the (len, head) that several rows share."""
    by_key = stored(heads.groupBy("len", "head").agg(F.count("*").alias("n")))
    lengths = by_key.groupBy("len").agg(F.sum("n").alias("n_len")).where("n_len > 1").select("len")
    keys = by_key.where("n > 1").join(lengths, "len", "left_semi").select(_slot().alias("slot"))
    # the bucket of every bit, then its place in it
    return stored(keys.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")))


def _slot():
    return F.pmod(F.xxhash64("len", "head"), F.lit(BUCKETS * 32_768)) + 1


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: id, keep_id, group_size, kept and ``full_hash`` (null where the
    first two levels already tell the row apart). With ``digest`` that column shows
    the hash of every text; of those that are told apart it decides nothing."""
    text = text_or_empty(text_col)
    head = [F.octet_length(text).alias("len"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("head")]
    bitmap = F.broadcast(_surviving(docs.select(*head)))  # BUCKETS rows of 4 KB at most
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), *head)
    rows = rows.withColumn("slot", _slot()).withColumn("bucket", F.expr("bitmap_bucket_number(slot)")).join(bitmap, "bucket", "left")
    place = "cast(bitmap_bit_position(slot) as int)"
    byte = f"conv(hex(substring(bits, {place} div 8 + 1, 1)), 16, 10)"
    survives = F.expr(f"coalesce(cast({byte} as int) & shiftleft(1, {place} % 8), 0) <> 0")
    full = F.sha2("t", 256)
    # rows are numbered as they are written, to tell repeated ones apart
    hashed = stored(rows.select("id", (full if digest else F.when(survives, full)).alias("full_hash"), survives.alias("survives"), F.monotonically_increasing_id().alias("row")))
    shared = hashed.where("survives")
    groups = shared.groupBy("full_hash").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("top")).where("n > 1")
    single = F.col("n").isNull()
    marked = shared.join(stored(groups), "full_hash", "left").select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("top.row"))).alias("kept"),
        "full_hash",
    )
    one = F.lit(1).cast("long").alias("group_size")
    return marked.unionByName(hashed.where("not survives").select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), one, F.lit(True).alias("kept"), "full_hash"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the one
    with the largest id, and one of rows that repeat id and text."""
    marked = stored(refine(docs).where("full_hash is not null").select("doc_id", "full_hash", "kept"))
    return without(docs, marked, "full_hash", F.sha2(text_or_empty(), 256))
