"""The registered queries: each applies one operator to its whole table and
derives the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_blocks, packing, pii, probminhash, quality, secrets, sentencepiece_sa, simhash, token_hist
from .common import crc_bucket, small_batches, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_bucket() == 0).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: for ids divisible by 100, how many other
    documents have a fingerprint within the radius (null for other ids)."""
    small_batches(spark)
    rows = simhash.edited_neighbours(table(spark, sf_dir, "documents"))
    prints = rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = rows.where("doc_id % 100 = 0").select("fingerprint")
    near = simhash.within_radius(prints, asked).join(prints, "fingerprint").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    asks = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    answered = rows.where(asks).join(near, F.col("fingerprint") == F.col("query"), "left").drop("query")
    return answered.unionByName(rows.where(~asks).withColumn("n_near", F.lit(None).cast("long")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups come from the three levels; the digest of the texts that the first
    two tell apart is only shown."""
    return exact_dedup.refine(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("full_hash", "text_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to."""
    small_batches(spark)
    return sentencepiece_sa.digests(sentencepiece_sa.encode(table(spark, sf_dir, "documents")))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_hist.suffix_sums(token_hist.lengths(table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return probminhash.classes(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash, op3_exact_dedup, op4_sentencepiece, op5_html, op6_token_counts, op7_pii, op8_secrets, op9_packing, op10_probminhash)}

ORACLE = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g
                 AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
