"""The corpus pipeline: documents pass the stages in turn.

Each stage is written as Parquet to the shared folder and read again as the
next one's input, so a lost executor repeats at most the stage that runs. What a
stage has stored on its way is deleted once its result is written; the last
stage's input stays until ``wirelake.llm.common.release``.

Cases, for all stages: null texts equal empty ones; they stay or go as empty
texts do, and a null that stays stays null. Rows with a null id take part as any
other. Of repeated rows one stays (exact dedup). Texts of any length are read
whole. Ties: of equal or near-equal texts the largest doc_id stays. An empty
table passes as an empty table. Columns beyond those of ``documents`` are kept up
to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm import exact_dedup, packing, pii, probminhash, quality
from wirelake.llm.common import fresh, release, small_batches, stored, stored_count, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "quality_score")
    return quality.score(docs, model, name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one stays."""
    small_batches(spark)
    return probminhash.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what reveals it are generalised in the texts."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' ids, packed into sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The classifier, the near-duplicate classes and the tokenizer are beyond SQL;
#: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), stored_count()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        release(spark, since=before, newest=1)
    return STAGES[-1][1](spark, docs, sf_dir)
