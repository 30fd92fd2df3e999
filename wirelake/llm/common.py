"""Shared helpers: table access, shared-folder tables, term hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where the
    cluster names none, local sessions (tests) fall back to a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = getattr(spark, "_wirelake_root", None)
    if root is None:
        root = spark._wirelake_root = tempfile.mkdtemp(prefix="wirelake-")
        atexit.register(__import__("shutil").rmtree, root, ignore_errors=True)
    return root


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts the
    lineage: what follows doesn't depend on any executor's disk. The tables stay
    until ``release``."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/wirelake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of two 64-bit keys that are broadcast, at most.
MOST_BROADCAST = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast where a count shows that it is bounded; beyond
    that the join is one by exchange, with the same result."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores in front as keep them apart from the
    columns of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, marked: DataFrame, key: str, key_of: Column) -> DataFrame:
    """``docs`` less the rows that ``marked`` (doc_id, key, kept; stored) doesn't
    keep; ``key_of`` gives a row's key. The marks are brought to the texts where
    they are few enough. Of rows that repeat id and key one stays if any does."""
    by_row = stored(marked.groupBy("doc_id", key).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    own, gone_id, gone_key = fresh(docs, "own_key", "gone_id", "gone_key")
    gone = by_row.where("not kept").select(F.col("doc_id").alias(gone_id), F.col(key).alias(gone_key))
    left = docs.withColumn(own, key_of)
    left = left.join(small(gone), F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_key)), "left_anti")
    twice = by_row.where("kept").select(F.col("doc_id").alias(gone_id), F.col(key).alias(gone_key))
    if not twice.isEmpty():
        twice = small(twice)
        same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_key))
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", own]))
    return left.drop(own)


_tables: list[str] = []


def stored_count() -> int:
    """How many tables this process holds."""
    return len(_tables)


def release(spark: SparkSession, since: int = 0, newest: int = 0) -> None:
    """Deletes the tables that this process has stored, from number ``since`` on
    but for the ``newest`` ones; call it once the results that read them are
    written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [_tables.pop(since) for _ in range(len(_tables) - newest - since)]:
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Whole documents travel to the workers; this bounds how many at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_bucket(name: str = "doc_id", n: int = 5) -> Column:
    """crc32(doc_id as text) mod n; a null id falls in bucket n - 1."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % n, F.lit(n - 1))


class TermCache(dict):
    """term -> 64-bit hash, filled on demand and emptied when it holds ``most``
    terms, so that a worker's memory stays bounded on any corpus."""

    def __init__(self, fn, most: int = 100_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, term):
        if len(self) >= self.most:
            self.clear()
        value = self[term] = self.fn(term)
        return value

    def array(self, terms: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, terms), np.uint64, len(terms))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc32_u32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
