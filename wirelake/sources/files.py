"""File listings and the log reader that batch and streaming ingestion share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.schema import SOURCE_ROWS, names

from . import blf, mdf4

LISTING = "path string, modificationTime timestamp, length long, content binary"
LOG_GLOB, VIDEO_GLOB = "*.{blf,mf4,mdf}", "*.{mp4,webm,mov}"


def listing(spark: SparkSession, path: str, glob: str = LOG_GLOB, stream: bool = False, recursive: bool = True, **options) -> DataFrame:
    """(path, modificationTime, length) of files; their contents are not read."""
    reader = (spark.readStream.schema(LISTING) if stream else spark.read).format("binaryFile").option("pathGlobFilter", glob)
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path).select("path", "modificationTime", "length")


def parse_logs(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The rows of all listed logs, with the files' metadata, some rows at a
    time. What can't be read of a file is reported; rows read before stay."""
    wanted = frozenset(types) if types else None

    def run(batches):
        for b in batches:
            for f in b.to_pylist():
                path, row = f["path"], 0
                try:
                    if path.lower().endswith(".blf"):
                        parts = blf.read_batches(path, wanted)
                    else:
                        parts = ((start, x) for start, _, x in mdf4.read_batches(path, wanted))
                    for start_ns, x in parts:
                        rows = blf.with_file(x, path, start_ns, row)
                        row += x.num_rows
                        n = rows.num_rows
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([f["modificationTime"]] * n, pa.timestamp("us", "UTC")), pa.array([f["length"]] * n, pa.int64())], names=[*names(SOURCE_ROWS), "_file_mtime", "_file_size_bytes"])
                except Exception as e:  # noqa: BLE001
                    print(f"{path} not read: {e}")

    return files.select("path", "modificationTime", "length").mapInArrow(run, f"{SOURCE_ROWS}, _file_mtime timestamp, _file_size_bytes long")


def read_logs(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """All logs below a path, of either format, one task per file."""
    files = listing(spark, path)
    n = files.count()
    return parse_logs(files.repartition(max(1, n), F.col("path")), types)


def videos(spark: SparkSession, path: str | None, stream: bool = False) -> DataFrame:
    """Video files; empty where no path is set."""
    from wirelake.plans.tables import video_files

    if not path:
        return video_files(spark.createDataFrame([], "path string, modificationTime timestamp, length long"))
    return video_files(listing(spark, path, VIDEO_GLOB, stream))
