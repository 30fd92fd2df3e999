"""Log files from log rows: one ordered group per file, written where it lies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.schema import LOG_COLUMNS, names
from wirelake.sources import blf, mdf4


def _write(log: DataFrame, folder: str, suffix: str, writer, order: list[str]) -> DataFrame:
    """Writes each ``_source_file`` of ``log`` to ``folder`` under its stem;
    (path, rows) of the files written. Rows stream to the writer in order. The
    folder is one that all executors mount: the formats' headers are patched last."""
    if "://" in folder.removeprefix("file://"):
        raise ValueError(f"{folder} is no folder that the executors mount")
    target = folder.removeprefix("file://").removeprefix("file:").rstrip("/")
    columns = ["_source_file", "start_ns", *names(LOG_COLUMNS)]

    def run(batches):
        key = handle = w = path = None
        n, done = 0, []
        for b in batches:
            for row in b.to_pylist():
                if row["_source_file"] != key:
                    if w is not None:
                        w.close()
                        handle.close()
                        done.append((path, n))
                    key, n = row["_source_file"], 0
                    path = f"{target}/{key.rsplit('/', 1)[-1].rsplit('.', 1)[0]}{suffix}"
                    handle = open(path, "w+b")
                    w = writer(handle, row["start_ns"] or 0)
                w.write(row)
                n += 1
        if w is not None:
            w.close()
            handle.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "rows"])

    rows = log.select(*columns, *(c for c in order if c not in columns))
    ordered = rows.repartition("_source_file").sortWithinPartitions("_source_file", *order)
    return ordered.mapInArrow(run, "path string, rows long")


def write_blf(log: DataFrame, folder: str) -> DataFrame:
    order = ["timestamp_ns", *(["row_in_file"] if "row_in_file" in log.columns else [])]
    return _write(log.where("message_type <> 'MF4_SIGNAL'"), folder, ".blf", blf.Writer, order)


def write_mdf4(log: DataFrame, folder: str) -> DataFrame:
    return _write(log, folder, ".mf4", mdf4.Writer, ["timestamp_ns"])


def repeat(log: DataFrame, times: int) -> DataFrame:
    """The rows of each file, several times over."""
    if times < 1:
        raise ValueError("times has to be 1 or more")
    return log.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__k")
