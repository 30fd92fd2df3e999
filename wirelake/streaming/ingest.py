"""Incremental ingestion: new log files become bronze, silver and gold tables.

A file stream lists each file once (its checkpoint remembers them). Every
micro-batch is parsed and written under its batch number, replacing what an
interrupted attempt left there, so a file's rows arrive exactly once. Tables
that aggregate (catalogs, time range) are recomputed from the written ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelake.operators.diagnostics import Reassembler
from wirelake.plans import tables
from wirelake.sources.files import listing, parse_logs


@dataclass
class Definitions:
    can: DataFrame | None = None
    someip: DataFrame | None = None
    enums: DataFrame | None = None
    long_header: bool = False


@dataclass
class Ingestion:
    """``start`` runs the stream; ``table`` reads what it has written."""

    spark: SparkSession
    source: str
    target: str
    definitions: Definitions = field(default_factory=Definitions)
    files_per_batch: int = 1000

    def _path(self, name: str, batch: int | None = None) -> str:
        return f"{self.target.rstrip('/')}/{name}" + ("" if batch is None else f"/batch_id={batch}")

    def _batch(self, files: DataFrame, batch: int) -> None:
        spread = files.repartition("path")
        parse_logs(spread).write.mode("overwrite").parquet(log := self._path("_log", batch))
        rows = self.spark.read.parquet(log)  # each file is parsed once, all tables read from here
        tables.bronze(rows).write.mode("overwrite").parquet(bronze_path := self._path("bronze", batch))
        bronze = self.spark.read.parquet(bronze_path)
        d = self.definitions

        def put(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(path := self._path(name, batch))
            return self.spark.read.parquet(path)

        can, eth = put("silver_can", tables.silver_can(bronze)), put("silver_eth", tables.silver_eth(bronze))
        put("silver_diag", tables.silver_diag(bronze))
        put("silver_mf4_signals", tables.silver_mf4_signals(bronze))
        someip = put("silver_someip", tables.silver_someip(eth))
        eth_signals = put("silver_eth_signals", tables.silver_eth_signals(eth))
        can_signals = someip_signals = None
        if d.can is not None:
            pdus = put("silver_can_container_pdus", tables.silver_container_pdus(can, d.can, d.long_header))
            can_signals = put("silver_can_signals", tables.silver_can_signals(can, d.can, d.enums, pdus))
        if d.someip is not None:
            someip_signals = put("silver_someip_signals", tables.silver_someip_signals(someip, d.someip, d.enums))
        put("gold_signals", tables.gold_signals(can_signals, eth_signals, someip_signals))

    def start(self, once: bool = True, interval: str = "1 minute") -> StreamingQuery:
        """``once`` takes all files there are and ends, else new files are looked
        for every ``interval``."""
        files = listing(self.spark, self.source, stream=True, maxFilesPerTrigger=self.files_per_batch)
        writer = files.writeStream.foreachBatch(self._batch).option("checkpointLocation", self._path("_checkpoint"))
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
        return writer.start()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name)).drop("batch_id")

    def views(self) -> dict[str, DataFrame]:
        gold = self.table("gold_signals")
        return {"signal_catalog": tables.signal_catalog(gold), "signal_catalog_by_file": tables.signal_catalog_by_file(gold), "time_range": tables.time_range(gold), "source_files": tables.source_files(gold)}


def stream_isotp(frames: DataFrame, idle: str | None = None) -> DataFrame:
    """Complete UDS messages of a stream of ISO-TP frames (the columns of
    ``isotp_frames``): a conversation's state lives across micro-batches. Frames
    of a conversation have to arrive in order."""
    out = "_source_file string, channel int, can_id long, timestamp_ns long, uds binary"
    state = "total long, expected int, started long, buf binary"

    def run(key, chunks: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        r = Reassembler()
        if held.exists:
            total, expected, started, buf = held.get
            r = Reassembler(total, expected, None if started < 0 else started, bytearray(buf))
        rows = []
        for part in chunks:
            for f in part.sort_values(["timestamp_ns", "row_in_file"]).itertuples():
                total = None if pd.isna(f.total_length) else int(f.total_length)
                sequence = None if pd.isna(f.sequence) else int(f.sequence)
                if done := r.push(f.kind, total, sequence, bytes(f.payload), int(f.timestamp_ns)):
                    rows.append((*key, *done))
        held.update((r.total, r.expected, -1 if r.started is None else r.started, bytes(r.buf)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in out.split(", ")])

    return frames.groupBy("_source_file", "channel", "can_id").applyInPandasWithState(run, out, state, "append", "NoTimeout")


def late_tolerant(gold: DataFrame, delay: str, window: str) -> DataFrame:
    """Signal counts per window of event time over a stream; rows later than
    ``delay`` are dropped. The engine's own tables need no watermark."""
    counted = gold.withWatermark("event_time", delay).groupBy(F.window("event_time", window), "signal_source", "signal_name")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.avg("signal_value").alias("mean_v"))
