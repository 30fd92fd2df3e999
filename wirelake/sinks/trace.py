"""Perfetto traces: counter tracks in the protobuf wire format."""

from __future__ import annotations

import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: field numbers of the trace format
PACKET, TIMESTAMP, CLOCK_SNAPSHOT, SEQUENCE, TRACK_EVENT, CLOCK_ID, TRACK = 1, 8, 6, 10, 11, 58, 60
SNAPSHOT_CLOCK, CLOCK_NUMBER, CLOCK_TIME = 1, 1, 2
TRACK_ID, TRACK_NAME, TRACK_COUNTER, COUNTER_UNIT = 1, 2, 8, 6
EVENT_TYPE, EVENT_TRACK, EVENT_DOUBLE = 9, 11, 44
REALTIME, BOOTTIME, COUNTER = 1, 6, 4


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def number(field: int, value: int) -> bytes:
    return varint(field << 3) + varint(value)


def double(field: int, value: float) -> bytes:
    return varint(field << 3 | 1) + struct.pack("<d", value)


def message(field: int, body: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(body)) + body


class TraceWriter:
    """Writes packets to an open binary file; tracks are declared on first use."""

    def __init__(self, f, realtime_ns: int = 0):
        self.f, self.tracks = f, {}
        clocks = (number(CLOCK_NUMBER, k) + number(CLOCK_TIME, t) for k, t in ((BOOTTIME, 0), (REALTIME, realtime_ns)))
        self._packet(message(CLOCK_SNAPSHOT, b"".join(message(SNAPSHOT_CLOCK, c) for c in clocks)))

    def _packet(self, body: bytes) -> None:
        self.f.write(message(PACKET, body + number(SEQUENCE, 1)))

    def track(self, name: str, unit: str = "") -> int:
        if name not in self.tracks:
            self.tracks[name] = len(self.tracks) + 1
            described = message(TRACK_COUNTER, message(COUNTER_UNIT, unit.encode()) if unit else b"")
            self._packet(message(TRACK, number(TRACK_ID, self.tracks[name]) + message(TRACK_NAME, name.encode()) + described))
        return self.tracks[name]

    def counter(self, name: str, at_ns: int, value: float, unit: str = "") -> None:
        event = number(EVENT_TYPE, COUNTER) + number(EVENT_TRACK, self.track(name, unit)) + double(EVENT_DOUBLE, value)
        self._packet(number(TIMESTAMP, at_ns) + number(CLOCK_ID, BOOTTIME) + message(TRACK_EVENT, event))


def _write(path: str, rows: Iterable, realtime_ns: int, first: Iterable[str] = ()) -> int:
    n = 0
    with open(path, "wb") as f:
        w = TraceWriter(f, realtime_ns)
        for name in first:
            w.track(name)
        for r in rows:
            w.counter(r["track"], r["at_ns"], r["value"], r["unit"] or "")
            n += 1
    return n


def write_log_trace(signals: DataFrame, path: str, start_ns: int = 0) -> int:
    """Decoded signals (signal_name, signal_value) and samples (mf4_*) of a log as
    a trace with one track per signal. Rows stream through the driver."""
    have = set(signals.columns)
    track = F.col("signal_name") if "signal_name" in have else F.lit(None).cast("string")
    value = F.col("signal_value") if "signal_value" in have else F.lit(None).cast("double")
    unit = F.lit(None).cast("string")
    if "mf4_name" in have:
        sample = F.when(F.coalesce("mf4_group", F.lit("")) == "", F.col("mf4_name")).otherwise(F.concat_ws("/", "mf4_group", "mf4_name"))
        track, value, unit = F.coalesce(track, sample), F.coalesce(value, F.col("mf4_value")), F.col("mf4_unit")
    rows = signals.select(track.alias("track"), F.col("timestamp_ns").alias("at_ns"), value.alias("value"), unit.alias("unit")).where("track is not null and value is not null")
    return _write(path, rows.orderBy("at_ns", "track").toLocalIterator(), start_ns)


def write_selection_trace(samples: DataFrame, keys: list[tuple[str, int, str]], path: str) -> int:
    """Chosen gold signals, from the first one on; the clock is anchored to its
    wall-clock time where known."""
    from wirelake.plans.viewer import any_key

    chosen = samples.where(any_key(keys)).where("signal_value is not null")
    head = chosen.agg(F.min("timestamp_ns").alias("t"), F.min_by(F.unix_micros(F.col("event_time").cast("timestamp")), "timestamp_ns").alias("w")).first()
    if head["t"] is None:
        return 0
    track = F.concat("signal_source", F.col("channel").cast("string"), F.lit("::"), "signal_name")
    rows = chosen.select(track.alias("track"), (F.col("timestamp_ns") - head["t"]).alias("at_ns"), F.col("signal_value").alias("value"), F.lit(None).cast("string").alias("unit"))
    tracks = [f"{s}{c}::{n}" for s, c, n in keys]
    return _write(path, rows.orderBy("at_ns", "track").toLocalIterator(), head["w"] * 1000 if head["w"] is not None else head["t"], tracks)
