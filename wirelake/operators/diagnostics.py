"""UDS diagnostics over ISO-TP and DoIP."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions.bytes import is_diagnostic, tail, u8, u16, u32
from wirelake.functions.names import uds_nrc, uds_service

from .network import parse_doip

NEGATIVE, POSITIVE_BIT = 0x7F, 0x40


def with_uds_fields(df: DataFrame, payload: str) -> DataFrame:
    """Adds uds_type, service_id, service_name, nrc, nrc_name and data (what
    follows the service id); malformed payloads go."""
    sid = u8(payload, 0)
    negative, positive = sid == NEGATIVE, sid.bitwiseAND(F.lit(POSITIVE_BIT)) != 0
    out = df.where((F.length(payload) >= 1) & (~negative | (F.length(payload) >= 3)))
    service = F.when(negative, u8(payload, 1)).when(positive, sid.bitwiseAND(F.lit(0xBF))).otherwise(sid)
    nrc = F.when(negative, u8(payload, 2))
    out = out.withColumns({"uds_type": F.when(negative, "NegativeResponse").when(positive, "PositiveResponse").otherwise("Request"), "service_id": service, "nrc": nrc})
    return out.withColumns({"service_name": uds_service("service_id"), "nrc_name": uds_nrc("nrc"), "data": F.when(negative, F.lit(b"")).otherwise(tail(payload, 1))})


def isotp_frame(data: str = "data") -> Column:
    """struct(kind, total_length, sequence, payload) of one frame, kinds SF, FF,
    CF and FC; NULL where malformed."""
    d = F.col(data)
    head = u8(d, 0)
    low = head.bitwiseAND(F.lit(15))
    short = F.when(low == 0, u8(d, 1)).otherwise(low)
    at = F.when(low == 0, 2).otherwise(1)
    twelve = u16(d, 0).bitwiseAND(F.lit(0xFFF))
    long_head = twelve == 0
    none = F.lit(None)

    def frame(kind: str, total, sequence, payload) -> Column:
        return F.struct(F.lit(kind).alias("kind"), total.cast("long").alias("total_length"), sequence.cast("int").alias("sequence"), payload.cast("binary").alias("payload"))

    kind = F.shiftright(head, 4)
    return (
        F.when((kind == 0) & (F.length(d) >= at + short), frame("SF", short, none, F.substr(d, at + 1, short)))
        .when((kind == 1) & (F.length(d) >= F.when(long_head, 6).otherwise(2)), frame("FF", F.when(long_head, u32(d, 2)).otherwise(twelve.cast("long")), none, tail(d, F.when(long_head, 6).otherwise(2))))
        .when(kind == 2, frame("CF", none, low, tail(d, 1)))
        .when((kind == 3) & (F.length(d) >= 3), frame("FC", none, low, tail(d, 1)))
    )


@dataclass
class Reassembler:
    """State of one conversation. ``push`` takes a frame's fields and its time and
    gives (time, message) when one is complete. Single and first frames start
    anew, a wrong sequence number drops the message, flow control is ignored.
    A message of several frames has the time of the last first frame seen."""

    total: int = 0
    expected: int = 0
    started: int | None = None
    buf: bytearray = field(default_factory=bytearray)

    def push(self, kind: str, total: int | None, sequence: int | None, payload: bytes, stamp: int):
        if kind == "SF":
            self.total, self.buf = 0, bytearray()
            return stamp, payload
        if kind == "FF":
            self.total, self.expected, self.started, self.buf = total, 1, stamp, bytearray(payload)
        elif kind == "CF" and self.total:
            if sequence != self.expected:
                self.total, self.buf = 0, bytearray()
                return None
            self.expected = (self.expected + 1) & 15
            self.buf += payload[: max(0, self.total - len(self.buf))]
            if len(self.buf) >= self.total:
                message, self.total, self.buf = bytes(self.buf), 0, bytearray()
                return (stamp if self.started is None else self.started), message
        return None


CONVERSATION = ["_source_file", "channel", "can_id"]


def isotp_frames(log: DataFrame) -> DataFrame:
    """The well-formed ISO-TP frames on diagnostic ids, ready for reassembly.
    First frames that are malformed still set a message's time."""
    can = log.where(F.col("message_type").isin("CAN", "CAN_FD", "CAN_FD64") & is_diagnostic("can_id") & (F.length("data") > 0))
    return can.withColumn("frame", isotp_frame()).where("frame is not null").select(*CONVERSATION, "timestamp_ns", "row_in_file", "dir", "start_ns", "frame.*")


def reassemble_isotp(log: DataFrame) -> DataFrame:
    """One row per complete message: the conversation, its time, direction and
    ``uds``. Each conversation of each file is read in order; a group streams
    through its task batch by batch."""
    schema = "_source_file string, channel int, can_id long, timestamp_ns long, row_in_file long, dir byte, start_ns long, uds binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        key, state = None, Reassembler()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if (now := tuple(r[k] for k in CONVERSATION)) != key:
                    key, state = now, Reassembler()
                if done := state.push(r["kind"], r["total_length"], r["sequence"], r["payload"], r["timestamp_ns"]):
                    rows.append((*key, done[0], r["row_in_file"], r["dir"], r["start_ns"], done[1]))
            columns = list(zip(*rows)) or [()] * len(names)
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    order = [*CONVERSATION, "timestamp_ns", "row_in_file"]
    return isotp_frames(log).repartition(*CONVERSATION).sortWithinPartitions(*order).mapInArrow(run, schema)


def uds_rows(log: DataFrame) -> DataFrame:
    """UDS_CAN and UDS_DOIP rows of a log: _source_file, start_ns, timestamp_ns,
    row_in_file, message_type, channel, can_id, dir, data and the UDS columns."""
    shared = ["_source_file", "start_ns", "timestamp_ns", "row_in_file", "message_type", "channel", "can_id", "dir", "data", "transport", "doip_src_addr", "doip_target_addr", "uds_type", "service_id", "service_name", "nrc", "nrc_name"]
    none = F.lit(None)
    can = with_uds_fields(reassemble_isotp(log), "uds").withColumns({"message_type": F.lit("UDS_CAN"), "transport": F.lit("CAN"), "doip_src_addr": none.cast("int"), "doip_target_addr": none.cast("int")})
    eth = log.where(F.col("message_type").isin("ETH", "ETH_EX")).select("_source_file", "start_ns", "timestamp_ns", "row_in_file", "channel", "dir", "ether_type", "data")
    doip = with_uds_fields(parse_doip(eth), "uds").withColumns({"message_type": F.lit("UDS_DOIP"), "transport": F.lit("DOIP"), "can_id": none.cast("long")})
    return can.select(*shared).unionByName(doip.select(*shared))
