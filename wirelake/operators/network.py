"""Ethernet payloads: IP, TCP, UDP, ARP and IGMP headers, SOME/IP and DoIP.

Workers stack the first bytes of a batch's payloads into a matrix and read all
header fields of all rows at once with numpy; messages that repeat within a
payload (SOME/IP, DoIP) are read one a pass in all payloads at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions.names import ARP_OPS, IGMP_TYPES, SOMEIP_TYPES, named

from .decode import big_endian, flat, sliced, stacked

TCP, UDP, IGMP = 6, 17, 2
IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
HEAD = 128  # two headers at their longest


def _spark_type(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


@dataclass
class Headers:
    """Header fields by row; ``version`` is 0 without a complete IP packet,
    ``kind`` 0 without a complete TCP or UDP header. ``at`` and ``size`` locate
    the transport's payload (the packet's, where kind is 0) in the frame's."""

    bytes: np.ndarray
    length: np.ndarray
    version: np.ndarray
    protocol: np.ndarray
    ttl: np.ndarray
    total: np.ndarray
    kind: np.ndarray
    src_port: np.ndarray
    dst_port: np.ndarray
    flags: np.ndarray
    packet_at: np.ndarray
    packet_size: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def u16(self, offset) -> np.ndarray:
        return _u16(self.bytes, offset)

    def address(self, row: int, source: bool) -> str:
        b = self.bytes[row]
        if self.version[row] == 4:
            return ".".join(map(str, b[12:16] if source else b[16:20]))
        part = bytes(b[8:24] if source else b[24:40]).hex()
        return ":".join(part[i : i + 4] for i in range(0, 32, 4))


def _u8(m: np.ndarray, offset) -> np.ndarray:
    at = np.broadcast_to(np.asarray(offset), (len(m),))
    return m[np.arange(len(m)), np.clip(at, 0, m.shape[1] - 1)].astype(np.int64)


def _u16(m: np.ndarray, offset) -> np.ndarray:
    return _u8(m, offset) << 8 | _u8(m, np.asarray(offset) + 1)


def headers(data: pa.Array, ether_type: np.ndarray) -> Headers:
    m, length = stacked(data, np.arange(len(data)), HEAD)
    head = _u8(m, 0)
    ihl = (head & 15) * 4
    total = _u16(m, 2)
    size4, size6 = np.maximum(total - ihl, 0), _u16(m, 4)
    v4 = (ether_type == IPV4) & (head >> 4 == 4) & (ihl >= 20) & (length >= ihl + size4) & (length >= 20)
    v6 = (ether_type == IPV6) & (head >> 4 == 6) & (length >= 40 + size6)
    version = np.where(v4, 4, np.where(v6, 6, 0))
    protocol, ttl = np.where(v4, _u8(m, 9), _u8(m, 6)), np.where(v4, _u8(m, 8), _u8(m, 7))
    at, size = np.where(v4, ihl, 40), np.where(v4, size4, size6)
    offset = (_u8(m, at + 12) >> 4) * 4
    tcp = (version > 0) & (protocol == TCP) & (size >= 20) & (offset >= 20) & (size >= offset)
    body = np.maximum(_u16(m, at + 4) - 8, 0)
    udp = (version > 0) & (protocol == UDP) & (size >= 8) & (size >= 8 + body)
    kind = np.where(tcp, TCP, np.where(udp, UDP, 0))
    return Headers(
        m, length, version, protocol, ttl, total, kind, _u16(m, at), _u16(m, at + 2), _u8(m, at + 13) & 63, at, size,
        at + np.where(tcp, offset, np.where(udp, 8, 0)), np.where(tcp, size - offset, np.where(udp, body, size)),
    )


def signal_rows(b: pa.RecordBatch, kept: list[str]) -> pa.RecordBatch:
    """The header fields of a batch's frames as signals, beside ``kept`` columns."""
    h = headers(b.column("data"), b.column("ether_type").to_numpy(zero_copy_only=False))
    index, names, values, texts = [], [], [], []

    def number(where: np.ndarray, name: str, value: np.ndarray) -> None:
        rows = np.flatnonzero(where)
        index.append(rows)
        names.append((name, len(rows)))
        values.append(pa.array(value[rows].astype(np.float64)))
        texts.append(pa.nulls(len(rows), pa.string()))

    def text(where: np.ndarray, name: str, value) -> None:
        rows = np.flatnonzero(where)
        index.append(rows)
        names.append((name, len(rows)))
        values.append(pa.nulls(len(rows), pa.float64()))
        texts.append(pa.array([value(r) for r in rows.tolist()], pa.string()))

    def dotted(at: int):
        return lambda r: ".".join(map(str, h.bytes[r, at : at + 4]))

    m = h.bytes
    arp = (b.column("ether_type").to_numpy(zero_copy_only=False) == ARP) & (h.length >= 28) & (h.u16(0) == 1) & (h.u16(2) == IPV4) & (m[:, 4] == 6) & (m[:, 5] == 4)
    op = h.u16(6)
    number(arp, "arp.op", op)
    text(arp, "arp.op_name", lambda r: ARP_OPS.get(int(op[r]), "Other"))
    text(arp, "arp.sender_ip", dotted(14))
    text(arp, "arp.target_ip", dotted(24))
    four, six = h.version == 4, h.version == 6
    number(four | six, "ip.protocol", h.protocol)
    number(four, "ip.ttl", h.ttl)
    number(six, "ip.hop_limit", h.ttl)
    number(four, "ip.total_len", h.total)
    text(four | six, "ip.src", lambda r: h.address(r, True))
    text(four | six, "ip.dst", lambda r: h.address(r, False))
    for kind, name in ((TCP, "tcp"), (UDP, "udp")):
        number(h.kind == kind, f"{name}.src_port", h.src_port)
        number(h.kind == kind, f"{name}.dst_port", h.dst_port)
    number(h.kind == TCP, "tcp.flags", h.flags)
    number(h.kind == UDP, "udp.payload_bytes", h.size)
    igmp = four & (h.protocol == IGMP) & (h.packet_size >= 8)
    code = _u8(m, h.packet_at)
    number(igmp, "igmp.type", code)
    text(igmp, "igmp.type_name", lambda r: IGMP_TYPES.get(int(code[r]), "Other"))
    text(igmp, "igmp.group", lambda r: ".".join(map(str, m[r, h.packet_at[r] + 4 : h.packet_at[r] + 8])))
    number(igmp, "igmp.max_resp_time", _u8(m, h.packet_at + 1))
    at = np.concatenate(index)
    order = np.argsort(at, kind="stable")  # frame by frame
    label = np.repeat(np.arange(len(names)), [n for _, n in names])[order].astype(np.int32)
    take = pa.array(order)
    return pa.RecordBatch.from_arrays(
        [*(b.column(c).take(pa.array(at[order])) for c in kept), pa.DictionaryArray.from_arrays(pa.array(label), pa.array([x for x, _ in names])).cast(pa.string()), pa.concat_arrays(values).take(take), pa.concat_arrays(texts).take(take)],
        names=[*kept, "signal_name", "signal_value", "signal_str"],
    )


def eth_signals(eth: DataFrame, drop: tuple[str, ...] = ("data",)) -> DataFrame:
    """One row per header field: signal_name, signal_value, signal_str."""
    kept = [c for c in eth.columns if c not in drop]

    def run(batches):
        for b in batches:
            yield signal_rows(b, kept)

    parsed = eth.where(F.col("data").isNotNull() & F.col("ether_type").isin(IPV4, IPV6, ARP))
    return parsed.mapInArrow(run, f"{_spark_type(eth, kept)}, signal_name string, signal_value double, signal_str string")


@dataclass
class Found:
    """Messages of a batch: the frame each lies in, its fields by column, and
    where its payload starts and how long it is."""

    frame: np.ndarray
    fields: list[np.ndarray]
    start: np.ndarray
    size: np.ndarray


def _advance(data: np.ndarray, frame: np.ndarray, at: np.ndarray, end: np.ndarray, head: int, step) -> Found:
    """Reads messages of ``head`` bytes and more, one a pass in all frames at
    once. ``step`` (at, end) gives whether a message is sound, where it ends, the
    fields to keep, its payload's start and size, and whether it is wanted."""
    passes = []
    while len(frame := frame[live := at + head <= end]):
        at, end = at[live], end[live]
        sound, after, fields, start, size, wanted = step(at, end)
        keep = sound & wanted
        passes.append([x[keep] for x in (frame, start, size, *fields)])
        frame, at, end = frame[sound], after[sound], end[sound]
    if not passes:
        _, _, fields, start, size, _ = step(at[:0], end[:0])
        passes.append([frame[:0], start, size, *fields])
    columns = [np.concatenate(x) for x in zip(*passes)]
    order = np.argsort(columns[0], kind="stable")
    frame, start, size, *fields = (c[order] for c in columns)
    return Found(frame, fields, start, size)


def _messages(eth: DataFrame, kept: list[str], accept, find, fields: str, ends: bool = False) -> DataFrame:
    """One row per message that ``find`` (data, frames, starts, ends) reads from
    the transport payloads of the frames that ``accept`` (Headers -> mask) takes:
    its integer fields, then its payload; ``ends`` adds the addresses."""
    names = [x.split()[0] for x in fields.split(", ")]
    extra = ["src_ip", "dst_ip", "udp_src_port", "udp_dst_port"] if ends else []

    def run(batches):
        for b in batches:
            column = b.column("data")
            column = column if column.type == pa.binary() else column.cast(pa.binary())
            h = headers(column, b.column("ether_type").to_numpy(zero_copy_only=False))
            data, offsets = flat(column)
            frame = np.flatnonzero(accept(h))
            at = offsets[frame] + h.at[frame]
            m = find(data, frame, at, np.minimum(at + h.size[frame], offsets[frame + 1]))
            take = pa.array(m.frame)
            both = []
            if ends:
                each, back = np.unique(m.frame, return_inverse=True)
                back = pa.array(back)
                both = [pa.array([h.address(i, source) for i in each.tolist()], pa.string()).take(back) for source in (True, False)]
                both += [pa.array(p[m.frame].astype(np.int32)) for p in (h.src_port, h.dst_port)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in kept), *both, *(pa.array(f.astype(np.int32)) for f in m.fields), sliced(data, m.start, m.size)], names=[*kept, *extra, *names])

    packets = eth.where(F.col("data").isNotNull() & F.col("ether_type").isin(IPV4, IPV6))
    added = "src_ip string, dst_ip string, udp_src_port int, udp_dst_port int, " if ends else ""
    return packets.mapInArrow(run, f"{_spark_type(eth, kept)}, {added}{fields}")


SERVED_TYPES = (0x00, 0x01, 0x02, 0x80, 0x81)
SOMEIP_FIELDS = "someip_service_id int, someip_method_id int, someip_length int, someip_client_id int, someip_session_id int, someip_protocol_version int, someip_interface_version int, someip_msg_type int, someip_return_code int, payload binary"


def someip_messages(data: bytes) -> list[tuple]:
    """Header fields and payloads of back-to-back messages, up to the first
    broken header; each says whether it is served (no discovery, version 1,
    request, notification, response or error)."""
    out, at = [], 0
    while at + 16 <= len(data):
        length = int.from_bytes(data[at + 4 : at + 8], "big")
        end = at + 8 + length
        if length < 8 or end > len(data):
            break
        service, method, client, session = (int.from_bytes(data[at + o : at + o + 2], "big") for o in (0, 2, 8, 10))
        version, interface, kind, code = data[at + 12 : at + 16]
        out.append((service, method, length, client, session, version, interface, kind, code, data[at + 16 : end]))
        at = end
    return out


def served(m: tuple) -> bool:
    return not (m[0] == 0xFFFF and m[1] == 0x8100) and m[5] == 1 and m[7] in SERVED_TYPES


def find_someip(data: np.ndarray, frame: np.ndarray, at: np.ndarray, end: np.ndarray, served_only: bool = True) -> Found:
    """``someip_messages`` of many payloads; of those ``served`` unless told."""

    def step(at, end):
        length = big_endian(data, at + 4, 4)
        service, method, client, session = (big_endian(data, at + o, 2) for o in (0, 2, 8, 10))
        version, interface, kind, code = (data[at + o].astype(np.int64) for o in (12, 13, 14, 15))
        sound = (length >= 8) & (at + 8 + length <= end)
        wanted = ~((service == 0xFFFF) & (method == 0x8100)) & (version == 1) & np.isin(kind, SERVED_TYPES) | (not served_only)
        return sound, at + 8 + length, [service, method, length, client, session, version, interface, kind, code], at + 16, length - 8, wanted

    return _advance(data, frame, at, end, 16, step)


def parse_someip(eth: DataFrame, first_only: bool = False, drop: tuple[str, ...] = ("data",)) -> DataFrame:
    """One row per SOME/IP message in UDP payloads. ``first_only`` is the looser
    reading of the command line: UDP or TCP, the first message, unfiltered."""
    kept = [c for c in eth.columns if c not in drop]

    def find(data, frame, at, end):
        m = find_someip(data, frame, at, end, not first_only)
        if not first_only:
            return m
        first = np.unique(m.frame, return_index=True)[1]
        return Found(m.frame[first], [f[first] for f in m.fields], m.start[first], m.size[first])

    return _messages(eth, kept, lambda h: (h.kind > 0) if first_only else h.kind == UDP, find, SOMEIP_FIELDS, ends=True)


DOIP_PORT = 13400


def doip_diag(data: bytes) -> list[tuple[int, int, bytes]]:
    """(source, target, uds) of the diagnostic messages in a TCP segment."""
    out, at = [], 0
    while at + 8 <= len(data):
        length = int.from_bytes(data[at + 4 : at + 8], "big")
        if data[at] ^ data[at + 1] != 0xFF or at + 8 + length > len(data):
            break
        if data[at + 2 : at + 4] == b"\x80\x01" and length >= 4:
            body = data[at + 8 : at + 8 + length]
            out.append((int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big"), body[4:]))
        at += 8 + length
    return out


def find_doip(data: np.ndarray, frame: np.ndarray, at: np.ndarray, end: np.ndarray) -> Found:
    """``doip_diag`` of many segments."""

    def step(at, end):
        length = big_endian(data, at + 4, 4)
        sound = (data[at] ^ data[at + 1] == 0xFF) & (at + 8 + length <= end)
        wanted = (big_endian(data, at + 2, 2) == 0x8001) & (length >= 4)
        inside = np.where(sound & wanted, at + 8, at)  # addresses are read where there are any
        return sound, at + 8 + length, [big_endian(data, inside, 2), big_endian(data, inside + 2, 2)], at + 12, length - 4, wanted

    return _advance(data, frame, at, end, 8, step)


def parse_doip(eth: DataFrame, drop: tuple[str, ...] = ("data",)) -> DataFrame:
    """One row per DoIP diagnostic message over TCP port 13400: doip_src_addr,
    doip_target_addr, uds."""
    kept = [c for c in eth.columns if c not in drop]
    return _messages(eth, kept, lambda h: (h.kind == TCP) & ((h.src_port == DOIP_PORT) | (h.dst_port == DOIP_PORT)), find_doip, "doip_src_addr int, doip_target_addr int, uds binary")


def someip_type_name(code) -> Column:
    return named(code, SOMEIP_TYPES, "Unknown")
