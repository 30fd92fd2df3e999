"""Single-message and single-file access: the same decoding without Spark.

For notebooks and tests that hold one frame or one small file in hand; tables
go through ``sources``, ``operators`` and ``plans``.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from wirelake.functions.names import UDS_NRCS, UDS_SERVICES
from wirelake.operators import decode, network
from wirelake.operators.diagnostics import Reassembler
from wirelake.schema import LOG_COLUMNS, names
from wirelake.sources import blf, mdf4

#: names of message types as given to ``Reader``
TYPE_NAMES = {"can": "CAN", "canfd": "CAN_FD", "canfd64": "CAN_FD64", "ethernet": "ETH", "ethernetex": "ETH_EX", "mf4signal": "MF4_SIGNAL", "other": "OTHER"}


class Reader:
    """Iterates over the messages of a log file as dicts of the log columns;
    ``read_batch`` gives columns instead."""

    def __init__(self, path: str, types: list[str] | None = None):
        unknown = [t for t in types or () if t.lower() not in TYPE_NAMES]
        if unknown:
            raise ValueError(f"unknown message types: {unknown}")
        wanted = frozenset(TYPE_NAMES[t.lower()] for t in types) if types else None
        if path.lower().endswith(".blf"):
            with blf.open_file(path) as f:
                self._start = blf.FileHeader.read(f.read(144)).start_ns
            self._batches = (b for _, b in blf.read_batches(path, wanted))
        else:
            with blf.open_file(path) as f:
                self._start = mdf4.read_index(mdf4.File(f))[0]
            self._batches = (b for _, _, b in mdf4.read_batches(path, wanted))
        self._rows: Iterator[dict] = (r for b in self._batches for r in b.to_pylist())

    def start_time_ns(self) -> int:
        return self._start

    def __iter__(self) -> Iterator[dict]:
        return self

    def __next__(self) -> dict:
        return next(self._rows)

    def read_batch(self, n: int = 50_000) -> dict[str, list] | None:
        """Up to n messages by column; None at the end."""
        rows = list(islice(self._rows, n))
        return {c: [r[c] for r in rows] for c in names(LOG_COLUMNS)} if rows else None


def _number(text: str) -> int:
    return int(text, 16) if text[:2].lower() == "0x" else int(text)


def _csv_rows(path: str, key: str) -> Iterator[tuple[int, list[str]]]:
    with blf.open_file(path) as f:
        text = f.read().decode()
    for line, raw in enumerate(text.splitlines(), 1):
        raw = raw.strip()
        if raw and not raw.startswith(("#", key)):
            yield line, [x.strip() for x in next(csv.reader(io.StringIO(raw)))]


def _enums(path: str | None) -> dict[str, dict[int, str]]:
    out: dict[str, dict[int, str]] = {}
    for _, (name, raw, category, *_) in _csv_rows(path, "signal_name") if path else ():
        out.setdefault(name, {})[_number(raw)] = category
    return out


class _SignalDb:
    """Signal definitions by key, from rows (key, name, start byte, start bit,
    length, order, signed, scale, offset)."""

    def __init__(self, enum_path: str | None):
        self.plan: dict[tuple, list[decode.Signal]] = {}
        self.enums = _enums(enum_path)

    def _add(self, key: tuple, p: list[str]) -> None:
        order, sign = p[4].lower(), p[5].lower()
        if order not in ("intel", "motorola") or sign not in ("true", "false", "1", "0"):
            raise ValueError(f"bad byte order or sign: {p}")
        s = decode.compile_signal(p[0], _number(p[1]) * 8 + _number(p[2]), _number(p[3]), order, sign in ("true", "1"), float(p[6] or 1), float(p[7] or 0))
        if s:
            self.plan.setdefault(key, []).append(s)

    def __len__(self) -> int:
        return sum(map(len, self.plan.values()))

    def _decode(self, key: tuple, data: bytes) -> list[tuple[str, float, str | None]]:
        out = []
        for s in self.plan.get(key, ()):
            if len(data) >= s.reach:
                raw = decode.raw_values(s, np.frombuffer(data.ljust(1, b"\0"), np.uint8).reshape(1, -1))
                out.append((s.name, float(decode.physical(s, raw)[0]), self.enums.get(s.name, {}).get(int(raw[0]))))
        return out


class CanSignalDb(_SignalDb):
    def __init__(self, path: str | None = None, enum_path: str | None = None, rows: Iterable[list[str]] = ()):
        super().__init__(enum_path)
        for line, p in [*(_csv_rows(path, "message_id") if path else ()), *enumerate(rows, 1)]:
            if len(p) < 9:
                raise ValueError(f"line {line}: expected at least 9 columns, got {len(p)}")
            try:
                pdu = _number(p[9]) if len(p) > 9 and p[9] else None
                self._add((_number(p[0]), pdu), p[1:9])
            except ValueError as e:
                raise ValueError(f"line {line}: {e}") from e

    @classmethod
    def from_rows(cls, rows: Iterable[list[str]]) -> CanSignalDb:
        return cls(rows=rows)

    def container_can_ids(self) -> list[int]:
        return sorted({i for i, pdu in self.plan if pdu is not None})

    def is_container(self, message_id: int) -> bool:
        return any(i == message_id and pdu is not None for i, pdu in self.plan)

    def decode(self, message_id: int, data: bytes):
        return self._decode((message_id, None), data)

    def decode_pdu(self, can_id: int, pdu_id: int, data: bytes):
        return self._decode((can_id, pdu_id), data)

    def extract_container_pdus(self, message_id: int, data: bytes, long_header: bool = False) -> list[tuple[int, bytes]]:
        return decode.split_pdus(data, long_header) if self.is_container(message_id) else []

    def decode_container(self, message_id: int, data: bytes, long_header: bool = False):
        return [s for pdu, payload in self.extract_container_pdus(message_id, data, long_header) for s in self.decode_pdu(message_id, pdu, payload)]

    def merge(self, overlay: CanSignalDb) -> None:
        """The overlay's signals replace those of one name and key."""
        for key, signals in overlay.plan.items():
            named = {s.name for s in signals}
            self.plan[key] = [s for s in self.plan.get(key, ()) if s.name not in named] + signals


class SomeIpSignalDb(_SignalDb):
    def __init__(self, path: str | None = None, enum_path: str | None = None, rows: Iterable[list[str]] = ()):
        super().__init__(enum_path)
        for line, p in [*(_csv_rows(path, "service_id") if path else ()), *enumerate(rows, 1)]:
            if len(p) < 10:
                raise ValueError(f"line {line}: expected at least 10 columns, got {len(p)}")
            try:
                self._add((_number(p[0]), _number(p[1])), p[2:10])
            except ValueError as e:
                raise ValueError(f"line {line}: {e}") from e

    @classmethod
    def from_rows(cls, rows: Iterable[list[str]]) -> SomeIpSignalDb:
        return cls(rows=rows)

    def decode(self, service_id: int, method_id: int, payload: bytes):
        return self._decode((service_id, method_id), payload)


class ChannelDb:
    def __init__(self, path: str):
        self._names: dict[tuple[str, int], str] = {}
        for line, (kind, channel, name, *_) in _csv_rows(path, "type"):
            key = (kind.lower(), _number(channel))
            if kind.lower() not in ("can", "ethernet") or key in self._names:
                raise ValueError(f"line {line}: unknown type or duplicate channel {kind} {channel}")
            self._names[key] = name

    def name(self, type: str, channel: int) -> str | None:  # noqa: A002
        return self._names.get((type.lower(), channel))


def parse_uds(data: bytes) -> tuple | None:
    """(type, service, name, nrc, nrc name, data), None where malformed."""
    if not data or (data[0] == 0x7F and len(data) < 3):
        return None

    def named(code: int, table: dict[int, str]) -> str:
        return table.get(code, f"Unknown_0x{code:02X}")

    if data[0] == 0x7F:
        return "NegativeResponse", data[1], named(data[1], UDS_SERVICES), data[2], named(data[2], UDS_NRCS), b""
    positive = bool(data[0] & 0x40)
    service = data[0] & 0xBF
    return "PositiveResponse" if positive else "Request", service, named(service, UDS_SERVICES), None, None, bytes(data[1:])


def isotp_fields(data: bytes) -> tuple[str, int | None, int | None, bytes] | None:
    """(kind, total length, sequence, payload) of one frame."""
    if not data:
        return None
    kind, low = data[0] >> 4, data[0] & 15
    if kind == 0:
        at, size = (1, low) if low else (2, data[1] if len(data) > 1 else 256)
        return ("SF", size, None, data[at : at + size]) if len(data) >= at + size else None
    if kind == 1 and len(data) >= 2:
        total = low << 8 | data[1]
        if total:
            return "FF", total, None, data[2:]
        return ("FF", int.from_bytes(data[2:6], "big"), None, data[6:]) if len(data) >= 6 else None
    if kind == 2:
        return "CF", None, low, data[1:]
    return ("FC", None, low, data[1:]) if kind == 3 and len(data) >= 3 else None


class IsoTpReassembler:
    """Frames of one conversation, in order; ``push`` gives a parsed UDS message
    when one is complete."""

    def __init__(self):
        self._state = Reassembler()

    def push(self, data: bytes) -> tuple | None:
        fields = isotp_fields(bytes(data))
        done = self._state.push(*fields, 0) if fields else None
        return parse_uds(done[1]) if done else None


def is_diagnostic_can_id(can_id: int) -> bool:
    return 0x7DF <= can_id <= 0x7EF or can_id & 0xFFFF0000 == 0x18DA0000


def _headers(ether_type: int, payload: bytes) -> tuple[network.Headers, bytes]:
    h = network.headers(pa.array([bytes(payload)], pa.binary()), np.array([ether_type]))
    return h, bytes(payload)[int(h.at[0]) : int(h.at[0] + h.size[0])]


def parse_someip_udp(ether_type: int, eth_payload: bytes) -> list[dict]:
    h, data = _headers(ether_type, eth_payload)
    if h.kind[0] != network.UDP:
        return []
    ends = {"src_ip": h.address(0, True), "dst_ip": h.address(0, False), "udp_src_port": int(h.src_port[0]), "udp_dst_port": int(h.dst_port[0])}
    fields = names(network.SOMEIP_FIELDS)
    return [ends | dict(zip(fields, m)) for m in network.someip_messages(data) if network.served(m)]


def parse_doip_diag(ether_type: int, eth_payload: bytes) -> list[tuple[int, int, bytes]]:
    h, data = _headers(ether_type, eth_payload)
    if h.kind[0] != network.TCP or network.DOIP_PORT not in (h.src_port[0], h.dst_port[0]):
        return []
    return network.doip_diag(data)


def parse_eth_payload_signals(ether_type: int, eth_payload: bytes) -> list[dict]:
    """Header fields as signals: signal_name, signal_value, signal_str."""
    b = pa.RecordBatch.from_arrays([pa.array([ether_type], pa.int32()), pa.array([bytes(eth_payload)], pa.binary())], ["ether_type", "data"])
    return network.signal_rows(b, []).to_pylist()
