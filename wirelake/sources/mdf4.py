"""MDF4 logs: codec and Python data source.

The block tree of a file is walked once into groups; a group's records are then
read data block by data block as numpy byte matrices, from which every channel is
a column. Large groups are cut at data blocks into several partitions. CAN and
Ethernet groups become messages, all other groups one sample per data channel and
record.

Times are relative to the recording's start, as in the other format. Lists of
data blocks and both compressions (plain and transposed deflate) are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wirelake.schema import LOG_COLUMNS, SOURCE_ROWS, names

from .blf import expand, open_file, with_file

HEADER = struct.Struct("<4s4xQQ")
# fixed values: codes of the format
MASTER, DATA = 2, 0
UINT_LE, UINT_BE, INT_LE, INT_BE, FLOAT_LE, FLOAT_BE = range(6)
#: byte arrays: the standard's code and the one other writers of such logs use
BYTE_ARRAYS = (10, 14)
BUS_CAN, BUS_ETHERNET = 2, 7
DLC_BYTES = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64] + [64] * 240)
DATA_BLOCKS = ("DT", "DV", "RD", "DI", "SD")
BATCH_ROWS = 50_000
#: Bytes of a plain data block that are read at a time, and of records in a partition.
PIECE, SLICE = 1 << 22, 128 << 20


class Mdf4Error(ValueError):
    """A file that is not a readable MDF4 log."""


@dataclass
class Block:
    id: str
    links: list[int]
    body: bytes


class File:
    """Random access to the blocks of an open file."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        if f.read(8) != b"MDF     ":
            raise Mdf4Error("not an MDF file")

    def block(self, at: int) -> Block:
        self.f.seek(at)
        raw = self.f.read(24)
        if len(raw) < 24 or raw[:2] != b"##":
            raise Mdf4Error(f"no block at byte {at}")
        name, length, n = HEADER.unpack(raw)
        rest = self.f.read(length - 24)
        if len(rest) < length - 24:
            raise Mdf4Error(f"block at byte {at} is cut off")
        return Block(name[2:].decode("latin-1"), list(struct.unpack_from(f"<{n}Q", rest)), rest[8 * n :])

    def text(self, at: int) -> str:
        if not at:
            return ""
        b = self.block(at)
        return b.body.split(b"\0")[0].decode("utf-8", "replace") if b.id in ("TX", "MD") else ""

    def chain(self, at: int, kind: str) -> Iterator[Block]:
        while at:
            b = self.block(at)
            if b.id != kind:
                raise Mdf4Error(f"{kind} block expected at byte {at}, found {b.id}")
            yield b
            at = b.links[0]

    def parts(self, at: int) -> Iterator[tuple[int, int]]:
        """(address, bytes of records) of the data blocks below a data link, in
        order; lists are walked in a loop, blocks are not read."""
        ahead = [at]
        while ahead:
            if not (at := ahead.pop()):
                continue
            name, length, n = self.head(at)
            if name in DATA_BLOCKS:
                yield at, length - 24 - 8 * n
            elif name == "DZ":
                yield at, struct.unpack_from("<Q", self.f.read(16 + 8 * n), 8 * n + 8)[0]
            elif name == "HL":
                ahead.append(self.block(at).links[0])
            elif name == "DL":
                links = self.block(at).links
                ahead.append(links[0])
                ahead += links[:0:-1]
            else:
                raise Mdf4Error(f"{name} holds no records")

    def head(self, at: int) -> tuple[str, int, int]:
        """(kind, length, number of links) of a block."""
        self.f.seek(at)
        raw = self.f.read(24)
        if len(raw) < 24 or raw[:2] != b"##":
            raise Mdf4Error(f"no block at byte {at}")
        name, length, n = HEADER.unpack(raw)
        return name[2:].decode("latin-1"), length, n

    def records(self, at: int, skip: int = 0) -> Iterator[bytes]:
        """The bytes of one data block from ``skip`` on: a plain one piece by
        piece, a compressed one as a whole."""
        name, length, n = self.head(at)
        if name in DATA_BLOCKS:
            place, end = at + 24 + 8 * n + skip, at + length
            while place < end:
                self.f.seek(place)
                piece = self.f.read(min(PIECE, end - place))
                if not piece:
                    raise Mdf4Error(f"block at byte {at} is cut off")
                place += len(piece)
                yield piece
            return
        body = self.block(at).body
        kind, _, parameter, size, packed = struct.unpack_from("<BBIQQ", body, 2)
        if kind not in (0, 1):
            raise Mdf4Error(f"compression {kind} is unknown")
        raw = zlib.decompress(body[24 : 24 + packed])
        if kind == 1 and parameter:  # stored column by column
            whole = len(raw) // parameter * parameter
            raw = np.frombuffer(raw[:whole], np.uint8).reshape(parameter, -1).T.tobytes() + raw[whole:]
        if len(raw) != size:
            raise Mdf4Error(f"data block has {len(raw)} bytes, not {size}")
        yield raw[skip:]

    def data(self, at: int) -> bytes:
        """All records below a data link."""
        return b"".join(piece for block, _ in self.parts(at) for piece in self.records(block))


@dataclass
class Channel:
    name: str
    unit: str
    kind: int
    type: int
    bit: int
    byte: int
    bits: int
    a: float = 0.0
    b: float = 1.0

    def values(self, m: np.ndarray) -> np.ndarray:
        """Physical values over the rows of a record matrix; 0 where the channel
        lies beyond the record or is no number."""
        width = -(-(self.bits + self.bit) // 8)
        out = np.zeros(len(m))
        if self.byte + width <= m.shape[1]:
            part = m[:, self.byte : self.byte + width]
            if self.type in (FLOAT_LE, FLOAT_BE):
                if self.bits in (32, 64):
                    order = "<" if self.type == FLOAT_LE else ">"
                    out = np.ascontiguousarray(part).view(f"{order}f{self.bits // 8}")[:, 0].astype(np.float64)
            elif self.type <= INT_BE and width <= 8:
                wide = np.zeros((len(m), 8), np.uint8)
                wide[:, :width] = part if self.type in (UINT_LE, INT_LE) else part[:, ::-1]
                raw = wide.view("<u8")[:, 0] >> np.uint64(self.bit)
                left = np.uint64(64 - self.bits)
                out = ((raw << left).view(np.int64) >> left.astype(np.int64) if self.type in (INT_LE, INT_BE) else (raw << left) >> left).astype(np.float64) if self.bits else out
        return self.a + self.b * out

    def bytes(self, m: np.ndarray) -> np.ndarray:
        return m[:, self.byte : self.byte + self.bits // 8]


@dataclass
class Group:
    name: str
    bus: int
    records: int
    size: int
    data: int
    channels: list[Channel] = field(default_factory=list)

    def find(self, *needles: str) -> Channel | None:
        """The first channel whose name holds one of the needles, tried in turn."""
        for n in needles:
            for c in self.channels:
                if n in c.name.upper():
                    return c
        return None

    @property
    def master(self) -> Channel | None:
        return next((c for c in self.channels if c.kind == MASTER), None)

    @property
    def form(self) -> str:
        if self.master and self.bus == BUS_CAN and all((self.find("ID", "IDENTIFIER"), self.find("DLC"), self.find("DATABYTES", "DATA"))):
            return "CAN"
        return "ETH" if self.master and self.bus == BUS_ETHERNET else "MF4_SIGNAL"


def read_index(f: File) -> tuple[int, list[Group]]:
    """The recording's start and the groups that have records."""
    head = f.block(64)
    if head.id != "HD":
        raise Mdf4Error("no header block")
    start_ns, groups = struct.unpack_from("<Q", head.body)[0], []
    for dg in f.chain(head.links[0], "DG"):
        inner = list(f.chain(dg.links[1], "CG"))
        if len(inner) > 1:
            raise Mdf4Error("unsorted data groups (several channel groups share one data block) are not supported")
        for cg in inner:
            _, cycles, _, _, size = struct.unpack_from("<QQHH4xI", cg.body)
            if not cycles or not dg.links[2]:
                continue
            bus = f.block(cg.links[3]).body[1] if cg.links[3] else 0
            g = Group(f.text(cg.links[2]), bus, cycles, size, dg.links[2])
            for cn in f.chain(cg.links[1], "CN"):
                kind, _, type_, bit, byte, bits = struct.unpack_from("<BBBBII", cn.body)
                # the unit may stand in either of the two text slots
                unit = next((t for x in (cn.links[6], cn.links[7]) if x and f.block(x).id == "TX" and (t := f.text(x))), "")
                c = Channel(f.text(cn.links[2]), unit, kind, type_, bit, byte, bits)
                if cn.links[4]:
                    cc = f.block(cn.links[4])
                    if cc.body[0] == 1 and struct.unpack_from("<H", cc.body, 6)[0] >= 2:
                        c.a, c.b = struct.unpack_from("<dd", cc.body, 24)
                g.channels.append(c)
            groups.append(g)
    return start_ns, groups


def _table(n: int, columns: dict) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    out = []
    for name, kind in (x.split() for x in LOG_COLUMNS.split(", ")):
        v = columns.get(name)
        t = types[kind]
        if v is None:
            out.append(pa.nulls(n, t))
        elif isinstance(v, (pa.Array, list)):
            out.append(v if isinstance(v, pa.Array) else pa.array(v, t))
        elif isinstance(v, np.ndarray):
            out.append(pa.array(v.astype(np.uint8).view(np.int8)) if kind == "byte" else pa.array(v).cast(t))
        else:
            out.append(pa.array([v] * n, t))
    return pa.RecordBatch.from_arrays(out, names(LOG_COLUMNS))


def _cut(m: np.ndarray, length: np.ndarray) -> list[bytes]:
    rows = np.ascontiguousarray(m)
    return [r.tobytes()[:n] for r, n in zip(rows, np.minimum(length, m.shape[1]).tolist())]


def decode_group(g: Group, m: np.ndarray) -> pa.RecordBatch:
    """Log columns of a group's records."""
    n = len(m)
    zero = np.zeros(n)
    stamp = np.trunc((g.master.values(m) if g.master else zero) * 1e9).astype(np.int64)

    def number(*needles: str, default: float = 0.0) -> np.ndarray:
        c = g.find(*needles)
        return (c.values(m) if c else np.full(n, default)).astype(np.int64)

    if g.form == "CAN":
        can_id, dlc = number("ID", "IDENTIFIER"), number("DLC")
        length = number("DATALENGTH") if g.find("DATALENGTH") else DLC_BYTES[dlc & 255]
        c = g.find("DATABYTES", "DATA")
        data = _cut(c.bytes(m) if c.type in BYTE_ARRAYS else m[:, c.byte : c.byte + 64], length)
        fd = number("EDL", "ISFD") != 0
        flags = {k: pa.array(number(k.upper()) != 0, mask=~fd) for k in ("brs", "esi")}
        kind = pa.array(np.where(fd, "CAN_FD", "CAN"), pa.string())
        return _table(n, dict(timestamp_ns=stamp, message_type=kind, channel=number("BUSCHANNEL", "CHANNEL", default=1), can_id=can_id & 0x1FFFFFFF, is_ext_id=can_id & 0x80000000 != 0, dir=number("DIR"), rtr=False, dlc=dlc, data=data, fdf=pa.array(fd, mask=~fd), **flags))
    if g.form == "ETH":
        def raw(*needles: str, width: int) -> list[bytes]:
            c = g.find(*needles)
            return [x.tobytes()[:width].ljust(width, b"\0") for x in np.ascontiguousarray(c.bytes(m))] if c else [bytes(width)] * n

        c = g.find("DATABYTES", "DATA")
        data = _cut(c.bytes(m), number("DATALENGTH")) if c else [b""] * n
        return _table(n, dict(timestamp_ns=stamp, message_type="ETH", channel=number("CHANNEL"), dir=number("DIR"), ether_type=number("ETHERTYPE"), src_addr=raw("SRC", "SOURCE", width=6), dst_addr=raw("DST", "DEST", width=6), data=data))
    signals = [c for c in g.channels if c.kind != MASTER]
    values = np.stack([c.values(m) for c in signals], axis=1).ravel() if signals else np.empty(0)
    k = len(signals)

    def tiled(texts: list[str]) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(texts, pa.string())).cast(pa.string()) if k else pa.array([], pa.string())

    return _table(n * k, dict(timestamp_ns=np.repeat(stamp, k), message_type="MF4_SIGNAL", mf4_group=g.name, mf4_name=tiled([c.name for c in signals]), mf4_value=values, mf4_unit=tiled([c.unit for c in signals])))


@dataclass
class GroupSlice(InputPartition):
    """Records of a group from ``first`` up to ``end`` (None: all there are)."""

    path: str
    group: int | None
    first: int = 0
    end: int | None = None


def slices(f: File, path: str, size: int = SLICE) -> list[GroupSlice]:
    """The groups of a file, cut at data blocks into parts of ``size`` bytes."""
    out = []
    for k, g in enumerate(read_index(f)[1]):
        first = at = 0
        for _, n in f.parts(g.data):
            at += n
            end = at // g.size if g.size else 0
            if (end - first) * g.size >= size:
                out.append(GroupSlice(path, k, first, end))
                first = end
        out.append(GroupSlice(path, k, first, None))
    return out


def read_batches(path: str, wanted: frozenset[str] | None = None, part: GroupSlice | None = None) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(start_ns, number of the first row, columns) of all groups or of a part of
    one; memory holds some records and one block or piece of it at a time."""
    with open_file(path) as handle:
        f = File(handle)
        start_ns, groups = read_index(f)
        for k, g in enumerate(groups):
            if part is not None and part.group is not None and k != part.group:
                continue
            if not g.size or (wanted is not None and not wanted & ({"CAN", "CAN_FD"} if g.form == "CAN" else {g.form})):
                continue
            per_record = sum(c.kind != MASTER for c in g.channels) if g.form == "MF4_SIGNAL" else 1
            step = max(1, BATCH_ROWS // max(1, per_record))
            first, end = (part.first, part.end) if part is not None and part.group is not None else (0, None)
            end = g.records if end is None else min(end, g.records)
            for m in _matrices(f, g, first, end, step):
                b = decode_group(g, m)
                if wanted is not None and g.form == "CAN":
                    b = b.filter(pa.array([x in wanted for x in b.column(1).to_pylist()]))
                yield start_ns, (k << 40) + first * per_record, b
                first += len(m)


def _matrices(f: File, g: Group, first: int, end: int, step: int) -> Iterator[np.ndarray]:
    """Records ``first`` to ``end`` as rows of bytes, at most ``step`` at a time;
    a record may span data blocks."""
    at, left, held = 0, (end - first) * g.size, b""
    skip = first * g.size
    for block, n in f.parts(g.data):
        if left <= 0:
            break
        if at + n > skip:
            for piece in f.records(block, max(0, skip - at)):
                held += piece[:left]
                left -= min(left, len(piece))
                whole = len(held) // g.size
                for row in range(0, whole, step):
                    size = min(step, whole - row)
                    yield np.frombuffer(held, np.uint8, size * g.size, row * g.size).reshape(size, g.size)
                held = held[whole * g.size :]
                if left <= 0:
                    break
        at += n


class Mdf4Reader(DataSourceReader):
    """One partition per group of records of a file, more for large groups."""

    def __init__(self, options: dict):
        types = options.get("types")
        self.wanted = frozenset(t.strip() for t in types.split(",")) if types else None
        self.absolute = str(options.get("absolute", "false")).lower() == "true"
        self.size = int(options.get("bytesperpartition", SLICE))
        self.paths = expand(options["path"], (".mf4", ".mdf"))

    def partitions(self):
        out = []
        for path in self.paths:
            with open_file(path) as handle:
                out += slices(File(handle), path, self.size)
        return out or [GroupSlice(p, None) for p in self.paths]

    def read(self, partition: GroupSlice):
        for start_ns, row, b in read_batches(partition.path, self.wanted, partition):
            yield with_file(b, partition.path, start_ns, row, self.absolute)


class Mdf4Source(DataSource):
    """``spark.read.format("mdf4").load(path)``."""

    @classmethod
    def name(cls):
        return "mdf4"

    def schema(self):
        return SOURCE_ROWS

    def reader(self, schema):
        return Mdf4Reader(dict(self.options))


def read_mdf4(spark: SparkSession, path: str, types: list[str] | None = None, absolute: bool = False) -> DataFrame:
    spark.dataSource.register(Mdf4Source)
    reader = spark.read.format("mdf4").option("absolute", absolute)
    return (reader.option("types", ",".join(types)) if types else reader).load(path)


# ── encoding ────────────────────────────────────────────────────────────────

#: channels of the record layouts: name, offset, bytes, type
CAN_LAYOUT = [("t", 0, 8, FLOAT_LE), ("CAN_DataFrame.ID", 8, 4, UINT_LE), ("CAN_DataFrame.DLC", 12, 1, UINT_LE), ("CAN_DataFrame.Dir", 13, 1, UINT_LE), ("CAN_DataFrame.BusChannel", 14, 2, UINT_LE), ("CAN_DataFrame.EDL", 16, 1, UINT_LE), ("CAN_DataFrame.BRS", 17, 1, UINT_LE), ("CAN_DataFrame.ESI", 18, 1, UINT_LE), ("CAN_DataFrame.DataLength", 19, 1, UINT_LE), ("CAN_DataFrame.DataBytes", 20, 64, 14)]
ETH_DATA = 1514
ETH_LAYOUT = [("t", 0, 8, FLOAT_LE), ("Ethernet.BusChannel", 8, 2, UINT_LE), ("Ethernet.Dir", 10, 1, UINT_LE), ("Ethernet.EtherType", 12, 2, UINT_LE), ("Ethernet.DataLength", 14, 2, UINT_LE), ("Ethernet.Source", 16, 6, 14), ("Ethernet.Destination", 22, 6, 14), ("Ethernet.DataBytes", 28, ETH_DATA, 14)]


class Writer:
    """Collects log rows and writes one sorted file at the end."""

    def __init__(self, f, start_ns: int = 0, compress: bool = False, block_bytes: int = 4 << 20, list_links: int = 1000):
        self.f, self.start_ns, self.compress, self.block_bytes, self.list_links = f, start_ns, compress, block_bytes, list_links
        self.can, self.eth = bytearray(), bytearray()
        self.signals: dict[tuple[str, str], tuple[str, bytearray]] = {}

    def write(self, row: dict) -> None:
        kind, seconds = row["message_type"], row["timestamp_ns"] / 1e9
        data = bytes(row["data"] or b"")
        if kind in ("CAN", "CAN_FD", "CAN_FD64"):
            can_id = row["can_id"] | (0x80000000 if row["is_ext_id"] else 0)
            fd = kind != "CAN"
            self.can += struct.pack("<dIBBHBBBB64s", seconds, can_id, (row["dlc"] or 0) & 255, (row["dir"] or 0) & 255, row["channel"], fd, fd and bool(row["brs"]), fd and bool(row["esi"]), min(len(data), 64), data[:64])
        elif kind in ("ETH", "ETH_EX"):
            data = data[:ETH_DATA]
            self.eth += struct.pack(f"<dHBxHH6s6s{ETH_DATA}s", seconds, row["channel"], (row["dir"] or 0) & 255, row["ether_type"] or 0, len(data), bytes(row["src_addr"] or b""), bytes(row["dst_addr"] or b""), data)
        elif kind == "MF4_SIGNAL":
            unit, records = self.signals.setdefault((row["mf4_group"] or "", row["mf4_name"]), (row["mf4_unit"] or "", bytearray()))
            records += struct.pack("<dd", seconds, row["mf4_value"])

    def _block(self, name: str, links: list[int], body: bytes = b"") -> int:
        at = self.f.seek(0, 2)
        at += self.f.write(bytes(-at % 8))  # blocks start at multiples of 8
        self.f.write(HEADER.pack(b"##" + name.encode(), 24 + 8 * len(links) + len(body), len(links)) + struct.pack(f"<{len(links)}Q", *links) + body)
        return at

    def _text(self, s: str) -> int:
        raw = s.encode() + b"\0"
        return self._block("TX", [], raw + bytes(-len(raw) % 8))

    def _group(self, title: str, bus: int, layout: list, records: bytes, units: dict[str, str] = {}) -> int:
        size = max(o + w for _, o, w, _ in layout)
        source = self._block("SI", [self._text(f"{title}_Bus"), 0, 0], struct.pack("<BBB5x", 2, bus, 0)) if bus else 0
        following = 0
        for name, offset, width, kind in reversed(layout):
            master = name == "t"
            unit = self._text(units.get(name, "s" if master else ""))
            body = struct.pack("<BBBBIIIIBBHdddddd", MASTER if master else DATA, 1 if master else 0, kind, 0, offset, width * 8, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
            following = self._block("CN", [following, 0, self._text(name), source, 0, 0, 0, unit], body)
        cg = self._block("CG", [0, following, self._text(title), source, 0, 0], struct.pack("<QQHHIII", 0, len(records) // size, 0, 0, 0, size, 0))
        return self._block("DG", [0, cg, self._data(records), 0], bytes(8))

    def _data(self, records: bytes) -> int:
        """Data blocks of ``block_bytes`` at most, under lists where there are several."""
        starts = range(0, max(1, len(records)), self.block_bytes)
        blocks = []
        for at in starts:
            part = records[at : at + self.block_bytes]
            if self.compress:
                packed = zlib.compress(part)
                blocks.append(self._block("DZ", [], b"DT" + struct.pack("<BBIQQ", 0, 0, 0, len(part), len(packed)) + packed))
            else:
                blocks.append(self._block("DT", [], part))
        if len(blocks) == 1:
            return blocks[0]
        following = 0
        for i in reversed(range(0, len(blocks), self.list_links)):
            held = blocks[i : i + self.list_links]
            following = self._block("DL", [following, *held], struct.pack(f"<B3xI{len(held)}Q", 0, len(held), *starts[i : i + self.list_links]))
        return following

    def close(self) -> None:
        self.f.seek(0)
        self.f.write((b"MDF     4.10    wirelake" + bytes(4) + struct.pack("<H", 410)).ljust(64, b"\0"))
        self._block("HD", [0] * 6, struct.pack("<Q24x", self.start_ns))
        groups = []
        if self.can:
            groups.append(self._group("CAN", BUS_CAN, CAN_LAYOUT, bytes(self.can)))
        if self.eth:
            groups.append(self._group("Ethernet", BUS_ETHERNET, ETH_LAYOUT, bytes(self.eth)))
        for (group, name), (unit, records) in sorted(self.signals.items()):
            groups.append(self._group(group, 0, [("t", 0, 8, FLOAT_LE), (name, 8, 8, FLOAT_LE)], bytes(records), {name: unit}))
        for at, following in zip([64, *groups], groups):
            self.f.seek(at + 24)
            self.f.write(struct.pack("<Q", following))
        self.f.seek(0, 2)


def write_rows(path: str, rows, start_ns: int = 0, compress: bool = False, **blocks) -> None:
    """Writes an iterable of log rows (dicts or Rows) to a local file."""
    blank = dict.fromkeys(names(LOG_COLUMNS))
    with open(path, "w+b") as f:
        w = Writer(f, start_ns, compress, **blocks)
        for row in rows:
            w.write(blank | (row if isinstance(row, dict) else row.asDict()))
        w.close()
