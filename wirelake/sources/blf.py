"""BLF logs: codec and Python data source.

A file is a header and log containers, each holding zlib-compressed objects; an
object may span containers. The reader joins the decompressed containers of a
slice, walks the object headers once and decodes each message type with numpy
over all its objects, straight into Arrow columns.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wirelake.schema import LOG_COLUMNS, SOURCE_ROWS, names

FILE_HEADER = struct.Struct("<4sI8BQQII8H8H")  # 72 of 144 bytes
OBJECT_HEADER = struct.Struct("<4sHHII")
CONTAINER_HEADER = struct.Struct("<H6xI4x")

# fixed values: object codes of the format
CAN_MESSAGE, LOG_CONTAINER, ETHERNET, CAN_MESSAGE2, CAN_FD, CAN_FD64, ETHERNET_EX = 1, 10, 71, 86, 100, 101, 120
#: objects followed by size % 4 bytes of padding
PADDED = frozenset((0, 10, 32, 33, 65, 69, 71, 72, 76, 77, 78, 79, 80, 81, 83, 84, 85, 90, 92, 93, 96, 97, 102))
VLAN_TPIDS = (0x8100, 0x8800, 0x88A8, 0x9100)
NAMES = {CAN_MESSAGE: "CAN", CAN_MESSAGE2: "CAN", CAN_FD: "CAN_FD", CAN_FD64: "CAN_FD64", ETHERNET: "ETH", ETHERNET_EX: "ETH_EX"}
TYPES = ("CAN", "CAN_FD", "CAN_FD64", "ETH", "ETH_EX", "MF4_SIGNAL", "OTHER")

BATCH_ROWS, CHUNK_BYTES = 100_000, 4 << 20
#: Runs of containers become so many tasks at most; a task takes adjacent runs beyond.
MOST_PARTITIONS = 1000


class BlfError(ValueError):
    """A file that is not a readable BLF log."""


def system_time_ns(words) -> int:
    """SYSTEMTIME (year, month, weekday, day, hour, minute, second, ms) as UTC
    nanoseconds; 0 for invalid dates."""
    year, month, _, day, hour, minute, second, ms = words
    try:
        t = datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc)
    except ValueError:
        return 0
    return int(t.timestamp()) * 1_000_000_000 + ms * 1_000_000


def system_time(ns: int) -> tuple:
    if not ns:
        return (0,) * 8
    t = datetime.fromtimestamp(ns // 1_000_000_000, timezone.utc)
    return t.year, t.month, t.isoweekday() % 7, t.day, t.hour, t.minute, t.second, ns // 1_000_000 % 1000


@dataclass
class FileHeader:
    size: int
    file_size: int
    uncompressed_size: int
    object_count: int
    start_ns: int
    stop_ns: int

    @classmethod
    def read(cls, raw: bytes) -> FileHeader:
        if len(raw) < FILE_HEADER.size:
            raise BlfError("file header is cut off")
        v = FILE_HEADER.unpack_from(raw)
        if v[0] != b"LOGG":
            raise BlfError(f"not a BLF file: {v[0]!r}")
        return cls(v[1], v[10], v[11], v[12], system_time_ns(v[14:22]), system_time_ns(v[22:30]))

    def pack(self) -> bytes:
        versions = (0,) * 8
        return FILE_HEADER.pack(b"LOGG", 144, *versions, self.file_size, self.uncompressed_size, self.object_count, 0, *system_time(self.start_ns), *system_time(self.stop_ns)).ljust(144, b"\0")


def open_file(path: str):
    """A seekable file on any file system that Arrow knows."""
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
        return system.open_input_file(inner)
    return open(path, "rb")


def read_header(f) -> FileHeader:
    f.seek(0)
    return FileHeader.read(f.read(144))


def containers_from(f, at: int, end: int | None = None) -> Iterator[int | None]:
    """The offset of each container from the one at ``at`` on, up to ``end``, from
    headers only; a last None where another object follows."""
    while end is None or at < end:
        f.seek(at)
        raw = f.read(16)
        if len(raw) < 16:
            return
        magic, _, _, size, kind = OBJECT_HEADER.unpack(raw)
        if magic != b"LOBJ":
            raise BlfError(f"no object at byte {at}")
        if kind != LOG_CONTAINER:
            yield None
            return
        yield at
        at += size + (size - 32) % 4


def scan_containers(f) -> tuple[FileHeader, list[int] | None]:
    """The file header and the offset of each container; None where objects are
    stored without containers."""
    header = read_header(f)
    offsets = list(containers_from(f, header.size))
    return header, None if None in offsets[-1:] else offsets


def container(f, offset: int) -> bytes:
    """The decompressed bytes of the container at ``offset``."""
    f.seek(offset)
    head = f.read(32)
    if len(head) < 32:
        raise BlfError(f"container at byte {offset} is cut off")
    _, _, _, size, kind = OBJECT_HEADER.unpack_from(head)
    if kind != LOG_CONTAINER:
        raise BlfError(f"object at byte {offset} is no container")
    method, expected = CONTAINER_HEADER.unpack_from(head, 16)
    raw = f.read(size - 32)
    if len(raw) < size - 32:
        raise BlfError(f"container at byte {offset} is cut off")
    if method != 2:
        return raw
    try:
        out = zlib.decompress(raw)
    except zlib.error as e:
        raise BlfError(f"container at byte {offset}: {e}") from e
    if len(out) != expected:
        raise BlfError(f"container at byte {offset} has {len(out)} bytes, not {expected}")
    return out


def walk(buf: bytes) -> tuple[np.ndarray, int]:
    """(offset, version, size, code) rows of the complete objects, and the offset
    of the first incomplete one. Objects mostly follow each other wherever their
    magic occurs, which is checked for all at once; payloads that hold the magic
    are walked object by object."""
    raw, n = np.frombuffer(buf, np.uint8), len(buf)
    at = np.flatnonzero(raw[: max(0, n - 15)] == 0x4C)
    for k, c in enumerate(b"OBJ", 1):
        at = at[raw[at + k] == c]
    if not len(at) or at[0] != 0:
        return _walk_each(buf)
    head = raw[at[:, None] + np.arange(4, 16)]
    version = head[:, 2:4].copy().view("<u2")[:, 0].astype(np.int64)
    size, kind = (head[:, i : i + 4].copy().view("<u4")[:, 0].astype(np.int64) for i in (4, 8))
    end = at + size + np.where(np.isin(kind, _PADDED), size % 4, 0)
    if (size < 16).any() or (end[:-1] != at[1:]).any():
        return _walk_each(buf)
    done = int((end <= n).sum())
    stop = int(end[done - 1]) if done else 0
    if done == len(at) and n - stop >= 4 and buf[stop : stop + 4] != b"LOBJ":
        raise BlfError("object header expected")
    return np.stack([at, version, size, kind], axis=1)[:done], stop


_PADDED = np.array(sorted(PADDED))


def _walk_each(buf: bytes) -> tuple[np.ndarray, int]:
    found, at, n = [], 0, len(buf)
    unpack = OBJECT_HEADER.unpack_from
    while at + 16 <= n:
        magic, _, version, size, kind = unpack(buf, at)
        if magic != b"LOBJ":
            raise BlfError("object header expected")
        if size < 16:
            raise BlfError(f"object of {size} bytes")
        end = at + size + (size % 4 if kind in PADDED else 0)
        if end > n:
            break
        found.append((at, version, size, kind))
        at = end
    return np.array(found, np.int64).reshape(-1, 4), at


class _Columns:
    """Columns of one batch: filled per message type, null elsewhere."""

    KINDS = {"timestamp_ns": np.int64, "channel": np.int32, "can_id": np.int64, "is_ext_id": bool, "dir": np.int8, "rtr": bool, "dlc": np.uint8, "fdf": bool, "brs": bool, "esi": bool, "ether_type": np.int32, "vlan_tpid": np.int32, "vlan_cos": np.int32, "vlan_id": np.int32}

    def __init__(self, raw: np.ndarray, n: int):
        self.raw, self.n = raw, n
        self.values = {k: np.zeros(n, t) for k, t in self.KINDS.items()}
        self.given = {k: np.zeros(n, bool) for k in (*self.KINDS, "data", "src_addr", "dst_addr")}
        self.spans = {k: (np.zeros(n, np.int64), np.zeros(n, np.int64)) for k in ("data", "src_addr", "dst_addr")}
        self.kind = np.full(n, len(TYPES) - 1, np.int32)

    def put(self, rows: np.ndarray, **values) -> None:
        for name, v in values.items():
            self.values[name][rows] = v
            self.given[name][rows] = True

    def put_bytes(self, rows: np.ndarray, name: str, start: np.ndarray, length) -> None:
        self.spans[name][0][rows], self.spans[name][1][rows] = start, length
        self.given[name][rows] = True

    def binary(self, name: str) -> pa.Array:
        start, length = self.spans[name]
        given = self.given[name]
        length = np.where(given, length, 0)
        offsets = np.zeros(self.n + 1, np.int32)
        np.cumsum(length, out=offsets[1:])
        at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
        packed = np.packbits(given, bitorder="little")
        return pa.Array.from_buffers(pa.binary(), self.n, [pa.py_buffer(packed.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.raw[at].tobytes())])

    def field(self, name: str) -> pa.Array:
        if name == "message_type":
            return pa.DictionaryArray.from_arrays(pa.array(self.kind), pa.array(TYPES)).cast(pa.string())
        if name in self.spans:
            return self.binary(name)
        if name not in self.values:  # samples of the other format
            return pa.nulls(self.n, pa.float64() if name == "mf4_value" else pa.string())
        v = self.values[name]
        v = v.view(np.int8) if name == "dlc" else v
        return pa.array(v, mask=~self.given[name])


def decode(buf: bytes, found: np.ndarray, wanted: frozenset[str] | None = None) -> pa.RecordBatch:
    """The log columns of the objects at ``found``."""
    if wanted is not None:
        codes = [c for c, name in NAMES.items() if name in wanted]
        found = found[np.isin(found[:, 3], codes) | (~np.isin(found[:, 3], list(NAMES)) if "OTHER" in wanted else False)]
    n = len(found)
    raw = np.frombuffer(buf, np.uint8)
    at, version, size, kind = found.T
    c = _Columns(raw, n)

    def number(where: np.ndarray, offset, dtype: str) -> np.ndarray:
        width = np.dtype(dtype).itemsize
        return raw[(where + offset)[:, None] + np.arange(width)].copy().view(dtype)[:, 0] if len(where) else np.empty(0, dtype)

    stamp = number(at, 24, "<u8").astype(np.int64)
    c.put(np.arange(n), timestamp_ns=np.where(number(at, 16, "<u4") == 1, stamp * 10_000, stamp))
    body = at + np.where(version == 1, 32, 40)
    for code, name in NAMES.items():
        rows = np.flatnonzero(kind == code)
        if not len(rows):
            continue
        c.kind[rows] = TYPES.index(name)
        p, left = body[rows], (at + size)[rows] - body[rows]
        least = {"CAN": 16, "CAN_FD": 20, "CAN_FD64": 40, "ETH": 32, "ETH_EX": 32}[name]
        if (left < least).any():
            raise BlfError(f"{name} object is too short")
        if name in ("CAN", "CAN_FD", "CAN_FD64"):
            wide = name == "CAN_FD64"
            can_id = number(p, 4, "<u4").astype(np.int64)
            if wide:
                flags = number(p, 12, "<u4")
                length = number(p, 2, "u1").astype(np.int64)
                c.put(rows, channel=number(p, 0, "u1"), dlc=number(p, 1, "u1"), dir=flags >> 6 & 3, rtr=flags & 0x10 != 0, fdf=flags & 0x1000 != 0, brs=flags & 0x2000 != 0, esi=flags & 0x4000 != 0)
                start = p + 40
            else:
                flags = number(p, 2, "u1")
                c.put(rows, channel=number(p, 0, "<u2"), dlc=number(p, 3, "u1"), dir=flags & 3, rtr=flags & 0x80 != 0)
                start, length = p + 8, np.full(len(p), 8, np.int64)
                if name == "CAN_FD":
                    fd = number(p, 13, "u1")
                    c.put(rows, fdf=fd & 1 != 0, brs=fd & 2 != 0, esi=fd & 4 != 0)
                    start, length = p + 20, number(p, 14, "u1").astype(np.int64)
            if (start + length > p + left).any():
                raise BlfError(f"{name} data is cut off")
            c.put(rows, can_id=can_id & 0x1FFFFFFF, is_ext_id=can_id & 0x80000000 != 0)
            c.put_bytes(rows, "data", start, length)
        elif name == "ETH":
            tpid, tci, length = (number(p, o, "<u2").astype(np.int64) for o in (18, 20, 22))
            if (32 + length > left).any():
                raise BlfError("ETH data is cut off")
            c.put(rows, channel=number(p, 6, "<u2"), dir=number(p, 14, "<u2") & 3, ether_type=number(p, 16, "<u2"))
            c.put_bytes(rows, "src_addr", p, 6)
            c.put_bytes(rows, "dst_addr", p + 8, 6)
            c.put_bytes(rows, "data", p + 32, length)
            tagged = tpid != 0
            c.put(rows[tagged], vlan_tpid=tpid[tagged], vlan_cos=tci[tagged] >> 13 & 7, vlan_id=tci[tagged] & 0xFFF)
        else:
            length = number(p, 22, "<u2").astype(np.int64)
            if (32 + length > left).any():
                raise BlfError("ETH_EX frame is cut off")
            c.put(rows, channel=number(p, 4, "<u2"), dir=number(p, 20, "<u2") & 3, ether_type=0)
            frame, full = p + 32, length >= 14
            zero = np.zeros(len(rows), np.int64)
            for field, offset in (("dst_addr", 0), ("src_addr", 6)):
                c.put_bytes(rows[full], field, frame[full] + offset, 6)
            kind_of = zero.copy()
            kind_of[full] = number(frame[full], 12, ">u2")
            tagged = full & np.isin(kind_of, VLAN_TPIDS) & (length >= 18)
            tci = number(frame[tagged], 14, ">u2").astype(np.int64)
            c.put(rows[tagged], vlan_tpid=kind_of[tagged], vlan_cos=tci >> 13 & 7, vlan_id=tci & 0xFFF)
            kind_of[tagged] = number(frame[tagged], 16, ">u2")
            c.put(rows, ether_type=kind_of)
            skip = np.where(tagged, 18, np.where(full, 14, 0))
            c.put_bytes(rows, "data", frame + skip, length - skip)
    columns = [c.field(x) for x in names(LOG_COLUMNS)]
    short = np.flatnonzero((kind == ETHERNET_EX) & ~c.given["src_addr"])
    if len(short):  # frames without addresses show zeros
        for i, name in enumerate(names(LOG_COLUMNS)):
            if name in ("src_addr", "dst_addr"):
                v = columns[i].to_pylist()
                for k in short:
                    v[k] = bytes(6)
                columns[i] = pa.array(v, pa.binary())
    return pa.RecordBatch.from_arrays(columns, names(LOG_COLUMNS))


def objects_of(f, offsets: list[int], further: Iterable[int] = (), first: bool = True) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes, objects) of the containers at ``offsets``, some megabytes at a time.
    What an object lacks at the end is read from ``further`` containers; with
    ``first`` False the bytes before the first object belong to the slice before."""
    rest, skip, at = b"", not first, 0
    while at < len(offsets):
        parts = [rest]
        load = len(rest)
        while at < len(offsets) and load < CHUNK_BYTES:
            parts.append(container(f, offsets[at]))
            load += len(parts[-1])
            at += 1
        rest = b"".join(parts)
        if skip:
            start = _first_object(rest)
            if start < 0:
                continue
            rest, skip = rest[start:], False
        found, end = walk(rest)
        if len(found):
            yield rest, found
        rest = rest[end:]
    for offset in further:
        if not rest or skip:
            return
        rest += container(f, offset)
        found, end = walk(rest)
        if len(found):
            yield rest, found[:1]
            return
    if rest and not skip:
        raise BlfError("the last object is cut off")


def _first_object(buf: bytes) -> int:
    """Where the chain of object headers starts; a chance match breaks it."""
    start = buf.find(b"LOBJ")
    while start >= 0:
        try:
            walk(buf[start:])
            return start
        except BlfError:
            start = buf.find(b"LOBJ", start + 1)
    return -1


def read_batches(path: str, wanted: frozenset[str] | None = None, offsets: list[int] | None = None, further: Iterable[int] = (), first: bool = True) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(start_ns, columns) of a file, or of a slice of its containers."""
    with open_file(path) as f:
        if offsets is None:
            header, offsets = scan_containers(f)
            further, first = (), True
        else:
            header = read_header(f)
        yield from _batches(f, header, wanted, offsets, further, first)


def read_run(path: str, wanted: frozenset[str] | None, start: int, end: int | None) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The same of the containers from byte ``start`` to byte ``end``, or all from
    there. Only the headers of those containers, and of those that the last object
    reaches into, are read."""
    with open_file(path) as f:
        header = read_header(f)
        further = () if end is None else (x for x in containers_from(f, end) if x is not None)
        yield from _batches(f, header, wanted, list(containers_from(f, start, end)), further, start == header.size)


def _batches(f, header: FileHeader, wanted, offsets: list[int] | None, further: Iterable[int], first: bool) -> Iterator[tuple[int, pa.RecordBatch]]:
    if offsets is None:
        f.seek(header.size)
        buf = f.read()
        found, end = walk(buf)
        if end < len(buf):
            raise BlfError("the last object is cut off")
        parts = [(buf, found)]
    else:
        parts = objects_of(f, offsets, further, first)
    for buf, found in parts:
        for at in range(0, len(found), BATCH_ROWS):
            yield header.start_ns, decode(buf, found[at : at + BATCH_ROWS], wanted)


@dataclass
class Slice(InputPartition):
    path: str
    start: int | None  # the whole file
    end: int | None
    number: int


class BlfReader(DataSourceReader):
    def __init__(self, options: dict):
        types = options.get("types")
        self.wanted = frozenset(t.strip() for t in types.split(",")) if types else None
        self.split = int(options.get("containersperpartition", options.get("containersPerPartition", 0)))
        self.absolute = str(options.get("absolute", "false")).lower() == "true"
        self.paths = expand(options["path"], (".blf",))

    def partitions(self):
        """A slice per run of ``split`` containers, or per several adjacent runs
        where there are more than MOST_PARTITIONS: each slice costs a task."""
        out, runs = [], {}
        for path in self.paths if self.split else ():
            with open_file(path) as f:
                offsets = scan_containers(f)[1]
            if offsets:
                runs[path] = np.array(offsets[:: self.split])
        several = -(-sum(map(len, runs.values())) // MOST_PARTITIONS)
        for path in self.paths:
            if path not in runs:
                out.append(Slice(path, None, None, 0))
                continue
            starts = runs[path][::several].tolist()
            out += [Slice(path, start, end, k) for k, (start, end) in enumerate(zip(starts, [*starts[1:], None]))]
        return out

    def read(self, partition: Slice):
        row = partition.number << 40
        whole = partition.start is None
        for start_ns, b in read_batches(partition.path, self.wanted) if whole else read_run(partition.path, self.wanted, partition.start, partition.end):
            yield with_file(b, partition.path, start_ns, row, self.absolute)
            row += b.num_rows


def with_file(b: pa.RecordBatch, path: str, start_ns: int, row: int, absolute: bool = False) -> pa.RecordBatch:
    n = b.num_rows
    columns = b.columns
    if absolute:
        columns = [pa.array(columns[0].to_numpy() + start_ns), *columns[1:]]
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, pa.string()), n), pa.array(np.full(n, start_ns, np.int64)), pa.array(np.arange(row, row + n, dtype=np.int64)), *columns], names(SOURCE_ROWS))


def expand(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The files of a path: itself, or those of a folder."""
    remote = "://" in path
    system, inner = fs.FileSystem.from_uri(path) if remote else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [path]
    scheme = path.split("://")[0] + "://" if remote else ""
    files = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(scheme + x.path for x in files if x.is_file and x.path.lower().endswith(suffixes))


class BlfSource(DataSource):
    """``spark.read.format("blf").option("types", "CAN,ETH").load(path)``.

    Types are chosen by the option, before objects are decoded. They are not
    pushed down from filters: Spark 4.1 keeps one reader for all scans of a
    DataFrame, so the filter of one branch would reach the others."""

    @classmethod
    def name(cls):
        return "blf"

    def schema(self):
        return SOURCE_ROWS

    def reader(self, schema):
        return BlfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``format("blf")`` known."""
    spark.dataSource.register(BlfSource)


def read_blf(spark: SparkSession, path: str, types: list[str] | None = None, containers_per_partition: int = 0, absolute: bool = False) -> DataFrame:
    register(spark)
    reader = spark.read.format("blf").option("containersPerPartition", containers_per_partition).option("absolute", absolute)
    if types:
        reader = reader.option("types", ",".join(types))
    return reader.load(path)


# ── encoding ────────────────────────────────────────────────────────────────


def _vlan(row) -> tuple[int, int] | None:
    if row["vlan_tpid"] is None:
        return None
    return row["vlan_tpid"], (row["vlan_cos"] or 0) << 13 | (row["vlan_id"] or 0) & 0xFFF


def encode_message(row: dict) -> tuple[int, bytes] | None:
    """(object code, payload) of a log row; None for rows the format lacks."""
    kind, data = row["message_type"], bytes(row["data"] or b"")
    if kind in ("CAN", "CAN_FD", "CAN_FD64"):
        can_id = row["can_id"] & 0x1FFFFFFF | (0x80000000 if row["is_ext_id"] else 0)
        flags = (row["dir"] or 0) & 3 | (0x80 if row["rtr"] else 0)
        dlc = (row["dlc"] or 0) & 0xFF
        fd = [bool(row[x]) for x in ("fdf", "brs", "esi")]
        if kind == "CAN":
            return CAN_MESSAGE, struct.pack("<HBBI", row["channel"], flags, dlc, can_id) + data[:8].ljust(8, b"\0")
        if kind == "CAN_FD":
            bits = sum(1 << i for i, on in enumerate(fd) if on)
            return CAN_FD, struct.pack("<HBBIIBBB5x", row["channel"], flags, dlc, can_id, 0, 0, bits, len(data)) + data
        bits = ((row["dir"] or 0) & 3) << 6 | (0x10 if row["rtr"] else 0) | sum(0x1000 << i for i, on in enumerate(fd) if on)
        return CAN_FD64, struct.pack("<BBBBIII4IHBBI", row["channel"], dlc, len(data), 0, can_id, 0, bits, 0, 0, 0, 0, 0, 0, 0, 0) + data
    if kind in ("ETH", "ETH_EX"):
        src, dst, vlan = bytes(row["src_addr"] or bytes(6)), bytes(row["dst_addr"] or bytes(6)), _vlan(row)
        direction, ether_type = (row["dir"] or 0) & 3, row["ether_type"] or 0
        if kind == "ETH":
            return ETHERNET, struct.pack("<6sH6sHHHHH8x", src, row["channel"], dst, direction, ether_type, *(vlan or (0, 0)), len(data)) + data
        frame = dst + src + (struct.pack(">HH", *vlan) if vlan else b"") + struct.pack(">H", ether_type) + data
        return ETHERNET_EX, struct.pack("<HHHHQIHHII", 0, 0, row["channel"], 0, 0, 0, direction, len(frame), 0, 0) + frame
    return None


class Writer:
    """Writes log rows, in the order given, to an open binary file."""

    BUFFER = 4096

    def __init__(self, f, start_ns: int = 0, stop_ns: int = 0):
        self.f, self.buf = f, bytearray()
        self.header = FileHeader(144, 0, 0, 0, start_ns, stop_ns)
        f.write(self.header.pack())

    def write(self, row: dict) -> None:
        encoded = encode_message(row)
        if encoded is None:
            return
        code, payload = encoded
        size, start = len(payload) + 32, len(self.buf)
        self.buf += OBJECT_HEADER.pack(b"LOBJ", 16, 1, size, code) + struct.pack("<IHHQ", 0, 0, 0, row["timestamp_ns"]) + payload
        if code in PADDED:
            self.buf += bytes(size % 4)
        self.header.object_count += 1
        if len(self.buf) >= self.BUFFER:  # containers end between objects
            self._flush(start or len(self.buf))

    def _flush(self, end: int) -> None:
        part, self.buf = bytes(self.buf[:end]), self.buf[end:]
        self.header.uncompressed_size += len(part)
        packed = zlib.compress(part)
        size = len(packed) + 32
        self.f.write(OBJECT_HEADER.pack(b"LOBJ", 16, 1, size, LOG_CONTAINER) + CONTAINER_HEADER.pack(2, len(part)) + packed + bytes(size % 4))

    def close(self) -> None:
        self._flush(len(self.buf))
        self.header.file_size = self.f.tell()
        self.f.seek(0)
        self.f.write(self.header.pack())
        self.f.seek(self.header.file_size)


def write_rows(path: str, rows, start_ns: int = 0) -> None:
    """Writes an iterable of log rows (dicts or Rows) to a local file."""
    blank = dict.fromkeys(names(LOG_COLUMNS))
    with open(path, "wb") as f:
        w = Writer(f, start_ns)
        for row in rows:
            w.write(blank | (row if isinstance(row, dict) else row.asDict()))
        w.close()
