"""Definition-driven decoding of payloads into signals.

Definitions are compiled once on the driver into byte slices (byte, shift,
mask, place). A worker groups a batch's rows by message, stacks the payloads of
a group and evaluates every signal of the message over all of them with numpy;
the long rows leave as Arrow batches, the passed-through columns by index.
Definition tables are small by contract; ``MOST_DEFS`` enforces that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DEFS = 500_000

# fixed values: payload bytes by CAN-FD length code
DLC_BYTES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)


@dataclass
class Signal:
    name: str
    slices: list[tuple[int, int, int, int]]  # byte, shift, mask, place
    reach: int  # bytes needed
    bits: int
    signed: bool
    scale: float
    offset: float


def bit_positions(start: int, length: int, motorola: bool) -> list[tuple[int, int]]:
    """(byte, bit) of each bit, least significant first. Intel counts up from
    the least significant bit; Motorola starts at the most significant one,
    counts down and goes on at the top of the next byte."""
    if not motorola:
        return [divmod(start + k, 8) for k in range(length)]
    byte, bit = divmod(start, 8)
    down = []
    for _ in range(length):
        down.append((byte, bit))
        byte, bit = (byte + 1, 7) if bit == 0 else (byte, bit - 1)
    return down[::-1]


def compile_signal(name: str, start: int, length: int, order: str, signed: bool, scale: float, offset: float) -> Signal | None:
    """None for lengths no 64-bit value holds."""
    if length > 64:
        return None
    slices: list[list[int]] = []
    for place, (byte, bit) in enumerate(bit_positions(start, length, order.lower() == "motorola")):
        if slices and slices[-1][0] == byte and slices[-1][1] + slices[-1][2] == bit:
            slices[-1][2] += 1
        else:
            slices.append([byte, bit, 1, place])
    reach = 1 + max((s[0] for s in slices), default=-1)
    return Signal(name, [(b, shift, (1 << n) - 1, place) for b, shift, n, place in slices], reach, length, signed, scale, offset)


def raw_values(signal: Signal, payload: np.ndarray) -> np.ndarray:
    """Unsigned raw values over rows of payload bytes."""
    raw = np.zeros(len(payload), np.uint64)
    for byte, shift, mask, place in signal.slices:
        raw |= ((payload[:, byte] >> np.uint8(shift)) & np.uint8(mask)).astype(np.uint64) << np.uint64(place)
    return raw


def physical(signal: Signal, raw: np.ndarray) -> np.ndarray:
    if signal.signed and 0 < signal.bits:
        left = np.uint64(64 - signal.bits)
        number = ((raw << left).view(np.int64) >> left.astype(np.int64)).astype(np.float64)
    else:
        number = raw.astype(np.float64)
    return number * signal.scale + signal.offset


def compile_defs(defs: DataFrame, keys: list[str]) -> dict[tuple, list[Signal]]:
    """key -> signals, in table order."""
    rows = bounded(defs.select(*keys, "signal_name", "start_bit", "bit_length", "byte_order", "is_signed", "scale", "offset"), "signal definitions")
    plan: dict[tuple, list[Signal]] = {}
    for r in rows:
        if s := compile_signal(r["signal_name"], r["start_bit"], r["bit_length"], r["byte_order"], r["is_signed"], r["scale"], r["offset"]):
            plan.setdefault(tuple(r[k] for k in keys), []).append(s)
    return plan


def bounded(df: DataFrame, what: str) -> list:
    """The rows of a definition table; more than ``MOST_DEFS`` are an error."""
    rows = df.limit(MOST_DEFS + 1).collect()
    if len(rows) > MOST_DEFS:
        raise ValueError(f"more than {MOST_DEFS} {what}")
    return rows


def enum_names(enums: DataFrame | None) -> dict[str, dict[int, str]]:
    out: dict[str, dict[int, str]] = {}
    for r in bounded(enums, "enumeration values") if enums is not None else ():
        out.setdefault(r["signal_name"], {})[int(r["raw_value"])] = r["category"]
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where its values begin and end in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(1, np.uint8), offsets


def sliced(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """A binary column of the given parts of ``data``."""
    ends = np.cumsum(length)
    at = np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])


def big_endian(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(size):
        out = out << 8 | data[at + k]
    return out


def stacked(column: pa.Array, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of ``rows`` as a zero-padded byte matrix, and their lengths."""
    data, offsets = flat(column)
    start, length = offsets[rows], offsets[rows + 1] - offsets[rows]
    at = start[:, None] + np.arange(width)
    inside = np.arange(width) < length[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), length


def _key_groups(b: pa.RecordBatch, keys: list[str], plan: dict) -> Iterator[tuple[list[Signal], np.ndarray]]:
    columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
    given = np.ones(b.num_rows, bool)
    for k in (*keys,):
        given &= np.asarray(b.column(k).is_valid())
    rows = np.flatnonzero(given)
    if not len(rows):
        return
    stack = np.stack([c[rows].astype(np.int64) for c in columns], axis=1)
    unique, inverse = np.unique(stack, axis=0, return_inverse=True)
    order = np.argsort(inverse.ravel(), kind="stable")
    bounds = np.searchsorted(inverse.ravel()[order], np.arange(len(unique) + 1))
    for g, key in enumerate(unique.tolist()):
        if signals := plan.get(tuple(key)):
            yield signals, rows[order[bounds[g] : bounds[g + 1]]]


def decode(frames: DataFrame, defs: DataFrame, keys: dict[str, str], payload: str, enums: DataFrame | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row per (frame, signal): the frame's columns without ``drop``, then
    signal_name, signal_value and signal_str (the category of the unsigned raw
    value, NULL without one). ``keys`` maps frame columns to definition columns.
    Signals that reach beyond the payload give no row."""
    plan, categories = compile_defs(defs, list(keys.values())), enum_names(enums)
    names = list(keys)
    kept = [c for c in frames.columns if c not in drop]
    out = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in kept) + ", signal_name string, signal_value double, signal_str string"

    def run(batches):
        for b in batches:
            column = b.column(payload)
            column = column.cast(pa.binary()) if column.type != pa.binary() else column
            null = np.asarray(column.is_null())
            index, label, value, category = [], [], [], []
            for signals, rows in _key_groups(b, names, plan):
                rows = rows[~null[rows]]
                if not len(rows):
                    continue
                matrix, length = stacked(column, rows, max(s.reach for s in signals))
                for s in signals:
                    fits = length >= s.reach
                    at = rows[fits]
                    if not len(at):
                        continue
                    raw = raw_values(s, matrix[fits])
                    index.append(at)
                    label.append((s.name, len(at)))
                    value.append(physical(s, raw))
                    known = categories.get(s.name)
                    category.append(pa.array([known.get(r) for r in raw.tolist()], pa.string()) if known else pa.nulls(len(at), pa.string()))
            if not index:
                continue
            at = np.concatenate(index)
            # frame by frame, signals in the order of their definitions
            order = np.argsort(at, kind="stable")
            take = pa.array(at[order])
            texts = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(label)), [n for _, n in label]).astype(np.int32)), pa.array([x for x, _ in label])).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in kept), texts.take(pa.array(order)), pa.array(np.concatenate(value)[order]), pa.concat_arrays(category).take(pa.array(order))],
                names=[*kept, "signal_name", "signal_value", "signal_str"],
            )

    # no other message reaches the workers: few ids as a pushed filter, many by their compiled plan
    ids = [sorted({k[i] for k in plan}) for i in range(len(names))]
    wanted = frames.where(F.col(payload).isNotNull())
    for name, values in zip(names, ids):
        if len(values) <= 1000:
            wanted = wanted.where(F.col(name).isin(values) if values else F.lit(False))
    return wanted.mapInArrow(run, out)


def decode_can(frames: DataFrame, defs: DataFrame, enums: DataFrame | None = None, can_id: str = "can_id", data: str = "data", drop: tuple[str, ...] = ("data",)) -> DataFrame:
    """Signals of regular frames. Ids with container rows are left to the PDUs."""
    regular = defs.where("pdu_id is null").join(defs.where("pdu_id is not null").select("message_id").distinct(), "message_id", "left_anti")
    return decode(frames, regular, {can_id: "message_id"}, data, enums, drop)


def decode_pdus(pdus: DataFrame, defs: DataFrame, enums: DataFrame | None = None, drop: tuple[str, ...] = ("pdu_payload",)) -> DataFrame:
    return decode(pdus, defs.where("pdu_id is not null"), {"can_id": "message_id", "pdu_id": "pdu_id"}, "pdu_payload", enums, drop)


def decode_someip(messages: DataFrame, defs: DataFrame, enums: DataFrame | None = None, drop: tuple[str, ...] = ("payload",)) -> DataFrame:
    return decode(messages, defs, {"someip_service_id": "service_id", "someip_method_id": "method_id"}, "payload", enums, drop)


def split_pdus(data: bytes, long_header: bool = False, skip_padding: bool = False) -> list[tuple[int, bytes]]:
    """(pdu id, payload) of a container frame; a cut header or payload ends it.
    Zero padding reads as empty PDUs of id 0 unless skipped."""
    out, at, n = [], 0, len(data)
    head = 8 if long_header else 4
    while at + head <= n:
        if long_header:
            pdu, size = int.from_bytes(data[at : at + 4], "big"), int.from_bytes(data[at + 4 : at + 8], "big")
        else:
            pdu, size = int.from_bytes(data[at : at + 3], "big"), DLC_BYTES[data[at + 3]] if data[at + 3] < 16 else data[at + 3]
        at += head
        if at + size > n:
            break
        if pdu or size or not skip_padding:
            out.append((pdu, data[at : at + size]))
        at += size
    return out


def split_all(column: pa.Array, long_header: bool, skip_padding: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(frame, pdu id, payload) as ``split_pdus`` cuts every frame of a column;
    all frames advance by one PDU a pass."""
    data, offsets = flat(column)
    frame = np.flatnonzero(~np.asarray(column.is_null()))
    at, end = offsets[frame], offsets[frame + 1]
    head, codes = (8 if long_header else 4), np.array([*DLC_BYTES, *range(16, 256)])
    passes = []
    while len(frame := frame[live := at + head <= end]):
        at, end = at[live], end[live]
        if long_header:
            pdu, size = big_endian(data, at, 4), big_endian(data, at + 4, 4)
        else:
            pdu, size = big_endian(data, at, 3), codes[data[at + 3]]
        whole = at + head + size <= end
        frame, at, end, pdu, size = (x[whole] for x in (frame, at, end, pdu, size))
        kept = (pdu != 0) | (size != 0) | (not skip_padding)
        passes.append((frame[kept], pdu[kept], at[kept] + head, size[kept]))
        at = at + head + size
    index, pdu, start, size = (np.concatenate(x) for x in zip(*passes)) if passes else [np.empty(0, np.int64)] * 4
    order = np.argsort(index, kind="stable")  # frame by frame, PDUs in their order
    return index[order], pdu[order], sliced(data, start[order], size[order])


def demux(frames: DataFrame, defs: DataFrame, long_header: bool = False, skip_padding: bool = False, drop: tuple[str, ...] = ("data",)) -> DataFrame:
    """One row per PDU of the container frames: pdu_id, pdu_payload."""
    ids = [r[0] for r in bounded(defs.where("pdu_id is not null").select("message_id").distinct(), "container ids")]
    kept = [c for c in frames.columns if c not in drop]

    def run(batches):
        for b in batches:
            column = b.column("data")
            index, pdus, payloads = split_all(column if column.type == pa.binary() else column.cast(pa.binary()), long_header, skip_padding)
            take = pa.array(index)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in kept), pa.array(pdus), payloads], names=[*kept, "pdu_id", "pdu_payload"])

    out = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in kept) + ", pdu_id long, pdu_payload binary"
    container = frames.where(F.col("can_id").isin(ids) if ids else F.lit(False)).where("data is not null")
    return container.mapInArrow(run, out)


def bits_sql(data: Column, start: int, length: int, order: str = "Intel") -> Column:
    """The same bit field as an expression, for few fixed fields (up to 63 bits)."""
    s = compile_signal("", start, length, order, False, 1.0, 0.0)
    total: Column = F.lit(0).cast("long")
    for byte, shift, mask, place in s.slices:
        b = F.conv(F.hex(F.substring(data, byte + 1, 1)), 16, 10).cast("long")
        total = total + F.shiftleft(F.shiftright(b, shift).bitwiseAND(F.lit(mask)), place)
    return F.when(F.length(data) >= s.reach, total)
