"""Codecs, protocols, definitions and sinks."""

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirelake.operators import decode as D
from wirelake.operators import network
from wirelake.operators.diagnostics import Reassembler, isotp_frame, reassemble_isotp, with_uds_fields
from wirelake.plans import tables as T
from wirelake.sinks import csv, logs, trace
from wirelake.sources import blf, definitions, files, mdf4, network_descriptions, sheets
from wirelake.streaming.ingest import Definitions, Ingestion, stream_isotp

START = 1_704_067_200_000_000_000
CAN_CSV = """message_id,signal_name,start_byte,start_bit,bit_length,byte_order,is_signed,scale,offset,pdu_id
# comment
0x100,EngineSpeed_rpm,0,0,16,Intel,false,0.125,0.0,
0x100,Gear,2,0,8,intel,0,,,
0x600,Radar_Distance_m,0,0,16,Intel,false,0.01,0.0,0x01
0x600,CabinTemp_degC,0,0,8,Intel,true,0.5,-40.0,0x02
"""
SOMEIP_CSV = """service_id,method_id,signal_name,start_byte,start_bit,bit_length,byte_order,is_signed,scale,offset
0x0064,0x0001,MotorSpeed_rpm,0,0,16,Intel,false,1.0,0.0
"""
ENUM_CSV = "signal_name,raw_value,category\nGear,3,Third\nGear,4,Fourth\n"


def ipv4(proto, payload, total=None):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, total or 20 + len(payload), 0, 0, 64, proto, 0, b"\x0a\0\0\1", b"\x0a\0\0\2") + payload


def udp(s, d, p):
    return struct.pack(">HHHH", s, d, 8 + len(p), 0) + p


def tcp(s, d, p, flags=0x18):
    return struct.pack(">HHIIHHHH", s, d, 0, 0, 5 << 12 | flags, 0, 0, 0) + p


def someip(svc, mth, p, proto=1, kind=2, length=None):
    return struct.pack(">HHIHHBBBB", svc, mth, length or 8 + len(p), 0, 1, proto, 1, kind, 0) + p


def doip(uds, kind=0x8001, version=2):
    body = struct.pack(">HH", 1, 2) + uds
    return struct.pack(">BBHI", version, 0xFD, kind, len(body)) + body


def can(ts, can_id, data, kind="CAN", channel=1, **more):
    return dict(timestamp_ns=ts, message_type=kind, channel=channel, can_id=can_id, is_ext_id=False, dir=1, rtr=False, dlc=len(data), data=data, fdf=True, brs=False, esi=True) | more


def eth(ts, data, kind="ETH", ether_type=0x0800, vlan=True):
    tag = dict(vlan_tpid=0x8100, vlan_cos=3, vlan_id=5) if vlan else {}
    return dict(timestamp_ns=ts, message_type=kind, channel=2, dir=0, src_addr=b"\1\2\3\4\5\6", dst_addr=b"\6\5\4\3\2\1", ether_type=ether_type, data=data, **tag)


CONTAINER = bytes.fromhex("0000010510000000000000020314000000000000")
ROWS = [
    can(1_000_000, 0x100, bytes.fromhex("8000040000000000")),
    can(2_000_000, 0x600, CONTAINER, "CAN_FD"),
    can(3_000_000, 0x600, CONTAINER, "CAN_FD64", is_ext_id=True, rtr=True, dir=2),
    eth(4_000_000, ipv4(17, udp(5000, 5001, someip(0x64, 1, b"\x10\0") + someip(0x64, 1, b"\x20\0")))),
    eth(5_000_000, ipv4(6, tcp(1, 13400, doip(b"\x22\xf1\x90") + doip(b"\x62\xf1\x90\1")))),
    eth(6_000_000, ipv4(6, tcp(8080, 443, b"")), "ETH_EX", vlan=False),
    can(7_000_000, 0x7E8, bytes.fromhex("100962F190ABCDEF")),
    can(8_000_000, 0x7E8, bytes.fromhex("2101020300000000")),
    can(8_500_000, 0x7E0, bytes.fromhex("0322f19000000000")),
]


@pytest.fixture(scope="module")
def log_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs") / "drive001.blf"
    blf.write_rows(str(path), ROWS, START)
    return str(path)


@pytest.fixture(scope="module")
def defs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("defs")
    for name, text in (("can", CAN_CSV), ("someip", SOMEIP_CSV), ("enum", ENUM_CSV)):
        (folder / f"{name}.csv").write_text(text)
    return {n: definitions.load(spark, str(folder / f"{n}.csv"), n) for n in ("can", "someip", "enum")}


def same(row, want):
    for k, v in want.items():
        if k in ("fdf", "brs", "esi") and want["message_type"] == "CAN":
            v = None
        got = row[k]
        assert (bytes(got) if isinstance(got, bytearray) else got) == v, (k, got, v)


def test_blf_round_trip(spark, log_file):
    rows = blf.read_blf(spark, log_file).orderBy("row_in_file").collect()
    assert len(rows) == len(ROWS) and all(r["start_ns"] == START for r in rows)
    for r, want in zip(rows, ROWS):
        same(r, want)


def test_type_filter_and_shared_reader(spark, log_file):
    assert {r[0] for r in blf.read_blf(spark, log_file, ["ETH", "CAN_FD"]).select("message_type").distinct().collect()} == {"ETH", "CAN_FD"}
    df = blf.read_blf(spark, log_file)
    both = df.where("message_type = 'CAN'").unionByName(df.where("message_type = 'ETH'"))
    assert both.groupBy("message_type").count().collect() and both.count() == 6


def test_container_split_equals_whole(spark, tmp_path):
    rows = [can(i, 0x100 + i % 3, bytes([i % 256] * 8)) for i in range(5000)]
    blf.write_rows(str(tmp_path / "a.blf"), rows, START)
    whole = blf.read_blf(spark, str(tmp_path)).select("timestamp_ns", F.hex("data")).orderBy("timestamp_ns").collect()
    split = blf.read_blf(spark, str(tmp_path), containers_per_partition=3)
    assert split.rdd.getNumPartitions() > 5
    assert split.select("timestamp_ns", F.hex("data")).orderBy("timestamp_ns").collect() == whole and len(whole) == 5000


def raw_file(path, containers, compress=False):
    with open(path, "wb") as f:
        f.write(blf.FileHeader(144, 0, 0, 0, START, 0).pack())
        for c in containers:
            body = zlib.compress(c) if compress else c
            size = len(body) + 32
            f.write(blf.OBJECT_HEADER.pack(b"LOBJ", 16, 1, size, 10) + blf.CONTAINER_HEADER.pack(2 if compress else 0, len(c)) + body + bytes((size - 32) % 4))


def objects(rows):
    blank = dict.fromkeys(("vlan_tpid", "vlan_cos", "vlan_id"))
    out = b""
    for r in rows:
        code, payload = blf.encode_message(blank | r)
        out += blf.OBJECT_HEADER.pack(b"LOBJ", 16, 1, len(payload) + 32, code) + struct.pack("<IHHQ", 1, 0, 0, r["timestamp_ns"] // 10_000) + payload
    return out


@pytest.mark.parametrize("cut", [1, 15, 16, 40, 48, 60])
def test_objects_span_containers(tmp_path, cut):
    buf = objects([can(10_000, 1, bytes(8)), can(20_000, 2, bytes(range(8)))])
    raw_file(tmp_path / "x.blf", [buf[:cut], buf[cut:]], compress=cut % 2 == 0)
    got = [r for _, b in blf.read_batches(str(tmp_path / "x.blf")) for r in b.to_pylist()]
    assert [(r["timestamp_ns"], r["can_id"]) for r in got] == [(10_000, 1), (20_000, 2)]


def test_many_containers_are_read_in_few_tasks(tmp_path, monkeypatch):
    raw_file(tmp_path / "m.blf", [objects([can(k, k, bytes(8)) for k in range(2 * i, 2 * i + 2)]) for i in range(2500)])
    raw_file(tmp_path / "n.blf", [objects([can(9, 9, bytes(8))])])
    reader = blf.BlfReader({"path": str(tmp_path), "containersPerPartition": "1", "types": "CAN"})
    slices = reader.partitions()
    assert 500 < len(slices) <= blf.MOST_PARTITIONS + 2
    opened = blf.open_file
    heads = 0

    class Counted:
        def __init__(self, f):
            self.f, self.read = f, f.read

        def seek(self, at):
            nonlocal heads
            heads += 1
            return self.f.seek(at)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    monkeypatch.setattr(blf, "open_file", lambda path: Counted(opened(path)))
    got = [r for s in slices for b in reader.read(s) for r in b.to_pylist()]
    assert heads < 4 * 2500  # not every header for every slice
    assert sorted(r["can_id"] for r in got if r["_source_file"].endswith("m.blf")) == list(range(5000))
    assert len(got) == 5001 and len({(r["_source_file"], r["row_in_file"]) for r in got}) == 5001


def test_an_object_over_many_containers(tmp_path):
    buf = objects([can(1, 1, bytes(8)), dict(can(2, 2, bytes(8)), message_type="ETH", data=bytes(1600), src_addr=bytes(6), dst_addr=bytes(6), ether_type=0x800), can(3, 3, bytes(8))])
    raw_file(tmp_path / "w.blf", [buf[k : k + 16] for k in range(0, len(buf), 16)])
    reader = blf.BlfReader({"path": str(tmp_path / "w.blf"), "containersPerPartition": "2"})
    got = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert [r["message_type"] for r in got] == ["CAN", "ETH", "CAN"] and got[1]["data"] == bytes(1600)


def test_slices_meet_inside_an_object(tmp_path):
    buf = objects([can(10_000 * i, i, bytes(8)) for i in range(9)])
    path = str(tmp_path / "y.blf")
    raw_file(path, [buf[i : i + 70] for i in range(0, len(buf), 70)])
    with open(path, "rb") as f:
        _, offsets = blf.scan_containers(f)
    got = []
    for k in range(0, len(offsets), 2):
        got += [r["can_id"] for _, b in blf.read_batches(path, None, offsets[k : k + 2], offsets[k + 2 :], k == 0) for r in b.to_pylist()]
    assert got == list(range(9))


def test_direct_mode_and_bad_files(tmp_path):
    direct = blf.FileHeader(144, 0, 0, 0, 0, 0).pack() + objects([can(10_000, 7, bytes(8))])
    (tmp_path / "d.blf").write_bytes(direct)
    assert [b.num_rows for _, b in blf.read_batches(str(tmp_path / "d.blf"))] == [1]
    for name, raw in (("magic", b"XXXX" + direct[4:]), ("short", direct[:50]), ("cut", direct[:-3])):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(blf.BlfError):
            list(blf.read_batches(str(tmp_path / name)))
    raw_file(tmp_path / "t.blf", [objects([can(10_000, 1, bytes(8))])[:-1]])
    with pytest.raises(blf.BlfError):
        list(blf.read_batches(str(tmp_path / "t.blf")))


def test_system_time():
    for ns in (0, START, START + 123_000_000):
        assert blf.system_time_ns(blf.system_time(ns)) == ns
    assert blf.system_time_ns((2024, 13, 0, 1, 0, 0, 0, 0)) == 0


@pytest.mark.parametrize("compress", [False, True])
def test_mdf4_round_trip(spark, tmp_path, compress):
    samples = [dict(timestamp_ns=i * 1000, message_type="MF4_SIGNAL", mf4_group="Engine", mf4_name=n, mf4_value=i * 1.5, mf4_unit=u) for i in range(5) for n, u in (("rpm", "1/min"), ("temp", "C"))]
    path = str(tmp_path / "a.mf4")
    mdf4.write_rows(path, [*ROWS, *samples], START, compress)
    rows = mdf4.read_mdf4(spark, path).collect()
    assert {r["start_ns"] for r in rows} == {START}
    frames = sorted((r for r in rows if r["message_type"].startswith("CAN")), key=lambda r: r["timestamp_ns"])
    want = [r for r in ROWS if r["message_type"].startswith("CAN")]
    assert [(r["timestamp_ns"], r["can_id"], bytes(r["data"]), r["is_ext_id"]) for r in frames] == [(w["timestamp_ns"], w["can_id"], w["data"], w["is_ext_id"]) for w in want]
    assert [r["message_type"] for r in frames] == ["CAN", "CAN_FD", "CAN_FD", "CAN", "CAN", "CAN"]  # one FD form
    assert sum(r["message_type"] == "ETH" for r in rows) == 3
    got = sorted((r["timestamp_ns"], r["mf4_group"], r["mf4_name"], r["mf4_value"], r["mf4_unit"]) for r in rows if r["message_type"] == "MF4_SIGNAL")
    assert got == sorted((s["timestamp_ns"], "Engine", s["mf4_name"], s["mf4_value"], s["mf4_unit"]) for s in samples)
    assert mdf4.read_mdf4(spark, path, ["MF4_SIGNAL"]).count() == 10
    (tmp_path / "bad.mf4").write_bytes(b"nope" * 40)
    with pytest.raises(mdf4.Mdf4Error):
        list(mdf4.read_batches(str(tmp_path / "bad.mf4")))


@pytest.mark.parametrize("compress", [False, True])
def test_mdf4_long_lists_and_parts(spark, tmp_path, compress, monkeypatch):
    rows = [dict(timestamp_ns=i * 1000, message_type="CAN", channel=1, can_id=i, dlc=8, dir=0, data=struct.pack("<Q", i), is_ext_id=False) for i in range(3000)]
    rows += [dict(timestamp_ns=i * 1000, message_type="MF4_SIGNAL", mf4_group="g", mf4_name="x", mf4_value=float(i), mf4_unit="") for i in range(500)]
    path = str(tmp_path / "long.mf4")
    mdf4.write_rows(path, rows, START, compress, block_bytes=50, list_links=1)  # records span blocks; a chain of thousands of lists
    with open(path, "rb") as f:
        parts = mdf4.slices(mdf4.File(f), path, 10_000)
        groups = mdf4.read_index(mdf4.File(f))[1]
        assert mdf4.File(f).data(groups[1].data) == b"".join(struct.pack("<dd", i * 1000 / 1e9, float(i)) for i in range(500))
    assert len(parts) > 20 and [p.first for p in parts if p.group == 0][1:] == [p.end for p in parts if p.group == 0][:-1]
    monkeypatch.setattr(mdf4, "BATCH_ROWS", 64)
    whole = [(row, b) for _, row, b in mdf4.read_batches(path)]
    cut = [(row, b) for p in parts for _, row, b in mdf4.read_batches(path, None, p)]
    assert max(b.num_rows for _, b in whole) <= 64
    for got in (whole, cut):
        assert [r for _, b in got for r in b.column(b.schema.get_field_index("timestamp_ns")).to_pylist()] == [int(r["timestamp_ns"] / 1e9 * 1e9) for r in rows]  # seconds in doubles
        numbers = [row + i for row, b in got for i in range(b.num_rows)]
        assert numbers == [*range(3000), *((1 << 40) + i for i in range(500))]
    spark.dataSource.register(mdf4.Mdf4Source)
    df = spark.read.format("mdf4").option("bytesPerPartition", 20_000).load(path)
    assert df.rdd.getNumPartitions() > 10 and df.count() == 3500 and df.where("message_type = 'CAN'").selectExpr("sum(can_id)").first()[0] == 3000 * 2999 // 2


def test_mdf4_values():
    import numpy as np

    def value(raw, type_, bits, bit=0, byte=0, **c):
        m = np.frombuffer(raw, np.uint8).reshape(1, -1)
        return mdf4.Channel("x", "", 0, type_, bit, byte, bits, **c).values(m)[0]

    assert value(b"\xff\x01", mdf4.UINT_LE, 9) == 0x1FF and value(b"\x01\xff", mdf4.UINT_BE, 16) == 0x1FF
    assert value(b"\xfe", mdf4.INT_LE, 8) == -2 and value(b"\xff\xfe", mdf4.INT_BE, 16) == -2
    assert value(b"\xf0", mdf4.UINT_LE, 4, bit=4) == 15 and value(b"\x01", mdf4.UINT_LE, 16) == 0
    assert value(struct.pack(">f", 2.5), mdf4.FLOAT_BE, 32, a=1.0, b=2.0) == 6.0


# fixed values: bytes, start bit, length, order, raw value
BITS = [("ab00", 0, 8, "Intel", 0xAB), ("f00a", 4, 12, "Intel", 0x0AF), ("ab", 7, 8, "Motorola", 0xAB), ("001234", 15, 16, "Motorola", 0x1234)]


@pytest.mark.parametrize("raw,start,length,order,want", BITS)
def test_bit_vectors(raw, start, length, order, want):
    import numpy as np

    s = D.compile_signal("s", start, length, order, False, 1.0, 0.0)
    assert D.raw_values(s, np.frombuffer(bytes.fromhex(raw), np.uint8).reshape(1, -1))[0] == want


def test_physical_values():
    import numpy as np

    def one(raw, length, signed, scale, offset):
        s = D.compile_signal("s", 0, length, "Intel", signed, scale, offset)
        return D.physical(s, D.raw_values(s, np.frombuffer(raw, np.uint8).reshape(1, -1)))[0]

    assert one(b"\xff", 8, True, 1.0, 0.0) == -1.0 and one(b"\x64", 8, False, 0.5, -40.0) == 10.0
    assert one(b"\xff" * 8, 64, True, 1.0, 0.0) == -1.0 and one(b"\x05", 0, True, 2.0, 3.0) == 3.0
    assert D.compile_signal("s", 0, 65, "Intel", False, 1.0, 0.0) is None


@given(st.binary(min_size=1, max_size=9), st.integers(0, 40), st.integers(1, 24), st.sampled_from(["Intel", "Motorola"]))
@settings(max_examples=150, deadline=None)
def test_bits_equal_a_walk(data, start, length, order):
    import numpy as np

    s = D.compile_signal("s", start, length, order, False, 1.0, 0.0)
    at, bits = start, []
    for _ in range(length):
        bits.append((at // 8, at % 8))
        at = at + 1 if order == "Intel" else at - 1 if at % 8 else at + 15
    inside = all(b < len(data) for b, _ in bits)
    assert inside == (len(data) >= s.reach)
    if inside:
        picked = [data[b] >> k & 1 for b, k in bits]
        want = sum(v << i for i, v in enumerate(picked if order == "Intel" else picked[::-1]))
        assert D.raw_values(s, np.frombuffer(data, np.uint8).reshape(1, -1))[0] == want


def test_demux():
    assert D.split_pdus(CONTAINER[:16]) == [(1, bytes.fromhex("1000000000")), (2, bytes.fromhex("140000"))]
    assert D.split_pdus(CONTAINER) == [(1, bytes.fromhex("1000000000")), (2, bytes.fromhex("140000")), (0, b"")]
    assert D.split_pdus(CONTAINER, skip_padding=True)[-1][0] == 2
    assert D.split_pdus(struct.pack(">II", 1, 5) + bytes(5) + b"\0\0\0", True) == [(1, bytes(5))]
    assert D.split_pdus(struct.pack(">II", 1, 9) + bytes(5), True) == [] and D.split_pdus(b"\0\0\1\x09" + bytes(12)) == [(1, bytes(12))]


def test_gold(spark, log_file, defs):
    bronze = T.bronze(blf.read_blf(spark, log_file)).cache()
    gold = T.gold_from_bronze(bronze, defs["can"], defs["someip"], defs["enum"]).collect()
    values = {(r["timestamp_ns"], r["signal_name"]): (r["signal_value"], r["signal_str"], r["message_id_str"], r["dir"]) for r in gold if r["signal_source"] == "CAN"}
    assert values[1_000_000, "EngineSpeed_rpm"] == (16.0, None, "0x00000100", "Rx")
    assert values[1_000_000, "Gear"] == (4.0, "Fourth", "0x00000100", "Rx")
    assert values[2_000_000, "Radar_Distance_m"][0] == 0.16 and values[3_000_000, "CabinTemp_degC"][::3] == (-30.0, "TxRq")
    assert sorted(r["signal_value"] for r in gold if r["signal_source"] == "SOMEIP") == [16.0, 32.0]
    assert all(r["event_time"].microsecond == r["timestamp_ns"] // 1000 for r in gold)
    diag = {(r["transport"], r["timestamp_ns"], r["uds_type"]): (r["service_name"], r["data_hex"], r["can_id_hex"]) for r in T.silver_diag(bronze).collect()}
    assert diag == {
        ("CAN", 7_000_000, "PositiveResponse"): ("ReadDataByIdentifier", "F190ABCDEF010203", "0x000007E8"),
        ("CAN", 8_500_000, "Request"): ("ReadDataByIdentifier", "F190", "0x000007E0"),
        ("DOIP", 5_000_000, "Request"): ("ReadDataByIdentifier", "F190", None),
        ("DOIP", 5_000_000, "PositiveResponse"): ("ReadDataByIdentifier", "F19001", None),
    }
    silver = T.silver_eth(bronze).where("message_type = 'ETH'").first()
    assert (silver["src_mac"], silver["ether_type_hex"], silver["vlan_id"]) == ("01:02:03:04:05:06", "0x0800", 5)


def eth_df(spark, packets):
    return spark.createDataFrame([(i, t, bytearray(d)) for i, (t, d) in enumerate(packets)], "k int, ether_type int, data binary")


def test_header_signals(spark):
    arp = struct.pack(">HHBBH6s4s6s4s", 1, 0x0800, 6, 4, 2, bytes(6), b"\x0a\0\0\1", bytes(6), b"\x0a\0\0\2")
    v6 = struct.pack(">IHBB16s16s", 6 << 28, 16, 17, 9, bytes(15) + b"\1", bytes(15) + b"\2") + udp(1, 2, bytes(8))
    packets = [
        (0x0800, ipv4(6, tcp(8080, 443, b"", 0x1FF & 0x3F))), (0x0800, ipv4(17, udp(5000, 5001, bytes(12)))), (0x0806, arp), (0x86DD, v6), (0x0800, ipv4(2, b"\x16\x0a\0\0\xe0\0\0\1")),
        (0x0800, ipv4(6, b"")[:19]), (0x86DD, v6[:39]), (0x1234, b"x" * 40), (0x0800, ipv4(17, udp(1, 2, b""), total=60)), (0x0800, ipv4(6, b"\0" * 10)),
    ]
    got = {}
    for r in network.eth_signals(eth_df(spark, packets)).collect():
        got.setdefault(r["k"], {})[r["signal_name"]] = r["signal_str"] if r["signal_value"] is None else r["signal_value"]
    assert got[0]["tcp.src_port"] == 8080 and got[0]["tcp.dst_port"] == 443 and got[0]["tcp.flags"] == 63 and got[0]["ip.src"] == "10.0.0.1"
    assert got[1]["udp.payload_bytes"] == 12 and got[1]["ip.total_len"] == 40
    assert got[2] == {"arp.op": 2, "arp.op_name": "Reply", "arp.sender_ip": "10.0.0.1", "arp.target_ip": "10.0.0.2"}
    assert got[3]["ip.src"] == "0000:0000:0000:0000:0000:0000:0000:0001" and got[3]["ip.hop_limit"] == 9 and got[3]["udp.dst_port"] == 2
    assert got[4]["igmp.type_name"] == "V2MembershipReport" and got[4]["igmp.group"] == "224.0.0.1" and got[4]["igmp.max_resp_time"] == 10
    assert set(got) == {0, 1, 2, 3, 4, 9} and "tcp.src_port" not in got[9]


def test_someip_rules(spark):
    sd, broken = someip(0xFFFF, 0x8100, b""), someip(1, 1, b"", length=4)
    packets = [(0x0800, ipv4(17, udp(1, 2, p))) for p in (sd, someip(1, 1, b"", proto=2), someip(1, 1, b"", kind=3), broken, someip(1, 2, b"ab") + someip(1, 3, b"") + broken + someip(9, 9, b""), someip(0xFFFF, 1, b""))]
    packets.append((0x0800, ipv4(6, tcp(1, 2, someip(7, 7, b"")))))
    got = sorted((r["k"], r["someip_service_id"], r["someip_method_id"], r["someip_length"]) for r in network.parse_someip(eth_df(spark, packets)).collect())
    assert got == [(4, 1, 2, 10), (4, 1, 3, 8), (5, 0xFFFF, 1, 8)]
    loose = {(r["k"], r["someip_service_id"]) for r in network.parse_someip(eth_df(spark, packets), first_only=True).collect()}
    assert loose == {(0, 0xFFFF), (1, 1), (2, 1), (4, 1), (5, 0xFFFF), (6, 7)}


def test_doip_rules():
    assert len(network.doip_diag(doip(b"\x22") + doip(b"\x62"))) == 2
    assert network.doip_diag(doip(b"\x22", version=3)) == [] and network.doip_diag(doip(b"\x22", kind=0x8002)) == []


@pytest.mark.parametrize("raw,want", [("0322F190", ("SF", 3, None, "22F190")), ("000322F190", ("SF", 3, None, "22F190")), ("1009AABB", ("FF", 9, None, "AABB")), ("100000000100AA", ("FF", 256, None, "AA")), ("21AABB", ("CF", None, 1, "AABB")), ("300A05", ("FC", None, 0, "0A05")), ("05AA", None), ("00", None), ("10", None), ("3000", None), ("40", None)])
def test_isotp_frames(spark, raw, want):
    r = spark.createDataFrame([(bytearray(bytes.fromhex(raw)),)], "data binary").select(isotp_frame().alias("f")).first()["f"]
    assert (None if r is None else (r["kind"], r["total_length"], r["sequence"], bytes(r["payload"]).hex().upper())) == want


def test_reassembler():
    r = Reassembler()
    assert r.push("CF", None, 1, b"x", 1) is None
    assert r.push("FF", 9, None, b"abcdef", 2) is None and r.push("FC", None, 0, b"", 3) is None
    assert r.push("CF", None, 1, b"ghijk", 4) == (2, b"abcdefghi")
    r.push("FF", 20, None, b"a", 5)
    assert r.push("CF", None, 2, b"b", 6) is None and r.push("CF", None, 1, b"c", 7) is None  # dropped
    assert r.push("SF", 1, None, b"z", 8) == (8, b"z")
    r.push("FF", 2, None, b"abcdef", 9)  # longer than declared: done with the next frame
    assert r.push("CF", None, 1, b"x", 10) == (9, b"abcdef")


@pytest.mark.parametrize("raw,want", [("22F190", ("Request", 0x22, "ReadDataByIdentifier", None, None, "F190")), ("62F190ABCD", ("PositiveResponse", 0x22, "ReadDataByIdentifier", None, None, "F190ABCD")), ("AA00", ("Request", 0xAA, "Unknown_0xAA", None, None, "00")), ("7F2231", ("NegativeResponse", 0x22, "ReadDataByIdentifier", 0x31, "RequestOutOfRange", "")), ("7F22", None), ("", None)])
def test_uds(spark, raw, want):
    r = with_uds_fields(spark.createDataFrame([(bytearray(bytes.fromhex(raw)),)], "u binary"), "u").first()
    assert (r and (r["uds_type"], r["service_id"], r["service_name"], r["nrc"], r["nrc_name"], bytes(r["data"]).hex().upper())) == want


def test_definition_checks(spark, tmp_path):
    bad = "message_id,signal_name,start_byte,start_bit,bit_length,byte_order,is_signed,scale,offset,pdu_id\n0x1,a,0,0,8,Intel,false,1,0\n0x1,b,0,0,8,Intel,false,1,0,0x2\nzz,c,1.5,0,8,Big,maybe,x,0\n1,2,3\n"
    (tmp_path / "c.csv").write_text(bad)
    found = {(r["line"], r["message"].split(",")[0].split(" (")[0]) for r in definitions.check_file(spark, str(tmp_path / "c.csv"), "can").collect()}
    assert {(4, 'invalid message_id: "zz"'), (4, 'invalid start_byte: "1.5"'), (4, 'invalid byte_order: "Big"'), (4, 'invalid is_signed: "maybe"'), (4, 'invalid scale: "x"'), (5, "expected at least 9 columns")} <= found
    assert any(line == 2 and "both regular and container" in m for line, m in found)
    with pytest.raises(definitions.DefinitionError, match="line 4"):
        definitions.load(spark, str(tmp_path / "c.csv"), "can")
    (tmp_path / "ch.csv").write_text("type,channel,name\nCAN,1,a\ncan,1,b\n")
    with pytest.raises(definitions.DefinitionError, match="duplicate"):
        definitions.load(spark, str(tmp_path / "ch.csv"), "channel")
    assert definitions.detect_kind(CAN_CSV.splitlines()[0]) == "can" and definitions.detect_kind("a,b") is None


def test_canonical_and_merge(spark, defs):
    text = definitions.canonical(defs["can"]).collect()
    assert [(r["message_id"], r["signal_name"], r["scale"], r["pdu_id"]) for r in text] == [("0x100", "EngineSpeed_rpm", "0.125", ""), ("0x100", "Gear", "1", ""), ("0x600", "Radar_Distance_m", "0.01", "0x1"), ("0x600", "CabinTemp_degC", "0.5", "0x2")]
    again = definitions.load(spark, definitions.canonical(defs["can"]), "can")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, defs["can"].collect()), key=str)
    over = defs["can"].where("signal_name = 'Gear'").withColumn("scale", F.lit(9.0))
    merged = definitions.merge(defs["can"], over)
    assert merged.count() == 4 and merged.where("signal_name = 'Gear'").first()["scale"] == 9.0
    assert [r[0] for r in definitions.container_ids(defs["can"]).collect()] == [0x600]


DBC = """VERSION ""
BO_ 256 EngineControl: 8 ECU1
 SG_ EngineSpeed : 0|16@1+ (0.25,0) [0|16383.75] "rpm" ECU2
 SG_ Muxed m0 : 16|8@1+ (0.4,0) [0|100] "%" ECU2
 SG_ BrakeForce : 24|12@0- (0.1,-100) [-100|300] "N" ECU2
 SG_ Broken : x
BO_ 2147484160 ExtFrame: 8 ECU1
 SG_ ExtSig : 0|8@1+ (1,0) [0|255] "" ECU2
CM_ "x"
 SG_ Orphan : 0|8@1+ (1,0) [0|255] "" ECU2
"""


def test_dbc():
    got = {d[1]: d for d in network_descriptions.parse_dbc(DBC)}
    assert set(got) == {"EngineSpeed", "Muxed", "BrakeForce", "ExtSig"}
    assert got["BrakeForce"] == (256, "BrakeForce", 24, 12, "Motorola", True, 0.1, -100.0, None) and got["ExtSig"][0] == 512


ARXML = """<AUTOSAR xmlns="http://autosar.org/schema/r4.0"><AR-PACKAGES><AR-PACKAGE><SHORT-NAME>P</SHORT-NAME><ELEMENTS>
<CAN-CLUSTER><SHORT-NAME>C</SHORT-NAME><X><CAN-FRAME-TRIGGERING><SHORT-NAME>T1</SHORT-NAME><FRAME-REF>/P/F1</FRAME-REF><IDENTIFIER>256</IDENTIFIER></CAN-FRAME-TRIGGERING>
<CAN-FRAME-TRIGGERING><SHORT-NAME>T2</SHORT-NAME><FRAME-REF>/P/F2</FRAME-REF><IDENTIFIER>1536</IDENTIFIER></CAN-FRAME-TRIGGERING>
<PDU-TRIGGERING><SHORT-NAME>PT</SHORT-NAME><I-PDU-REF>/P/Inner</I-PDU-REF></PDU-TRIGGERING></X></CAN-CLUSTER>
<CAN-FRAME><SHORT-NAME>F1</SHORT-NAME><PDU-TO-FRAME-MAPPINGS><PDU-TO-FRAME-MAPPING><SHORT-NAME>m</SHORT-NAME><PDU-REF>/P/Pdu</PDU-REF><START-POSITION>16</START-POSITION></PDU-TO-FRAME-MAPPING></PDU-TO-FRAME-MAPPINGS></CAN-FRAME>
<CAN-FRAME><SHORT-NAME>F2</SHORT-NAME><PDU-TO-FRAME-MAPPINGS><PDU-TO-FRAME-MAPPING><SHORT-NAME>m</SHORT-NAME><PDU-REF>/P/Box</PDU-REF></PDU-TO-FRAME-MAPPING></PDU-TO-FRAME-MAPPINGS></CAN-FRAME>
<I-SIGNAL-I-PDU><SHORT-NAME>Pdu</SHORT-NAME><I-SIGNAL-TO-PDU-MAPPINGS><I-SIGNAL-TO-I-PDU-MAPPING><SHORT-NAME>s</SHORT-NAME><I-SIGNAL-REF>/P/Temp</I-SIGNAL-REF><PACKING-BYTE-ORDER>MOST-SIGNIFICANT-BYTE-FIRST</PACKING-BYTE-ORDER><START-POSITION>7</START-POSITION></I-SIGNAL-TO-I-PDU-MAPPING></I-SIGNAL-TO-PDU-MAPPINGS></I-SIGNAL-I-PDU>
<I-SIGNAL-I-PDU><SHORT-NAME>Inner</SHORT-NAME><CONTAINED-I-PDU-PROPS><HEADER-ID-SHORT-HEADER>5</HEADER-ID-SHORT-HEADER></CONTAINED-I-PDU-PROPS><I-SIGNAL-TO-PDU-MAPPINGS><I-SIGNAL-TO-I-PDU-MAPPING><SHORT-NAME>s</SHORT-NAME><I-SIGNAL-REF>/P/Temp</I-SIGNAL-REF><START-POSITION>0</START-POSITION></I-SIGNAL-TO-I-PDU-MAPPING></I-SIGNAL-TO-PDU-MAPPINGS></I-SIGNAL-I-PDU>
<CONTAINER-I-PDU><SHORT-NAME>Box</SHORT-NAME><CONTAINED-PDU-TRIGGERING-REFS><CONTAINED-PDU-TRIGGERING-REF>/P/C/PT</CONTAINED-PDU-TRIGGERING-REF></CONTAINED-PDU-TRIGGERING-REFS><HEADER-TYPE>SHORT-HEADER</HEADER-TYPE></CONTAINER-I-PDU>
<I-SIGNAL><SHORT-NAME>Temp</SHORT-NAME><LENGTH>12</LENGTH><NETWORK-REPRESENTATION-PROPS><SW-DATA-DEF-PROPS-VARIANTS><SW-DATA-DEF-PROPS-CONDITIONAL><BASE-TYPE-REF>/P/S12</BASE-TYPE-REF><COMPU-METHOD-REF>/P/CM</COMPU-METHOD-REF></SW-DATA-DEF-PROPS-CONDITIONAL></SW-DATA-DEF-PROPS-VARIANTS></NETWORK-REPRESENTATION-PROPS></I-SIGNAL>
<SW-BASE-TYPE><SHORT-NAME>S12</SHORT-NAME><BASE-TYPE-ENCODING>2S-COMPLEMENT</BASE-TYPE-ENCODING></SW-BASE-TYPE>
<COMPU-METHOD><SHORT-NAME>CM</SHORT-NAME><COMPU-INTERNAL-TO-PHYS><COMPU-SCALES><COMPU-SCALE><COMPU-RATIONAL-COEFFS><COMPU-NUMERATOR><V>-40</V><V>1</V></COMPU-NUMERATOR><COMPU-DENOMINATOR><V>2</V></COMPU-DENOMINATOR></COMPU-RATIONAL-COEFFS></COMPU-SCALE></COMPU-SCALES></COMPU-INTERNAL-TO-PHYS></COMPU-METHOD>
</ELEMENTS></AR-PACKAGE></AR-PACKAGES></AUTOSAR>"""


def test_arxml():
    assert network_descriptions.parse_arxml([ARXML.encode()]) == [(256, "Temp", 23, 12, "Motorola", True, 0.5, -20.0, None), (1536, "Temp", 0, 12, "Intel", True, 0.5, -20.0, 5)]


def test_sheets():
    head = ["id", "name", "byte", "bit", "len", "order", "signed", "scale", "offset", "coding", "meaning"]
    rows = [head, ["100h", "Speed", "0", "0", "16", "LE", "no", "0.5", "n/a", "0\n0x1\n2", "Off\nOn"], ["0x200", "Temp", "1.0", "2", "8", "Motorola", True, None, "-40", None, None], ["", "blank", 0], ["300", "Bad", 0, 0, 8, "sideways", "yes"], ["400", "NoLen", 0, 0, None, "be", "yes"], ["0b101", "Neg", -1, 0, 8, "be", "yes"]]
    mapping = dict(message_id="id", signal_name=1, start_byte="byte", start_bit="bit", bit_length="len", byte_order="order", is_signed="signed", scale="scale", offset="offset", coding="coding", meaning=10)
    signals, enums, errors = sheets.convert(rows, mapping, "can")
    assert [(s["message_id"], s["signal_name"], s["byte_order"], s["is_signed"], s["scale"], s["offset"]) for s in signals] == [("0x100", "Speed", "Intel", "false", "0.5", "0.0"), ("0x200", "Temp", "Motorola", "true", "1.0", "-40.0")]
    assert [(e["raw_value"], e["category"]) for e in enums] == [("0", "Off"), ("1", "On")]
    assert [e.split(":")[0] for e in errors] == ["row 2", "row 5", "row 7"] and "mismatch (3 vs 2)" in errors[0]
    with pytest.raises(ValueError):
        sheets.resolve_column("nothing", head)
    with pytest.raises(ValueError):
        sheets.resolve_column(99, head)


def test_csv_lines(spark, log_file, defs, tmp_path):
    names = spark.createDataFrame([("CAN", 1, "Body")], "type string, channel int, name string")
    df = spark.createDataFrame([("f", 0, 1_000_000, "CAN", 1, 1, 0x123, False, 3, bytearray(b"\1\2\3"), None, None, None, None, None, None), ("f", 0, 0, "CAN", 2, 0, 0x1FFFFFFF, True, 1, bytearray(b"\xff"), None, None, None, None, None, None)], "_source_file string, start_ns long, timestamp_ns long, message_type string, channel int, dir int, can_id long, is_ext_id boolean, dlc int, data binary, src_addr binary, dst_addr binary, ether_type int, vlan_id int, mf4_value double, mf4_unit string")
    lines = {r["line"] for r in csv.raw_lines(df).collect()}
    assert lines == {"1000000,1970-01-01T00:00:00.001000000Z,CAN,1,Rx,,,,0x123,false,3,010203", "0,1970-01-01T00:00:00.000000000Z,CAN,2,Tx,,,,0x1FFFFFFF,true,1,FF"}
    assert any(",CAN,Body,Rx," in r["line"] for r in csv.raw_lines(df, names).collect())
    log = blf.read_blf(spark, log_file)
    assert csv.raw_lines(log).count() == len(ROWS)
    eth_line = csv.raw_lines(log.where("message_type = 'ETH'")).orderBy("timestamp_ns").first()["line"]
    assert ",Ethernet,2,Tx,01:02:03:04:05:06,06:05:04:03:02:01,0x0800,5,,,,4500" in eth_line
    signals = spark.createDataFrame([("f", 0, 500_000, "CAN", 3, "0x200", "Voltage", 42.0, None)], "_source_file string, start_ns long, timestamp_ns long, message_type string, channel int, message_id string, signal_name string, signal_value double, signal_str string")
    assert csv.signal_lines(signals).first()["line"] == "500000,1970-01-01T00:00:00.000500000Z,3,0x200,Voltage,42,"
    csv.write_lines(csv.raw_lines(log), str(tmp_path / "out"), csv.RAW_HEADER)
    assert spark.read.text(str(tmp_path / "out")).count() == len(ROWS)


def test_log_sinks(spark, log_file, tmp_path):
    log = blf.read_blf(spark, log_file)
    (tmp_path / "b").mkdir()
    assert [r["rows"] for r in logs.write_blf(logs.repeat(log, 2), str(tmp_path / "b")).collect()] == [2 * len(ROWS)]
    back = blf.read_blf(spark, str(tmp_path / "b"))
    assert back.count() == 2 * len(ROWS) and back.where("message_type = 'ETH_EX'").first()["data"] == bytearray(ROWS[5]["data"])
    assert [r["rows"] for r in logs.write_mdf4(log, str(tmp_path / "b")).collect()] == [len(ROWS)]
    assert files.read_logs(spark, str(tmp_path / "b")).count() == 3 * len(ROWS)


def varints(raw):
    at, out = 0, []
    while at < len(raw):
        def one():
            nonlocal at
            n = shift = 0
            while True:
                b = raw[at]
                at += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n
        tag = one()
        if tag & 7 == 0:
            out.append((tag >> 3, one()))
        elif tag & 7 == 1:
            out.append((tag >> 3, struct.unpack_from("<d", raw, at)[0]))
            at += 8
        else:
            n = one()
            out.append((tag >> 3, raw[at : at + n]))
            at += n
    return out


def test_traces(spark, log_file, defs, tmp_path):
    gold = T.gold_from_bronze(T.bronze(blf.read_blf(spark, log_file), with_uds=False), defs["can"], defs["someip"])
    path = str(tmp_path / "a.trace")
    n = trace.write_log_trace(gold.where("signal_source = 'CAN'"), path, START)
    raw = open(path, "rb").read()
    assert raw[0] == 0x0A
    packets = [dict(varints(p)) for _, p in varints(raw)]
    tracks = [dict(varints(p[trace.TRACK]))[trace.TRACK_NAME].decode() for p in packets if trace.TRACK in p]
    events = [dict(varints(p[trace.TRACK_EVENT]))[trace.EVENT_DOUBLE] for p in packets if trace.TRACK_EVENT in p]
    assert len(events) == n == 6 and set(tracks) == {"EngineSpeed_rpm", "Gear", "Radar_Distance_m", "CabinTemp_degC"} and 16.0 in events
    assert trace.write_selection_trace(gold, [("CAN", 1, "EngineSpeed_rpm")], path) == 1
    assert trace.write_selection_trace(gold, [("CAN", 9, "none")], path) == 0


def test_streaming_ingestion(spark, tmp_path, defs):
    (tmp_path / "in").mkdir()
    blf.write_rows(str(tmp_path / "in" / "drive1.blf"), ROWS, START)
    (tmp_path / "in" / "broken.blf").write_bytes(b"nothing")
    (tmp_path / "in" / "notes.txt").write_text("x")
    job = Ingestion(spark, str(tmp_path / "in"), str(tmp_path / "out"), Definitions(defs["can"], defs["someip"], defs["enum"]))
    job.start().awaitTermination(300)
    gold = job.table("gold_signals")
    n = gold.count()
    assert n > 10 and job.table("silver_diag").count() == 4 and job.table("bronze").where("_file_mtime is not null").count() == len(ROWS) + 4
    assert job.views()["source_files"].count() == 1
    job.start().awaitTermination(300)
    assert job.table("gold_signals").count() == n  # nothing new
    mdf4.write_rows(str(tmp_path / "in" / "drive2.mf4"), ROWS[:1], START)
    job.start().awaitTermination(300)
    assert job.table("gold_signals").count() == n + 2


def test_streamed_isotp(spark, tmp_path):
    schema = "_source_file string, channel int, can_id long, timestamp_ns long, row_in_file long, kind string, total_length long, sequence int, payload binary"
    first = [("f", 1, 2, 10, 0, "FF", 9, None, bytearray(b"abcdef")), ("f", 1, 3, 11, 1, "SF", 1, None, bytearray(b"z"))]
    second = [("f", 1, 2, 20, 2, "CF", None, 1, bytearray(b"ghijk"))]
    folder = str(tmp_path / "frames")
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(folder)
    stream = stream_isotp(spark.readStream.schema(schema).parquet(folder))
    q = stream.writeStream.format("memory").queryName("isotp_out").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    assert {(r["can_id"], r["timestamp_ns"], bytes(r["uds"])) for r in spark.table("isotp_out").collect()} == {(3, 11, b"z"), (2, 10, b"abcdefghi")}


def test_interleaved_conversations(spark):
    schema = "_source_file string, start_ns long, row_in_file long, timestamp_ns long, message_type string, channel int, can_id long, dir byte, data binary"
    rows = []
    for i, (f, c) in enumerate([("a", 1), ("b", 1), ("a", 2)]):
        rows += [(f, 1, i, 10 + i, "CAN", c, 0x7E8, 1, bytearray(bytes.fromhex("1009") + bytes([i] * 6))), (f, 1, 10 + i, 20 + i, "CAN", c, 0x7E8, 1, bytearray(b"\x21" + bytes([i] * 7)))]
    rows.append(("a", 1, 50, 50, "CAN", 1, 0x100, 1, bytearray(b"\x01\x22")))  # no diagnostic id
    got = {(r["_source_file"], r["channel"], r["timestamp_ns"], bytes(r["uds"])) for r in reassemble_isotp(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", 1, 10, bytes([0] * 9)), ("b", 1, 11, bytes([1] * 9)), ("a", 2, 12, bytes([2] * 9))}
