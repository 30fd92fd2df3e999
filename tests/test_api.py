"""Single-message access, the command line and answer interpretation."""

import pytest
from test_logs import CAN_CSV, CONTAINER, DBC, ENUM_CSV, ROWS, SOMEIP_CSV, START, doip, ipv4, someip, tcp, udp

from wirelake import api, cli
from wirelake.functions.time import parse_time_range
from wirelake.plans import answers
from wirelake.sources import blf


@pytest.fixture
def folder(tmp_path):
    for name, text in (("can.csv", CAN_CSV), ("someip.csv", SOMEIP_CSV), ("enum.csv", ENUM_CSV), ("net.dbc", DBC), ("ch.csv", "type,channel,name\nCAN,1,Body\n")):
        (tmp_path / name).write_text(text)
    blf.write_rows(str(tmp_path / "a.blf"), ROWS, START)
    return tmp_path


def test_reader(folder):
    r = api.Reader(str(folder / "a.blf"))
    assert r.start_time_ns() == START and next(r)["can_id"] == 0x100
    b = r.read_batch(3)
    assert b["message_type"] == ["CAN_FD", "CAN_FD64", "ETH"] and len(b) == 22 and len(r.read_batch()["dlc"]) == 5 and r.read_batch() is None
    assert {x["message_type"] for x in api.Reader(str(folder / "a.blf"), ["CanFd", "ethernetex"])} == {"CAN_FD", "ETH_EX"}
    with pytest.raises(ValueError):
        api.Reader(str(folder / "a.blf"), ["Lin"])


def test_signal_databases(folder):
    db = api.CanSignalDb(str(folder / "can.csv"), str(folder / "enum.csv"))
    assert db.decode(0x100, bytes.fromhex("800003")) == [("EngineSpeed_rpm", 16.0, None), ("Gear", 3.0, "Third")] and db.decode(0x100, b"\x80\0") == [("EngineSpeed_rpm", 16.0, None)]
    assert db.is_container(0x600) and db.container_can_ids() == [0x600] and db.decode(0x600, CONTAINER) == [] and len(db) == 4
    assert db.extract_container_pdus(0x600, CONTAINER)[0] == (1, bytes.fromhex("1000000000")) and db.extract_container_pdus(0x100, CONTAINER) == []
    assert db.decode_container(0x600, CONTAINER) == [("Radar_Distance_m", 0.16, None), ("CabinTemp_degC", -30.0, None)] and db.decode_pdu(0x600, 2, b"\x14\0\0") == [("CabinTemp_degC", -30.0, None)]
    db.merge(api.CanSignalDb.from_rows([["0x100", "Gear", "2", "0", "8", "Intel", "0", "2", "1"]]))
    assert db.decode(0x100, bytes.fromhex("800003"))[1][1] == 7.0
    assert api.SomeIpSignalDb(str(folder / "someip.csv")).decode(0x64, 1, b"\x10\0") == [("MotorSpeed_rpm", 16.0, None)]
    assert api.ChannelDb(str(folder / "ch.csv")).name("can", 1) == "Body" and api.ChannelDb(str(folder / "ch.csv")).name("Ethernet", 1) is None
    with pytest.raises(ValueError, match="line 1"):
        api.CanSignalDb.from_rows([["1", "x"]])


def test_protocol_functions():
    assert api.parse_uds(bytes.fromhex("22F190")) == ("Request", 0x22, "ReadDataByIdentifier", None, None, b"\xf1\x90") and api.parse_uds(b"\x7f\x22") is None
    assert api.parse_uds(bytes.fromhex("7F2278"))[3:5] == (0x78, "RequestCorrectlyReceivedResponsePending")
    r = api.IsoTpReassembler()
    assert r.push(bytes.fromhex("100962F190ABCDEF")) is None and r.push(bytes.fromhex("21010203"))[5] == bytes.fromhex("F190ABCDEF010203")
    assert r.push(bytes.fromhex("000322F190"))[0] == "Request" and r.push(b"\x05") is None and r.push(b"") is None
    assert api.is_diagnostic_can_id(0x7E8) and api.is_diagnostic_can_id(0x18DA10F1) and not api.is_diagnostic_can_id(0x100)
    frame = ipv4(17, udp(1, 2, someip(0x64, 1, b"ab") + someip(0x64, 2, b"")))
    assert [m["someip_method_id"] for m in api.parse_someip_udp(0x0800, frame)] == [1, 2] and api.parse_someip_udp(0x0800, frame)[0]["payload"] == b"ab"
    assert api.parse_doip_diag(0x0800, ipv4(6, tcp(13400, 2, doip(b"\x22\x01")))) == [(1, 2, b"\x22\x01")] and api.parse_doip_diag(0x0800, ipv4(6, tcp(1, 2, doip(b"\x22")))) == []
    assert {s["signal_name"] for s in api.parse_eth_payload_signals(0x0800, frame)} >= {"ip.src", "udp.payload_bytes"} and api.parse_eth_payload_signals(1, b"") == []


def test_command_line(spark, folder, capsys):
    assert cli.check(spark, str(folder / "can.csv")) == 0
    (folder / "bad.csv").write_text("message_id,signal_name,start_byte\nx,y\n")
    assert cli.check(spark, str(folder / "bad.csv")) == 1 and cli.check(spark, str(folder / "net.dbc")) == 1
    assert cli.convert(spark, str(folder / "net.dbc"), str(folder / "out.csv"), str(folder / "can.csv")) == 8
    assert (folder / "out.csv").read_text().splitlines()[1].startswith("0x100,BrakeForce,3,0,12,Motorola,true,0.1,-100")
    assert cli.check(spark, str(folder / "out.csv")) == 0
    log = cli.read(spark, str(folder / "a.blf"), 2)
    load = lambda n, k: cli.definitions.load(spark, str(folder / n), k)
    signals = cli.decoded(log, load("can.csv", "can"), load("someip.csv", "someip"), load("enum.csv", "enum"))
    assert cli.write(log, signals, str(folder / "s.csv"), load("ch.csv", "channel"), 1, START) == 7
    text = (folder / "s.csv").read_text()
    assert "1000000,2024-01-01T00:00:00.001000000Z,Body,0x100,EngineSpeed_rpm,16,\n" in text and ",0x00640001,MotorSpeed_rpm,16," in text
    assert cli.write(log, None, str(folder / "r.csv"), None, 1, START) == len(ROWS) and cli.write(log, None, str(folder / "b.blf"), None, 3, START) == 3 * len(ROWS)
    assert cli.read(spark, str(folder / "b.blf")).count() == 3 * len(ROWS) and cli.write(log, signals, str(folder / "t.perfetto-trace"), None, 1, START) == 7
    assert [(r["can_id"], r["pdu_id"], r["count"]) for r in cli.pdu_counts(log, load("can.csv", "can")).collect()] == [("0x600", "0x0", 2), ("0x600", "0x1", 2), ("0x600", "0x2", 2)]
    assert cli.boundary_warnings(log).count() == 0 and cli.console_rows(log).count() == len(ROWS)


KNOWN = [{"signal_source": s, "channel": c, "signal_name": n} for s, c, n in (("CAN", 1, "Speed"), ("SOMEIP", 2, "Speed"), ("CAN", 1, "Brake"))]
BOUNDS = {"min": 0.0, "max": 100.0, "t0": "2024-01-01T10:00:00"}


def answer(text="", rows=()):
    return {"status": "done", "text": text, "sql_rows": list(rows)}


def test_answers():
    assert answers.signals_in("CAN1::Speed rose", [], KNOWN) == ["CAN1::Speed"] and answers.signals_in("the brake", [], KNOWN) == ["CAN1::Brake"]
    rows = [{"signal_name": "Speed", "signal_source": "CAN"}, {"signal_name": "Brake", "signal_source": "CAN", "channel": 1}, {"signal_name": "Brake", "signal_source": "CAN", "channel": 1}]
    assert answers.signals_in("", rows, KNOWN) == ["CAN1::Brake", "CAN1::Speed"] and answers.signals_in("speed only", rows, KNOWN) == ["CAN1::Speed"]
    marks = [{"timestamp_s": 50, "signal_name": "Brake", "signal_source": "CAN", "channel": 1, "label": "spike"}, {"timestamp_s": "x"}]
    v = answers.interpret(answer("look", marks), KNOWN, BOUNDS)
    assert v.anomalies == [{"timestamp_s": 50.0, "label": "Brake: spike", "signal_key": "CAN1::Brake"}] and (v.t_lo, v.t_hi) == (20.0, 80.0)
    assert answers.interpret(answer("the last 10 seconds of brake"), KNOWN, BOUNDS).t_lo == 90.0
    ranged = answers.interpret(answer("", [{"min_timestamp_s": 5, "max_timestamp_s": 9}]), KNOWN, BOUNDS)
    assert (ranged.t_lo, ranged.t_hi, ranged.anomalies) == (5.0, 9.0, [])
    scoped = answers.interpret(answer("Speed Brake", [{"signal_name": "Brake", "signal_source": "CAN", "channel": 1, "_source_file": "b"}]), KNOWN, BOUNDS, lambda keys: ({"CAN1::Brake": ["a", "b"]}, []))
    assert scoped.extra_scope == {"CAN1::Brake": ["b"]}
    assert answers.interpret(answer("CAN1::Speed"), KNOWN, None, lambda keys: ({}, keys)).unknown_signals == ["CAN1::Speed"]
    assert answers.interpret(answer("nothing here"), KNOWN, BOUNDS) is None and answers.interpret({"status": "error", "text": "", "sql_rows": []}, KNOWN, BOUNDS) is None
    prefix = answers.context_prefix(["a.blf"], None, ["CAN1", "CAN2"])
    assert [x for x in ("_source_file", "a.blf", "signal_source and channel", "CAN1 | CAN2") if x not in prefix] == [] and "signal_name" not in prefix and answers.context_prefix() == ""
    assert parse_time_range("10:00:10 to 10:00:20", 0, 100, 36000.0) == (10, 20) and parse_time_range("between 50s and 80s", 5, 100) == (55, 85)
