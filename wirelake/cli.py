"""Command line: ``python -m wirelake.cli check|convert|parse``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions.bytes import hex_preview
from wirelake.operators import decode
from wirelake.sinks import csv, logs, trace
from wirelake.sources import blf, definitions, mdf4
from wirelake.sources.network_descriptions import defs_from_arxml, defs_from_dbc


def session() -> SparkSession:
    s = SparkSession.builder.appName("wirelake").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def check(spark: SparkSession, path: str) -> int:
    """Prints all errors of a definition file; 0 without any."""
    first = next((r["value"].strip() for r in spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").limit(1).collect()), "")
    kind = definitions.detect_kind(first)
    if kind is None:
        print(f"error: cannot tell the kind of {path} from its header {first!r}", file=sys.stderr)
        return 1
    errors = definitions.check_file(spark, path, kind).collect()
    for e in errors:
        print(f"{path}:{e['line']}: {e['message']}", file=sys.stderr)
    print(f"{len(errors)} error(s) found" if errors else f"{path}: OK", file=sys.stderr if errors else sys.stdout)
    return int(bool(errors))


def convert(spark: SparkSession, source: str, target: str, overlay: str | None = None) -> int:
    """A network description as a definition CSV; the number of signals."""
    if source.lower().endswith(".dbc"):
        defs = defs_from_dbc(spark, source)
    elif source.lower().endswith((".arxml", ".xml")):
        defs = defs_from_arxml(spark, [source])
    else:
        raise SystemExit(f"error: unrecognised format for {source!r} (expected .dbc or .arxml)")
    if overlay:
        defs = definitions.merge(defs, definitions.load(spark, overlay, "can"))
    rows = definitions.canonical(defs).collect()  # a definition file
    with open(target, "w") as f:
        f.write(",".join(definitions.CAN_COLUMNS) + "\n")
        for r in rows:
            f.write(",".join(str(x).lower() if isinstance(x, bool) else str(x) for x in r) + "\n")
    return len(rows)


def read(spark: SparkSession, path: str, threads: int = 1) -> DataFrame:
    if not path.lower().endswith(".blf"):
        return mdf4.read_mdf4(spark, path)
    with blf.open_file(path) as f:
        _, offsets = blf.scan_containers(f)
    per = -(-len(offsets) // threads) if offsets and threads > 1 else 0
    return blf.read_blf(spark, path, containers_per_partition=per)


def decoded(log: DataFrame, can: DataFrame | None, someip: DataFrame | None, enums: DataFrame | None) -> DataFrame | None:
    """Signals with the columns of the signal lines; TCP counts for SOME/IP too,
    and only a frame's first message does."""
    from wirelake.operators.network import parse_someip

    parts = []
    shared = ["_source_file", "start_ns", "timestamp_ns", "message_type", "channel"]
    out = [*shared, "message_id", "signal_name", "signal_value", "signal_str"]
    if can is not None:
        frames = log.where(F.col("message_type").startswith("CAN")).select(*shared, "can_id", "data")
        pdus = decode.decode_pdus(decode.demux(frames, can), can, enums, drop=("pdu_id", "pdu_payload"))
        parts += [x.withColumn("message_id", csv.can_message_id()).select(*out) for x in (decode.decode_can(frames, can, enums), pdus)]
    if someip is not None:
        eth = log.where(F.col("message_type").startswith("ETH")).select(*shared, "ether_type", "data")
        messages = parse_someip(eth, first_only=True, drop=("ether_type", "data"))
        parts.append(decode.decode_someip(messages, someip, enums).withColumn("message_id", csv.someip_message_id()).select(*out))
    total = None
    for p in parts:
        total = p if total is None else total.unionByName(p)
    return total


def pdu_counts(log: DataFrame, can: DataFrame) -> DataFrame:
    """Occurrences of each PDU with the names of its signals."""
    pdus = decode.demux(log.where(F.col("message_type").startswith("CAN")).select("can_id", "data"), can).groupBy("can_id", "pdu_id").agg(F.count(F.lit(1)).alias("count"))
    named = can.where("pdu_id is not null").groupBy(F.col("message_id").alias("can_id"), "pdu_id").agg(F.concat_ws(", ", F.collect_list("signal_name")).alias("signals"))
    return pdus.join(named, ["can_id", "pdu_id"], "left").orderBy("can_id", "pdu_id").select(F.concat(F.lit("0x"), F.hex("can_id")).alias("can_id"), F.concat(F.lit("0x"), F.hex("pdu_id")).alias("pdu_id"), "count", F.coalesce("signals", F.lit("")).alias("signals"))


def boundary_warnings(log: DataFrame) -> DataFrame:
    """Places of a file where time runs backwards."""
    from pyspark.sql import Window

    before = F.lag("timestamp_ns").over(Window.partitionBy("_source_file").orderBy("row_in_file"))
    steps = log.select("_source_file", "row_in_file", "timestamp_ns", before.alias("previous_ns")).where("timestamp_ns < previous_ns")
    return steps.withColumn("delta_ns", F.col("previous_ns") - F.col("timestamp_ns"))


def console_rows(log: DataFrame) -> DataFrame:
    shown = ["timestamp_ns", "message_type", "channel", "dir", "can_id", "is_ext_id", "dlc", "ether_type", "vlan_id"]
    return log.select(*shown, hex_preview("data").alias("data")).orderBy("timestamp_ns")


def write(log: DataFrame, signals: DataFrame | None, target: str, channels: DataFrame | None, repeat: int, start_ns: int) -> int:
    kind = target.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        lines, header = (csv.raw_lines(log, channels), csv.RAW_HEADER) if signals is None else (csv.signal_lines(signals, channels), csv.SIGNAL_HEADER)
        n = 0
        with open(target, "w") as f:
            f.write(header + "\n")
            for r in lines.orderBy("timestamp_ns").toLocalIterator():
                f.write(r["line"] + "\n")
                n += 1
        return n
    if kind in ("blf", "mf4", "mdf"):
        n, writer = 0, (blf if kind == "blf" else mdf4).Writer
        with open(target, "w+b") as f:
            w = writer(f, start_ns)
            for r in logs.repeat(log, repeat).orderBy("timestamp_ns", "row_in_file").toLocalIterator():
                w.write(r.asDict())
                n += 1
            w.close()
        return n
    if kind == "perfetto-trace":
        samples = log.where("message_type = 'MF4_SIGNAL'").select("timestamp_ns", "mf4_group", "mf4_name", "mf4_value", "mf4_unit")
        both = samples if signals is None else samples.unionByName(signals.select("timestamp_ns", "signal_name", "signal_value"), allowMissingColumns=True)
        return trace.write_log_trace(both, target, start_ns)
    raise SystemExit(f"error: unsupported output {target!r}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wirelake", description="Read and convert in-vehicle log files")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("check", help="check a definition CSV")
    c.add_argument("path")
    c = commands.add_parser("convert", help="convert a DBC or ARXML description to a definition CSV")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--overlay")
    c = commands.add_parser("parse", help="parse a log; optionally write .csv, .blf, .mf4, .mdf or .perfetto-trace")
    c.add_argument("input")
    c.add_argument("output", nargs="?")
    for name in ("can-signals", "someip-signals", "enum-signals", "channels"):
        c.add_argument(f"--{name}")
    c.add_argument("--repeat", type=int, default=1)
    c.add_argument("--threads", type=int, default=1)
    c.add_argument("-q", "--quiet", action="store_true")
    c.add_argument("--pdu-list", action="store_true")
    a = parser.parse_args(argv)
    spark = session()
    if a.command == "check":
        return check(spark, a.path)
    began = time.perf_counter()
    if a.command == "convert":
        n = convert(spark, a.input, a.output, a.overlay)
        print(f"wrote {n} signal(s) to {a.output} in {time.perf_counter() - began:.3f}s")
        return 0

    def load(path: str | None, kind: str) -> DataFrame | None:
        return definitions.load(spark, path, kind) if path else None

    log = read(spark, a.input, a.threads)
    can, someip, enums, channels = load(a.can_signals, "can"), load(a.someip_signals, "someip"), load(a.enum_signals, "enum"), load(a.channels, "channel")
    signals = decoded(log, can, someip, enums)
    for w in boundary_warnings(log).limit(20).collect() if a.threads > 1 else ():
        print(f"WARNING: time runs back {w['delta_ns']} ns at row {w['row_in_file']}", file=sys.stderr)
    if a.output:
        head = log.select("start_ns").first()
        n = write(log, signals, a.output, channels, a.repeat, head[0] if head else 0)
    else:
        n = log.count()
        if not a.quiet:
            console_rows(log).show(1000, truncate=False) if signals is None else signals.orderBy("timestamp_ns").show(1000, truncate=False)
    if a.pdu_list and can is not None:
        pdu_counts(log, can).show(10_000, truncate=False)
    print(f"{n} object(s) in {time.perf_counter() - began:.3f}s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
