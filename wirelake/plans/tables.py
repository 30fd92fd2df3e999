"""Bronze, silver and gold tables. Every table is a function from DataFrames to
a DataFrame, for batch and inside streaming queries alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.functions.bytes import direction, file_stem, hex_id, mac
from wirelake.functions.time import event_time, seconds
from wirelake.operators.decode import decode_can, decode_pdus, decode_someip, demux
from wirelake.operators.diagnostics import uds_rows
from wirelake.operators.network import eth_signals, parse_someip
from wirelake.schema import BRONZE

CAN_TYPES, ETH_TYPES, UDS_TYPES = ("CAN", "CAN_FD", "CAN_FD64"), ("ETH", "ETH_EX"), ("UDS_CAN", "UDS_DOIP")


def _complete(df: DataFrame) -> DataFrame:
    """The bronze columns in order, NULL where ``df`` has none."""
    have = set(df.columns)
    return df.select(*(F.col(n).cast(t) if n in have else F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in BRONZE.split(", "))))


def bronze(log: DataFrame, with_uds: bool = True) -> DataFrame:
    """Log rows, and the UDS messages found in them. ``log`` has the source
    columns, and the files' metadata where known."""
    stamped = log.withColumns({"event_time": event_time(), "_ingested_at": F.current_timestamp()})
    out = _complete(stamped.where("message_type <> 'OTHER'"))
    if not with_uds:
        return out
    uds = uds_rows(log).withColumns({"event_time": event_time(), "_ingested_at": F.current_timestamp()})
    if "_file_mtime" in log.columns:
        mtimes = log.select("_source_file", "_file_mtime").distinct()
        uds = uds.join(mtimes, "_source_file", "left")
    return out.unionByName(_complete(uds))


_WHEN = ["_source_file", "_ingested_at", "message_type", "timestamp_ns", "timestamp_s", "event_time", "channel"]


def silver_can(bronze: DataFrame) -> DataFrame:
    rows = bronze.where(F.col("message_type").isin(*CAN_TYPES)).withColumns({"timestamp_s": seconds(), "can_id_hex": hex_id("can_id", 8), "dir": direction(), "data_hex": F.hex("data")})
    return rows.select(*_WHEN, "can_id_hex", "can_id", "is_ext_id", "dir", "rtr", "dlc", "data_hex", "data", "fdf", "brs", "esi")


_CAN = [*_WHEN, "can_id", "can_id_hex", "dir"]


def silver_container_pdus(can: DataFrame, defs: DataFrame, long_header: bool = False) -> DataFrame:
    return demux(can.select(*_CAN, "data"), defs, long_header)


def silver_can_signals(can: DataFrame, defs: DataFrame, enums: DataFrame | None = None, pdus: DataFrame | None = None, long_header: bool = False) -> DataFrame:
    """Signals of regular frames and of the PDUs of container frames."""
    regular = decode_can(can.select(*_CAN, "data"), defs, enums)
    pdus = silver_container_pdus(can, defs, long_header) if pdus is None else pdus
    return regular.unionByName(decode_pdus(pdus, defs, enums, drop=("pdu_id", "pdu_payload")))


def silver_eth(bronze: DataFrame) -> DataFrame:
    rows = bronze.where(F.col("message_type").isin(*ETH_TYPES)).withColumns(
        {"timestamp_s": seconds(), "dir": direction(), "src_mac": mac("src_addr"), "dst_mac": mac("dst_addr"), "ether_type_hex": hex_id("ether_type", 4), "payload_bytes": F.length("data")}
    )
    return rows.select(*_WHEN, "dir", "src_mac", "dst_mac", "ether_type_hex", "ether_type", "vlan_tpid", "vlan_cos", "vlan_id", "payload_bytes", "data")


_ETH = [*_WHEN, "dir", "src_mac", "dst_mac"]


def silver_eth_signals(eth: DataFrame) -> DataFrame:
    return eth_signals(eth.select(*_ETH, "ether_type", "ether_type_hex", "data"))


def silver_mf4_signals(bronze: DataFrame) -> DataFrame:
    rows = bronze.where("message_type = 'MF4_SIGNAL'")
    return rows.select("_source_file", "_ingested_at", "timestamp_ns", seconds().alias("timestamp_s"), "event_time", F.col("mf4_group").alias("group_name"), F.col("mf4_name").alias("channel_name"), F.col("mf4_value").alias("value"), F.col("mf4_unit").alias("unit"))


def silver_someip(eth: DataFrame) -> DataFrame:
    rows = parse_someip(eth.select(*_ETH, "ether_type", "data"), drop=("ether_type", "data"))
    rows = rows.withColumns({"someip_service_id_hex": hex_id("someip_service_id", 4), "someip_method_id_hex": hex_id("someip_method_id", 4), "payload_hex": F.hex("payload")})
    header = ["someip_length", "someip_client_id", "someip_session_id", "someip_protocol_version", "someip_interface_version", "someip_msg_type", "someip_return_code"]
    return rows.select(*_ETH, "src_ip", "dst_ip", "udp_src_port", "udp_dst_port", "someip_service_id", "someip_service_id_hex", "someip_method_id", "someip_method_id_hex", *header, "payload_hex", "payload")


def silver_someip_signals(someip: DataFrame, defs: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    kept = [*_ETH, "src_ip", "dst_ip", "udp_src_port", "udp_dst_port", "someip_service_id", "someip_service_id_hex", "someip_method_id", "someip_method_id_hex", "someip_msg_type"]
    return decode_someip(someip.select(*kept, "payload"), defs, enums)


def silver_diag(bronze: DataFrame) -> DataFrame:
    rows = bronze.where(F.col("message_type").isin(*UDS_TYPES)).withColumns(
        {"timestamp_s": seconds(), "can_id_hex": hex_id("can_id", 8), "dir": direction(), "service_id_hex": hex_id("service_id", 2), "nrc_hex": hex_id("nrc", 2), "data_hex": F.hex("data")}
    )
    return rows.select(
        "_source_file", "_ingested_at", "timestamp_ns", "timestamp_s", "event_time", "transport", "channel", "can_id", "can_id_hex", "doip_src_addr", "doip_target_addr",
        "dir", "uds_type", "service_id", "service_id_hex", "service_name", "nrc", "nrc_hex", "nrc_name", "data_hex", "data",
    )


def gold_signals(can: DataFrame | None = None, eth: DataFrame | None = None, someip: DataFrame | None = None) -> DataFrame:
    """Signals of all sources; a name is unique within its source only."""
    named = [(can, "CAN", F.col("can_id_hex")), (eth, "ETH", F.col("ether_type_hex")), (someip, "SOMEIP", F.concat_ws("/", "someip_service_id_hex", "someip_method_id_hex"))] if any(x is not None for x in (can, eth, someip)) else []
    parts = [d.select(*_WHEN, F.lit(source).alias("signal_source"), message.alias("message_id_str"), "dir", "signal_name", "signal_value", "signal_str") for d, source, message in named if d is not None]
    if not parts:
        raise ValueError("no signal table given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gold_from_bronze(bronze: DataFrame, can_defs: DataFrame | None = None, someip_defs: DataFrame | None = None, enums: DataFrame | None = None, long_header: bool = False) -> DataFrame:
    eth = silver_eth(bronze)
    can = silver_can_signals(silver_can(bronze), can_defs, enums, long_header=long_header) if can_defs is not None else None
    someip = silver_someip_signals(silver_someip(eth), someip_defs, enums) if someip_defs is not None else None
    return gold_signals(can, silver_eth_signals(eth), someip)


def signal_catalog(gold: DataFrame) -> DataFrame:
    return gold.select("signal_source", "channel", "signal_name").distinct()


def signal_catalog_by_file(gold: DataFrame) -> DataFrame:
    return gold.select("signal_source", "channel", "signal_name", "_source_file").distinct()


def time_range(gold: DataFrame) -> DataFrame:
    return gold.agg(F.min("timestamp_s").alias("t_min"), F.max("timestamp_s").alias("t_max"), F.min("event_time").alias("t0"))


def source_files(gold: DataFrame) -> DataFrame:
    return gold.select("_source_file").distinct()


def video_files(files: DataFrame) -> DataFrame:
    """From path, modificationTime and length of a file listing."""
    return files.select(F.col("path").alias("_video_path"), file_stem("path").alias("_video_stem"), F.col("modificationTime").alias("_video_mtime"), F.col("length").alias("_video_size_bytes"))


#: how each table is laid out on disk: partition columns, then sort columns
LAYOUT = {
    "bronze": (["message_type"], ["channel", "timestamp_ns"]),
    "silver_can": (["message_type"], ["channel", "timestamp_ns"]),
    "silver_can_container_pdus": (["message_type"], ["channel", "timestamp_ns"]),
    "silver_can_signals": ([], ["channel", "signal_name", "timestamp_ns"]),
    "silver_eth": (["message_type"], ["channel", "timestamp_ns"]),
    "silver_eth_signals": ([], ["channel", "signal_name", "timestamp_ns"]),
    "silver_someip": (["message_type"], ["channel", "timestamp_ns"]),
    "silver_someip_signals": ([], ["channel", "signal_name", "timestamp_ns"]),
    "silver_diag": (["transport"], ["uds_type", "timestamp_ns"]),
    "gold_signals": (["signal_source"], ["channel", "signal_name", "timestamp_s"]),
    "signal_catalog_by_file": ([], ["_source_file"]),
    "boundaries": ([], ["_source_file", "seg_start_s"]),
    "signal_features": ([], ["_source_file", "segment_index", "signal_name"]),
    "vectors": ([], ["_source_file"]),
    "cluster_assignments": ([], ["cluster_id"]),
    "feature_z": ([], ["scene_id"]),
    "scenes": ([], ["_source_file", "segment_index"]),
    "channel_observed": ([], ["_source_file", "signal_source", "channel"]),
    "bus_scores": ([], ["_source_file", "signal_source", "channel"]),
    "bus_mapping": ([], ["_source_file", "signal_source"]),
}


def write_table(name: str, df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Range-partitioned and sorted by the table's layout, so that filters on it
    skip files and row groups."""
    parts, order = LAYOUT.get(name, ([], []))
    if parts or order:
        df = df.repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order)
    writer = df.write.mode(mode)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def write_gold(gold: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_table("gold_signals", gold, path, mode)
