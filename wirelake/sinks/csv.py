"""CSV sinks: raw log lines and decoded signal lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions.bytes import mac
from wirelake.functions.time import iso_ns

RAW_HEADER = "timestamp_ns,absolute_timestamp,type,channel,dir,src_mac,dst_mac,ether_type,vlan_vid,id,ext_id,dlc,data"
SIGNAL_HEADER = "timestamp_ns,absolute_timestamp,channel,message_id,signal_name,value,category"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _channel(df: DataFrame, channels: DataFrame | None) -> DataFrame:
    """Adds ``__channel``: the channel's name, else its number."""
    number = F.col("channel").cast("string")
    if channels is None:
        return df.withColumn("__channel", number)
    named = channels.select(F.col("type").alias("__type"), F.col("channel").alias("__n"), F.col("name").alias("__name"))
    kind = F.when(F.col("message_type").startswith("ETH"), "Ethernet").otherwise("CAN")
    return df.join(F.broadcast(named), (F.col("__type") == kind) & (F.col("__n") == F.col("channel")), "left").withColumn("__channel", F.coalesce("__name", number)).drop("__type", "__n", "__name")  # one row a channel


TYPE_NAMES = {"CAN": "CAN", "CAN_FD": "CAN-FD", "CAN_FD64": "CAN-FD64", "ETH": "Ethernet", "ETH_EX": "EthernetEx"}


def raw_lines(log: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """(_source_file, timestamp_ns, line) of the messages of a log. CAN lines
    leave out the VLAN field, as their readers expect."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair)), F.col("message_type"))
    direction = F.when(F.col("dir") == 0, "Tx").when(F.col("dir") == 1, "Rx").when(F.col("dir") == 2, "TxRq").otherwise("Unknown(3)")
    head = [F.col("timestamp_ns").cast("string"), iso_ns(F.col("start_ns") + F.col("timestamp_ns"))]
    sent = [*head, kind, F.col("__channel"), direction]
    data = F.coalesce(F.hex("data"), F.lit(""))
    can = F.concat_ws(",", *sent, F.lit(",,"), F.concat(F.lit("0x"), F.hex("can_id")), F.col("is_ext_id").cast("string"), F.col("dlc").cast("string"), data)
    eth = F.concat_ws(",", *sent, mac("src_addr"), mac("dst_addr"), F.format_string("0x%04X", F.col("ether_type")), _text(F.col("vlan_id")), F.lit(",,"), data)
    sample = F.concat_ws(",", *head, F.lit("Mf4Signal,,,,,,,"), shown_number(F.col("mf4_value")), _text(F.col("mf4_unit")))
    rows = _channel(log.where("message_type <> 'OTHER'"), channels)
    line = F.when(F.col("message_type").startswith("CAN"), can).when(F.col("message_type").startswith("ETH"), eth).when(F.col("message_type") == "MF4_SIGNAL", sample)
    return rows.select("_source_file", "timestamp_ns", line.alias("line")).where("line is not null")


def shown_number(c: Column) -> Column:
    """42 for 42.0, never with an exponent."""
    plain = F.regexp_replace(c.cast("string"), r"\.0$", "")
    long = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(plain.contains("E"), long).otherwise(plain)


def signal_lines(signals: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """(_source_file, timestamp_ns, line) of decoded signals. ``message_id`` is a
    CAN id or service << 16 | method."""
    fields = [F.col("timestamp_ns").cast("string"), iso_ns(F.col("start_ns") + F.col("timestamp_ns")), F.col("__channel"), F.col("message_id"), F.col("signal_name"), shown_number(F.col("signal_value")), _text(F.col("signal_str"))]
    return _channel(signals, channels).select("_source_file", "timestamp_ns", F.concat_ws(",", *fields).alias("line"))


def can_message_id() -> Column:
    return F.concat(F.lit("0x"), F.hex("can_id"))


def someip_message_id() -> Column:
    return F.format_string("0x%08X", F.col("someip_service_id").cast("long") * 65536 + F.col("someip_method_id"))


def write_lines(lines: DataFrame, path: str, header: str) -> None:
    """Text files in file and time order, the header first in the first one."""
    ordered = lines.repartitionByRange("_source_file", "timestamp_ns").sortWithinPartitions("_source_file", "timestamp_ns").select("line")
    ordered.write.mode("overwrite").text(path)
    lines.sparkSession.createDataFrame([(header,)], "line string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_header")
