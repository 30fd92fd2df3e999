"""Registered queries over files and streams: what is written is read again, and
packet kinds and name tables that the other queries leave out."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions import names as N
from wirelake.functions.bytes import parse_flexible_int
from wirelake.operators import decode as D
from wirelake.operators.network import eth_signals, parse_someip
from wirelake.schema import LOG_COLUMNS

from . import busmap, scenes, tables, viewer
from .harness import DECODE_SQL, FRAMES_SQL, GOLD_SQL, defs, frames, gold, table
from .queries import _bus, query


def scratch(spark: SparkSession) -> str:
    """A new folder that the executors share: below ``spark.checkpoint.dir``,
    where the session sets none (local sessions) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root.removeprefix("file://").removeprefix("file:").rstrip("/") if root else tempfile.mkdtemp(prefix="wirelake-io-")
    folder = f"{root}/wirelake-io/{uuid.uuid4().hex}"
    Path(folder).mkdir(parents=True)
    return folder


def whole_log(df: DataFrame) -> DataFrame:
    """All log columns; those that ``df`` lacks are NULL."""
    for c, kind in (x.split() for x in LOG_COLUMNS.split(", ")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df


def _can_log(spark, sf) -> DataFrame:
    return whole_log(frames(spark, sf).withColumns({"dlc": F.lit(8).cast("byte"), "is_ext_id": F.lit(False), "dir": (F.col("dir") % 3).cast("byte")}))


STEM = r"regexp_extract(_source_file, r'([^/]+)\.[^./]+$', 1) as stem"
SHOWN = [STEM, "start_ns", "timestamp_ns", "message_type", "channel", "can_id", "cast(dir as int) as dir", "hex(data) as data_hex"]
LOG_SQL = "SELECT replace(_source_file, '.blf', '') AS stem, 1704067200000000000::BIGINT AS start_ns, {t} AS timestamp_ns, 'CAN' AS message_type, channel, can_id, (dir % 3)::INT AS dir, data_hex FROM frames"


@query(f"WITH {FRAMES_SQL} {LOG_SQL.format(t='timestamp_ns')}")
def blf_round_trip(spark, sf):
    """``lineitem`` as one log a file, written and read back."""
    from wirelake.sinks.logs import write_blf
    from wirelake.sources.files import read_logs

    folder = scratch(spark)
    write_blf(_can_log(spark, sf), folder).collect()  # a row per file
    return read_logs(spark, folder).selectExpr(*SHOWN)


@query(f"WITH {FRAMES_SQL} {LOG_SQL.format(t='timestamp_ns')}")
def blf_parts_round_trip(spark, sf):
    """The same, read by runs of containers; only CAN objects are asked for."""
    from wirelake.sinks.logs import write_blf
    from wirelake.sources import blf

    folder = scratch(spark)
    write_blf(_can_log(spark, sf), folder).collect()  # a row per file
    spark.dataSource.register(blf.BlfSource)
    return spark.read.format("blf").option("containersPerPartition", 2).option("types", "CAN").load(folder).selectExpr(*SHOWN)


@query(f"WITH {FRAMES_SQL} {LOG_SQL.format(t='trunc(timestamp_ns / 1e9 * 1e9)::BIGINT')}")
def mdf4_round_trip(spark, sf):
    """The other format keeps times as seconds in doubles."""
    from wirelake.sinks.logs import write_mdf4
    from wirelake.sources.mdf4 import Mdf4Source

    folder = scratch(spark)
    write_mdf4(_can_log(spark, sf), folder).collect()  # a row per file
    spark.dataSource.register(Mdf4Source)
    return spark.read.format("mdf4").option("bytesPerPartition", 200_000).load(folder).selectExpr(*SHOWN)


@query("SELECT event_id, trunc((event_id * 1000) / 1e9 * 1e9)::BIGINT AS timestamp_ns, event_type AS mf4_group, 'value' AS mf4_name, value AS mf4_value, 'V' AS mf4_unit FROM events")
def mdf4_samples_round_trip(spark, sf):
    from wirelake.sinks.logs import write_mdf4
    from wirelake.sources.mdf4 import read_mdf4

    e = table(spark, sf, "events").select(F.lit("a.mf4").alias("_source_file"), F.lit(0).cast("long").alias("start_ns"), F.lit("MF4_SIGNAL").alias("message_type"), (F.col("event_id") * 1000).alias("timestamp_ns"), F.col("event_type").alias("mf4_group"), F.lit("value").alias("mf4_name"), F.col("value").alias("mf4_value"), F.lit("V").alias("mf4_unit"))
    folder = scratch(spark)
    write_mdf4(whole_log(e), folder).collect()  # a row per file
    rows = read_mdf4(spark, folder)
    return rows.select(F.round(F.col("timestamp_ns") / 1000).cast("long").alias("event_id"), "timestamp_ns", "mf4_group", "mf4_name", "mf4_value", "mf4_unit")


@query(f"WITH {DECODE_SQL} SELECT replace(_source_file, '.blf', '') AS stem, 'CAN' AS signal_source, channel, signal_name, timestamp_ns, round(signal_value, 6) AS signal_value FROM decoded")
def stream_gold(spark, sf):
    """Logs ingested by the file stream until none is left, up to gold."""
    from wirelake.sinks.logs import write_blf
    from wirelake.streaming.ingest import Definitions, Ingestion

    folder = scratch(spark)
    write_blf(_can_log(spark, sf), folder).collect()  # a row per file
    ingestion = Ingestion(spark, folder, scratch(spark), Definitions(can=defs(spark)), files_per_batch=2)
    ingestion.start(once=True).awaitTermination()
    return ingestion.table("gold_signals").selectExpr(STEM, "signal_source", "channel", "signal_name", "timestamp_ns", "round(signal_value, 6) as signal_value")


@query(f"""WITH {DECODE_SQL} SELECT timestamp_ns || ',' || strftime(TIMESTAMP '2024-01-01' + to_microseconds(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(timestamp_ns % 1000000000 AS VARCHAR), 9, '0') || 'Z,' || channel || ',' || printf('0x%X', can_id) || ','
  || signal_name || ',' || CASE WHEN signal_value = floor(signal_value) THEN CAST(CAST(signal_value AS BIGINT) AS VARCHAR) ELSE CAST(signal_value::DOUBLE AS VARCHAR) END || ',' AS line FROM decoded""")
def signal_csv_lines(spark, sf):
    from wirelake.sinks.csv import can_message_id, signal_lines

    f = frames(spark, sf).select("_source_file", "start_ns", "timestamp_ns", "message_type", "channel", "can_id", "data")
    return signal_lines(D.decode_can(f, defs(spark)).withColumn("message_id", can_message_id())).select("line")


@query(f"""WITH {FRAMES_SQL} SELECT timestamp_ns, part, can_id * 1000 AS pdu_id, substr(data_hex, 1, 8) AS payload_hex FROM frames UNION ALL SELECT timestamp_ns, part, 7, substr(data_hex, 9, 8) FROM frames""")
def container_demux_long(spark, sf):
    """Two PDUs with long headers in each frame, the second followed by a header
    that is cut off."""
    head = F.unhex(F.concat(F.lpad(F.hex(F.col("can_id") * 1000), 8, "0"), F.lit("00000004")))
    f = frames(spark, sf).withColumn("data", F.concat(head, F.substring("data", 1, 4), F.unhex(F.lit("0000000700000004")), F.substring("data", 5, 4), F.unhex(F.lit("000000"))))
    d = spark.createDataFrame([(257 + i, "x", 0, 8, "Intel", False, 1.0, 0.0, 1) for i in range(7)], "message_id long, signal_name string, start_bit int, bit_length int, byte_order string, is_signed boolean, scale double, offset double, pdu_id long")
    return D.demux(f.select("timestamp_ns", "part", "can_id", "data"), d, long_header=True, drop=("data", "can_id")).select("timestamp_ns", "part", "pdu_id", F.hex("pdu_payload").alias("payload_hex"))


def _h(value, digits: int):
    return F.lpad(F.hex(value.cast("long")), digits, "0")


@query("""WITH s AS (SELECT c_custkey AS k, 1 + c_custkey % 3 AS op FROM customer)
SELECT k AS c_custkey, 'arp.op' AS signal_name, op::DOUBLE AS signal_value, NULL::VARCHAR AS signal_str FROM s
UNION ALL SELECT k, 'arp.op_name', NULL, CASE op WHEN 1 THEN 'Request' WHEN 2 THEN 'Reply' ELSE 'Other' END FROM s
UNION ALL SELECT k, 'arp.sender_ip', NULL, printf('10.%d.%d.%d', k // 65536 % 256, k // 256 % 256, k % 256) FROM s UNION ALL SELECT k, 'arp.target_ip', NULL, '192.168.0.1' FROM s""")
def arp_signals(spark, sf):
    k = F.col("c_custkey")
    arp = F.concat(F.lit("000108000604"), _h(1 + k % 3, 4), F.lit("0200000000010A"), _h(k % 16777216, 6), F.lit("000000000000C0A80001"))
    eth = table(spark, sf, "customer").select(k, F.lit(0x0806).alias("ether_type"), F.unhex(arp).alias("data"))
    return eth_signals(eth, drop=("data", "ether_type"))


@query("""WITH s AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)
SELECT k AS c_custkey, 'ip.protocol' AS signal_name, 6.0::DOUBLE AS signal_value, NULL::VARCHAR AS signal_str FROM s UNION ALL SELECT k, 'ip.hop_limit', 1 + n, NULL FROM s
UNION ALL SELECT k, 'ip.src', NULL, printf('2001:0db8:0000:0000:0000:0000:%04x:%04x', k // 65536, k % 65536) FROM s UNION ALL SELECT k, 'ip.dst', NULL, 'fe80:0000:0000:0000:0000:0000:0000:0001' FROM s
UNION ALL SELECT k, 'tcp.src_port', k % 65536, NULL FROM s UNION ALL SELECT k, 'tcp.dst_port', 443, NULL FROM s UNION ALL SELECT k, 'tcp.flags', n % 64, NULL FROM s""")
def ipv6_tcp_signals(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    tcp = F.concat(_h(k % 65536, 4), F.lit("01BB000000000000000050"), _h(n % 64, 2), F.lit("000000000000"), F.lit("DEAD"))
    ip = F.concat(F.lit("60000000001606"), _h(1 + n, 2), F.lit("20010DB80000000000000000"), _h(k, 8), F.lit("FE800000000000000000000000000001"), tcp)
    eth = table(spark, sf, "customer").select(k, F.lit(0x86DD).alias("ether_type"), F.unhex(ip).alias("data"))
    return eth_signals(eth, drop=("data", "ether_type"))


@query("""WITH s AS (SELECT c_custkey AS k, [17, 18, 22, 23, 34, 99][c_custkey % 6 + 1] AS t FROM customer)
SELECT k AS c_custkey, 'igmp.type' AS signal_name, t::DOUBLE AS signal_value, NULL::VARCHAR AS signal_str FROM s
UNION ALL SELECT k, 'igmp.type_name', NULL, ['MembershipQuery', 'V1MembershipReport', 'V2MembershipReport', 'LeaveGroup', 'V3MembershipReport', 'Other'][k % 6 + 1] FROM s
UNION ALL SELECT k, 'igmp.max_resp_time', k % 256, NULL FROM s UNION ALL SELECT k, 'igmp.group', NULL, printf('224.0.%d.%d', k // 256 % 256, k % 256) FROM s""")
def igmp_signals(spark, sf):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("11", "12", "16", "17", "22", "63"))), (k % 6 + 1).cast("int"))
    ip = F.concat(F.lit("4500001C00000000010200000A000001E0000001"), kind, _h(k % 256, 2), F.lit("0000E000"), _h(k % 65536, 4))
    eth = table(spark, sf, "customer").select(k, F.lit(0x0800).alias("ether_type"), F.unhex(ip).alias("data"))
    return eth_signals(eth, drop=("data", "ether_type")).where("signal_name like 'igmp%'")


@query("""WITH s AS (SELECT o_orderkey AS k FROM orders), m AS (SELECT k, unnest([0, 1, 2]) AS i FROM s)
SELECT k AS o_orderkey, (k + i) % 65535 AS service, i::BIGINT AS session, CASE i WHEN 1 THEN 129 ELSE 0 END::BIGINT AS msg_type, CASE WHEN i = 2 THEN '' ELSE printf('%02X', i) END AS payload_hex FROM m WHERE i < 2 OR k % 2 = 0""")
def someip_many_messages(spark, sf):
    """Three messages in one datagram; the last one's length is broken in odd rows."""
    k = F.col("o_orderkey")

    def message(i: int, length, kind: str, payload: str):
        return F.concat(_h((k + i) % 65535, 4), F.lit("0001"), _h(length, 8), F.lit(f"0000{i:04X}0101{kind}00{payload}"))

    parts = F.concat(message(0, F.lit(9), "00", "00"), message(1, F.lit(9), "81", "01"), message(2, F.when(k % 2 == 0, 8).otherwise(80), "00", ""))
    ip = F.concat(F.lit("4500004E00000000401100000A0000010A000002"), F.lit("1234567800" + "3A" + "0000"), parts)
    eth = table(spark, sf, "orders").select(k, F.lit(0x0800).alias("ether_type"), F.unhex(ip).alias("data"))
    m = parse_someip(eth)
    return m.select("o_orderkey", *(F.col(f"someip_{c}").cast("long").alias(n) for n, c in (("service", "service_id"), ("session", "session_id"), ("msg_type", "msg_type"))), F.hex("payload").alias("payload_hex"))


def _case(codes: dict[int, str], other: str) -> str:
    return f"CASE c {' '.join(f"WHEN {k} THEN '{v}'" for k, v in codes.items())} ELSE {other} END"


UNKNOWN = "printf('Unknown_0x%02X', c)"


@query(f"""SELECT c AS code, {_case(N.UDS_SERVICES, UNKNOWN)} AS service, {_case(N.UDS_NRCS, UNKNOWN)} AS nrc, {_case(N.SOMEIP_TYPES, UNKNOWN)} AS someip_type, {_case(N.SOMEIP_RETURN_CODES, UNKNOWN)} AS return_code,
  {_case(N.DOIP_TYPES, "printf('Unknown_0x%04X', c)")} AS doip FROM (SELECT DISTINCT CAST(l_partkey % 256 AS BIGINT) AS c FROM lineitem)""")
def all_protocol_names(spark, sf):
    code = table(spark, sf, "lineitem").select((F.col("l_partkey") % 256).cast("long").alias("code")).distinct()
    return code.select("code", N.uds_service("code").alias("service"), N.uds_nrc("code").alias("nrc"), N.someip_type("code").alias("someip_type"), N.someip_return_code("code").alias("return_code"), N.doip_type("code").alias("doip"))


@query("SELECT p_partkey, p_partkey AS value FROM part")
def binary_ints(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(p, F.concat(F.lit("0b"), F.bin(p)).alias("raw")).select("p_partkey", parse_flexible_int("raw").alias("value"))


@query(f"""WITH {GOLD_SQL}, c AS (SELECT DISTINCT signal_source, channel, signal_name || CASE channel WHEN 0 THEN '_Latitude' WHEN 1 THEN '_GPSx' ELSE '' END AS signal_name FROM gold) SELECT * FROM c WHERE contains(lower(signal_name), 'lat') OR contains(lower(signal_name), 'lon') OR contains(lower(signal_name), 'gps')""")
def position_candidates(spark, sf):
    suffix = F.when(F.col("channel") == 0, "_Latitude").when(F.col("channel") == 1, "_GPSx").otherwise("")
    return viewer.latlon_candidates(tables.signal_catalog(gold(spark, sf).withColumn("signal_name", F.concat("signal_name", suffix))))


BEST_SQL = """s AS (SELECT _source_file, channel, bus_name, CASE WHEN recall + precision = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END AS w FROM scored),
c AS (SELECT DISTINCT _source_file, channel FROM s UNION ALL SELECT DISTINCT _source_file, NULL FROM s),
t AS (SELECT x._source_file, coalesce(a.w, 0) + coalesce(b.w, 0) + coalesce(d.w, 0) AS total FROM c x JOIN c y ON y._source_file = x._source_file JOIN c z ON z._source_file = x._source_file
  LEFT JOIN s a ON a._source_file = x._source_file AND a.channel = x.channel AND a.bus_name = 'bus0' LEFT JOIN s b ON b._source_file = y._source_file AND b.channel = y.channel AND b.bus_name = 'bus1' LEFT JOIN s d ON d._source_file = z._source_file AND d.channel = z.channel AND d.bus_name = 'bus2'
  WHERE (x.channel <> y.channel OR x.channel IS NULL OR y.channel IS NULL) AND (x.channel <> z.channel OR x.channel IS NULL OR z.channel IS NULL) AND (y.channel <> z.channel OR y.channel IS NULL OR z.channel IS NULL))"""


def _bus_sql() -> str:
    from .queries import BUS_SQL

    return BUS_SQL


@query(f"WITH {_bus_sql()}, {BEST_SQL} SELECT _source_file, round(max(total), 9) AS total, (SELECT count(DISTINCT channel) FROM scored k WHERE k._source_file = t._source_file) AS n_channels FROM t GROUP BY 1")
def bus_mapping_weight(spark, sf):
    """The matching's total score is the greatest that any matching has."""
    m = busmap.assign_buses(busmap.scores(*_bus(spark, sf)))
    return m.groupBy("_source_file").agg(F.round(F.sum("score"), 9).alias("total"), F.countDistinct("channel").alias("n_channels"))


@query("""WITH x AS (SELECT c_custkey, c_nationkey % 10 AS d FROM customer), g AS (SELECT c_custkey, CASE WHEN d < 4 THEN 0 WHEN d < 7 THEN 1 WHEN d < 9 THEN 2 ELSE 3 END AS g FROM x), n AS (SELECT g, count(*) AS n FROM g GROUP BY 1)
SELECT 'c' || c_custkey AS scene_id, n::INT AS cluster_size, round(n / (SELECT count(*) FROM customer), 9) AS cluster_share, 4::INT AS k_used, (SELECT count(*) FROM n m WHERE m.n > n.n)::INT AS larger FROM g JOIN n USING (g)""")
def scene_cluster_sizes(spark, sf):
    """Customers in four groups far apart: the clusters are the groups."""
    d = F.col("c_nationkey") % 10
    g = F.when(d < 4, 0).when(d < 7, 1).when(d < 9, 2).otherwise(3)
    small = (F.col("c_custkey") % 17) / 17.0
    v = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("scene_id"), F.array(g * 100.0 + small, (g * g) * 100.0 - small).alias("feature_vector"))
    out = scenes.cluster_assignments(v, scenes.Params(k=4))
    return out.select("scene_id", "cluster_size", F.round("cluster_share", 9).alias("cluster_share"), "k_used", F.col("cluster_id").alias("larger"))
