"""Registered queries: the engine's functions over the harness tables, each with
the SQL that DuckDB answers alike. Floating-point results are rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelake.functions import bytes as B
from wirelake.functions.names import UDS_NRCS, UDS_SERVICES, uds_nrc, uds_service
from wirelake.functions.time import event_time, iso_ns, seconds
from wirelake.operators import decode as D
from wirelake.operators.diagnostics import isotp_frame, with_uds_fields
from wirelake.operators.network import eth_signals, parse_someip
from wirelake.operators.segments import interval_join

from . import busmap, reports, scenes, tables, viewer
from .harness import DECODE_SQL, FRAMES_SQL, GOLD_SQL, PARAMS, defs, frames, gold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ── tables ──────────────────────────────────────────────────────────────────


@query(f"WITH {GOLD_SQL} SELECT * FROM gold")
def gold_signals(spark, sf):
    return gold(spark, sf)


@query(f"WITH {GOLD_SQL} SELECT DISTINCT signal_source, channel, signal_name FROM gold")
def signal_catalog(spark, sf):
    return tables.signal_catalog(gold(spark, sf))


@query(f"WITH {GOLD_SQL} SELECT DISTINCT signal_source, channel, signal_name, _source_file FROM gold")
def signal_catalog_by_file(spark, sf):
    return tables.signal_catalog_by_file(gold(spark, sf))


@query(f"WITH {GOLD_SQL} SELECT min(timestamp_s) AS t_min, max(timestamp_s) AS t_max, min(event_time) AS t0 FROM gold")
def time_range(spark, sf):
    return tables.time_range(gold(spark, sf))


@query(f"WITH {GOLD_SQL} SELECT DISTINCT _source_file FROM gold")
def source_files(spark, sf):
    return tables.source_files(gold(spark, sf))


@query(f"""WITH {FRAMES_SQL}
SELECT _source_file, timestamp_ns, round(timestamp_ns / 1e9, 9) AS timestamp_s, channel, can_id, printf('0x%08X', can_id) AS can_id_hex,
       CASE dir WHEN 0 THEN 'Tx' WHEN 1 THEN 'Rx' ELSE 'TxRq' END AS dir, data_hex FROM frames""")
def silver_can(spark, sf):
    f = frames(spark, sf)
    none = {c: F.lit(None).cast(t) for c, t in (("_ingested_at", "timestamp"), ("is_ext_id", "boolean"), ("rtr", "boolean"), ("dlc", "byte"), ("fdf", "boolean"), ("brs", "boolean"), ("esi", "boolean"))}
    out = tables.silver_can(f.withColumns(none | {"event_time": event_time()}))
    return out.select("_source_file", "timestamp_ns", F.round("timestamp_s", 9).alias("timestamp_s"), "channel", "can_id", "can_id_hex", "dir", "data_hex")


@query(f"""WITH {FRAMES_SQL}
SELECT timestamp_ns, strftime(TIMESTAMP '2024-01-01' + to_microseconds(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(timestamp_ns % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS absolute,
       lower(substr(data_hex, 1, 4)) AS head, can_id BETWEEN 2015 AND 2031 OR (can_id & 4294901760) = 416940032 AS diagnostic
FROM frames""")
def id_and_time_functions(spark, sf):
    f = frames(spark, sf)
    return f.select("timestamp_ns", iso_ns(F.col("start_ns") + F.col("timestamp_ns")).alias("absolute"), F.lower(F.substring(F.hex("data"), 1, 4)).alias("head"), B.is_diagnostic("can_id").alias("diagnostic"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN printf('0x%X', p_partkey) WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN printf('%Xh', p_partkey)
  WHEN 3 THEN CAST(p_partkey AS VARCHAR) || '.75' ELSE 'n/a' END AS raw FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN p_partkey END AS id, CASE WHEN p_partkey % 5 < 4 THEN p_partkey END AS flexible FROM t""")
def id_parsing(spark, sf):
    p = F.col("p_partkey")
    raw = F.when(p % 5 == 0, F.concat(F.lit("0x"), F.hex(p))).when(p % 5 == 1, p.cast("string")).when(p % 5 == 2, F.concat(F.hex(p), F.lit("h"))).when(p % 5 == 3, F.concat(p.cast("string"), F.lit(".75"))).otherwise("n/a")
    return table(spark, sf, "part").select(p, raw.alias("raw")).select("p_partkey", B.parse_id("raw").alias("id"), B.parse_flexible_int("raw").alias("flexible"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '0xNone' WHEN s_suppkey % 2 = 0 THEN printf('0x%X', s_suppkey) ELSE printf('%X', s_suppkey) END AS raw,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN s_suppkey WHEN regexp_full_match(printf('%X', s_suppkey), '[0-9]+') THEN CAST(printf('%X', s_suppkey) AS BIGINT) ELSE s_suppkey END AS id FROM supplier""")
def bus_id_parsing(spark, sf):
    s = F.col("s_suppkey")
    raw = F.when(s % 7 == 0, "0xNone").when(s % 2 == 0, F.concat(F.lit("0x"), F.hex(s))).otherwise(F.hex(s))
    return table(spark, sf, "supplier").select(s, raw.alias("raw")).withColumn("id", B.parse_id_or_hex("raw"))


# ── decoding ────────────────────────────────────────────────────────────────


@query(f"WITH {DECODE_SQL} SELECT _source_file, timestamp_ns, channel, can_id, part, signal_name, round(signal_value, 6) AS signal_value FROM decoded")
def can_decode(spark, sf):
    f = frames(spark, sf).select("_source_file", "timestamp_ns", "channel", "can_id", "part", "data")
    return D.decode_can(f, defs(spark)).drop("signal_str").withColumn("signal_value", F.round("signal_value", 6))


@query(f"""WITH {DECODE_SQL} SELECT timestamp_ns, part, signal_value, CASE WHEN signal_value IN (1, 2, 3) THEN ['one', 'two', 'three'][CAST(signal_value AS INT)] END AS signal_str
FROM decoded WHERE signal_name = 'Quantity'""")
def enum_decode(spark, sf):
    enums = spark.createDataFrame([("Quantity", 1, "one"), ("Quantity", 2, "two"), ("Quantity", 3, "three"), ("Other", 4, "four")], "signal_name string, raw_value int, category string")
    f = frames(spark, sf).select("timestamp_ns", "part", "can_id", "data")
    return D.decode_can(f, defs(spark).where("signal_name = 'Quantity'"), enums, drop=("data", "can_id")).drop("signal_name")


@query(f"WITH {FRAMES_SQL} SELECT timestamp_ns, part, CAST('0x' || substr(data_hex, 3, 2) || substr(data_hex, 1, 2) AS BIGINT) AS intel, CAST('0x' || substr(data_hex, 9, 4) AS BIGINT) AS motorola FROM frames")
def bit_expressions(spark, sf):
    f = frames(spark, sf)
    return f.select("timestamp_ns", "part", D.bits_sql(F.col("data"), 0, 16).alias("intel"), D.bits_sql(F.col("data"), 39, 16, "Motorola").alias("motorola"))


@query(f"""WITH {FRAMES_SQL}
SELECT timestamp_ns, part, 16 * 65536 + can_id AS pdu_id, substr(data_hex, 1, 8) AS payload_hex FROM frames
UNION ALL SELECT timestamp_ns, part, 0, '' FROM frames""")
def container_demux(spark, sf):
    """Each frame as a container of one 4-byte PDU and zero padding."""
    f = frames(spark, sf).withColumn("data", F.concat(F.unhex(F.concat(F.lit("10"), F.lpad(F.hex("can_id"), 4, "0"), F.lit("04"))), F.substring("data", 1, 4), F.unhex(F.lit("00000000"))))
    d = spark.createDataFrame([(257 + i, "x", 0, 8, "Intel", False, 1.0, 0.0, 1) for i in range(7)], "message_id long, signal_name string, start_bit int, bit_length int, byte_order string, is_signed boolean, scale double, offset double, pdu_id long")
    return D.demux(f.select("timestamp_ns", "part", "can_id", "data"), d, drop=("data", "can_id")).select("timestamp_ns", "part", "pdu_id", F.hex("pdu_payload").alias("payload_hex"))


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT can_id, count(*) AS n FROM frames GROUP BY can_id) SELECT can_id, CAST(n AS BIGINT) AS n, printf('0x%08X', can_id) AS can_id_hex FROM p""")
def pdu_occurrences(spark, sf):
    return frames(spark, sf).groupBy("can_id").agg(F.count(F.lit(1)).alias("n")).withColumn("can_id_hex", B.hex_id("can_id", 8)).orderBy("can_id")


SERVICE_SQL = f"CASE a {' '.join(f"WHEN {k} THEN '{v}'" for k, v in UDS_SERVICES.items())} ELSE printf('Unknown_0x%02X', a) END"
NRC_SQL = f"CASE b {' '.join(f"WHEN {k} THEN '{v}'" for k, v in UDS_NRCS.items())} ELSE printf('Unknown_0x%02X', b) END"


@query(f"""WITH u AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 127 WHEN 1 THEN 34 WHEN 2 THEN 98 ELSE 170 END AS sid, l_partkey % 60 AS a, l_suppkey % 128 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN sid = 127 THEN 'NegativeResponse' WHEN sid & 64 <> 0 THEN 'PositiveResponse' ELSE 'Request' END AS uds_type,
  CASE sid WHEN 127 THEN a WHEN 98 THEN 34 ELSE sid END AS service_id, CASE WHEN sid = 127 THEN b END AS nrc,
  CASE WHEN sid = 127 THEN {NRC_SQL} END AS nrc_name,
  CASE WHEN sid = 34 OR sid = 98 THEN 'ReadDataByIdentifier' WHEN sid = 170 THEN 'Unknown_0xAA' ELSE {SERVICE_SQL} END AS service_name,
  CASE WHEN sid = 127 THEN '' ELSE printf('%02X%02X', a, b) END AS data_hex
FROM u""")
def uds_parse(spark, sf):
    p = F.col("l_partkey")
    a, b = p % 60, F.col("l_suppkey") % 128
    sid = F.when(p % 4 == 0, 0x7F).when(p % 4 == 1, 0x22).when(p % 4 == 2, 0x62).otherwise(0xAA)
    raw = F.unhex(F.concat(*(F.lpad(F.hex(x.cast("long")), 2, "0") for x in (sid, a, b))))
    rows = with_uds_fields(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), raw.alias("uds")), "uds")
    return rows.select("l_orderkey", "l_linenumber", "uds_type", F.col("service_id").cast("long").alias("service_id"), F.col("nrc").cast("long").alias("nrc"), "nrc_name", "service_name", F.hex("data").alias("data_hex"))


@query("""SELECT l_orderkey, l_linenumber, ['SF', 'FF', 'CF', 'FC'][l_partkey % 4 + 1] AS kind,
  CASE l_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 256 + l_suppkey % 256 END AS total_length, CASE WHEN l_partkey % 4 >= 2 THEN 1::BIGINT END AS sequence,
  CASE l_partkey % 4 WHEN 0 THEN printf('%02XAABB', l_suppkey % 256) WHEN 1 THEN 'AABBCC' ELSE printf('%02XAABBCC', l_suppkey % 256) END AS payload_hex FROM lineitem""")
def isotp_frames(spark, sf):
    p = F.col("l_partkey") % 4
    head = F.when(p == 0, "03").when(p == 1, "11").when(p == 2, "21").otherwise("31")
    raw = F.unhex(F.concat(head, F.lpad(F.hex(F.col("l_suppkey") % 256), 2, "0"), F.lit("AABBCC")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("data")).withColumn("frame", isotp_frame())
    return rows.select("l_orderkey", "l_linenumber", "frame.kind", "frame.total_length", F.col("frame.sequence").cast("long").alias("sequence"), F.hex("frame.payload").alias("payload_hex"))


def _datagrams(spark, sf):
    """Orders as IPv4/UDP datagrams: ports and addresses from the keys, payload
    one SOME/IP notification."""
    o = table(spark, sf, "orders")

    def h(value, digits):
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    someip = F.concat(h(k % 65535, 4), h(c % 65535, 4), F.lit("0000000C"), h(c % 7, 4), h(k % 11, 4), F.lit("0101"), F.when(k % 3 == 0, "02").when(k % 3 == 1, "80").otherwise("40"), F.lit("00"), h(k, 8))
    udp = F.concat(h(k % 65536, 4), h(c % 65536, 4), F.lit("001C0000"), someip)
    ip = F.concat(F.lit("450000300000000040110000"), F.lit("0A"), h(c % 16777216, 6), F.lit("C0A80001"), udp)
    return o.select(k, F.lit(0x0800).alias("ether_type"), F.unhex(ip).alias("data"))


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k AS o_orderkey, 'ip.protocol' AS signal_name, 17.0::DOUBLE AS signal_value, NULL::VARCHAR AS signal_str FROM s
UNION ALL SELECT k, 'ip.ttl', 64, NULL FROM s UNION ALL SELECT k, 'ip.total_len', 48, NULL FROM s
UNION ALL SELECT k, 'ip.src', NULL, printf('10.%d.%d.%d', c // 65536 % 256, c // 256 % 256, c % 256) FROM s UNION ALL SELECT k, 'ip.dst', NULL, '192.168.0.1' FROM s
UNION ALL SELECT k, 'udp.src_port', k % 65536, NULL FROM s UNION ALL SELECT k, 'udp.dst_port', c % 65536, NULL FROM s UNION ALL SELECT k, 'udp.payload_bytes', 20, NULL FROM s""")
def eth_header_signals(spark, sf):
    return eth_signals(_datagrams(spark, sf), drop=("data", "ether_type"))


@query("""SELECT o_orderkey, printf('10.%d.%d.%d', o_custkey // 65536 % 256, o_custkey // 256 % 256, o_custkey % 256) AS src_ip, o_orderkey % 65535 AS service, o_custkey % 65535 AS method,
  12::BIGINT AS length, o_custkey % 7 AS client, o_orderkey % 11 AS session, CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 128 END::BIGINT AS msg_type, printf('%08X', o_orderkey) AS payload_hex FROM orders WHERE o_orderkey % 3 <> 2""")
def someip_parse(spark, sf):
    m = parse_someip(_datagrams(spark, sf))
    long = {n: F.col(f"someip_{c}").cast("long") for n, c in (("service", "service_id"), ("method", "method_id"), ("length", "length"), ("client", "client_id"), ("session", "session_id"), ("msg_type", "msg_type"))}
    return m.select("o_orderkey", "src_ip", *(v.alias(n) for n, v in long.items()), F.hex("payload").alias("payload_hex"))


@query("""SELECT c_custkey, printf('%02X:%02X:%02X:%02X:%02X:%02X', 2, 0, c_custkey // 16777216 % 256, c_custkey // 65536 % 256, c_custkey // 256 % 256, c_custkey % 256) AS mac,
  printf('%02X %02X %02X %02X...', 2, 0, c_custkey // 16777216 % 256, c_custkey // 65536 % 256) AS preview FROM customer""")
def mac_and_preview(spark, sf):
    raw = F.unhex(F.concat(F.lit("0200"), F.lpad(F.hex("c_custkey"), 8, "0")))
    return table(spark, sf, "customer").select("c_custkey", raw.alias("m")).select("c_custkey", B.mac("m").alias("mac"), B.hex_preview("m", 4).alias("preview"))


@query("""SELECT code, CASE code WHEN 34 THEN 'ReadDataByIdentifier' WHEN 62 THEN 'TesterPresent' WHEN 255 THEN 'Unknown_0xFF' END AS service, CASE code WHEN 34 THEN 'ConditionsNotCorrect' WHEN 62 THEN 'Unknown_0x3E' WHEN 255 THEN 'Unknown_0xFF' END AS nrc
FROM (SELECT DISTINCT CASE r_regionkey % 3 WHEN 0 THEN 34 WHEN 1 THEN 62 ELSE 255 END AS code FROM region)""")
def protocol_names(spark, sf):
    code = F.when(F.col("r_regionkey") % 3 == 0, 34).when(F.col("r_regionkey") % 3 == 1, 62).otherwise(255)
    return table(spark, sf, "region").select(code.alias("code")).distinct().select("code", uds_service("code").alias("service"), uds_nrc("code").alias("nrc"))


# ── interactive queries ─────────────────────────────────────────────────────

KEYS = [("CAN", 1, "click"), ("SOMEIP", 0, "signup"), ("ETH", 2, "error")]
KEY_SQL = "((signal_source = 'CAN' AND channel = 1 AND signal_name = 'click') OR (signal_source = 'SOMEIP' AND channel = 0 AND signal_name = 'signup') OR (signal_source = 'ETH' AND channel = 2 AND signal_name = 'error'))"
CAT_SQL = "cat AS (SELECT DISTINCT signal_source, channel, signal_name FROM gold)"


@query(f"WITH {GOLD_SQL}, {CAT_SQL} SELECT signal_source, channel, signal_name FROM cat QUALIFY row_number() OVER (PARTITION BY signal_source ORDER BY channel, signal_name) <= 4")
def catalog_browse(spark, sf):
    return viewer.browse(tables.signal_catalog(gold(spark, sf)), per_source=4)


@query(f"""WITH {GOLD_SQL}, {CAT_SQL}, m AS (SELECT *, CASE WHEN signal_source = 'SOMEIP' THEN 'ETH' ELSE signal_source END AS shown FROM cat),
w AS (SELECT * FROM m WHERE (contains(lower(signal_name), 'eth') OR contains(lower(signal_source), 'eth') OR contains(lower(shown), 'eth') OR contains(CAST(channel AS VARCHAR), 'eth') OR contains(lower(signal_source || channel), 'eth') OR contains(lower(shown || channel), 'eth'))
  AND (contains(lower(signal_name), 's') OR contains(lower(signal_source), 's') OR contains(lower(shown), 's')))
SELECT signal_source, channel, signal_name, false AS truncated FROM w""")
def catalog_search(spark, sf):
    return viewer.search(tables.signal_catalog(gold(spark, sf)), "ETH s")


@query(f"WITH {GOLD_SQL}, {CAT_SQL} SELECT signal_source, channel, signal_name, count(*) OVER (PARTITION BY signal_source) > 2 AS truncated FROM cat WHERE contains(signal_name, 'i') QUALIFY row_number() OVER (PARTITION BY signal_source ORDER BY channel, signal_name) <= 2")
def catalog_search_truncated(spark, sf):
    return viewer.search(tables.signal_catalog(gold(spark, sf)).where(F.contains("signal_name", F.lit("i"))), "i", limit=6)


@query(f"WITH {GOLD_SQL}, {CAT_SQL} SELECT * FROM cat WHERE contains(lower(signal_name), 'lat') OR contains(lower(signal_name), 'lon') OR contains(lower(signal_name), 'gps')")
def latlon_candidates(spark, sf):
    return viewer.latlon_candidates(tables.signal_catalog(gold(spark, sf)))


@query(f"WITH {GOLD_SQL} SELECT DISTINCT signal_source, channel FROM gold WHERE _source_file IN ('drive1.blf', 'drive3.blf')")
def channel_list(spark, sf):
    return viewer.channels(tables.signal_catalog_by_file(gold(spark, sf)), ["drive1.blf", "drive3.blf"])


@query(f"""WITH {GOLD_SQL}, k(signal_source, channel, signal_name) AS (VALUES ('CAN', 1, 'click'), ('CAN', 9, 'click'), ('SOMEIP', 0, 'signup')),
h AS (SELECT k.signal_source, k.channel, k.signal_name, string_agg(DISTINCT _source_file, ',' ORDER BY _source_file) AS files FROM k LEFT JOIN gold g ON g.signal_source = k.signal_source AND g.channel = k.channel AND g.signal_name = k.signal_name GROUP BY ALL)
SELECT * FROM h WHERE files IS NULL OR NOT contains(files, 'nowhere.blf')""")
def file_scopes(spark, sf):
    out = viewer.file_scopes(tables.signal_catalog_by_file(gold(spark, sf)), [("CAN", 1, "click"), ("CAN", 9, "click"), ("SOMEIP", 0, "signup")], ["nowhere.blf"])
    return out.select("signal_source", "channel", "signal_name", F.when(F.col("files").isNotNull(), F.array_join("files", ",")).alias("files"))


@query(f"""WITH {GOLD_SQL}, b AS (SELECT *, ntile(40) OVER (PARTITION BY signal_source, channel, signal_name ORDER BY timestamp_ns, signal_value, signal_str) AS bucket FROM gold WHERE {KEY_SQL} AND timestamp_s BETWEEN 200000 AND 2000000),
r AS (SELECT *, row_number() OVER (PARTITION BY signal_source, channel, signal_name, bucket ORDER BY signal_value, timestamp_ns) AS lo, row_number() OVER (PARTITION BY signal_source, channel, signal_name, bucket ORDER BY signal_value DESC, timestamp_ns) AS hi FROM b)
SELECT signal_source, channel, signal_name, event_time, timestamp_s, timestamp_ns, signal_value, signal_str FROM r WHERE lo = 1
UNION ALL SELECT signal_source, channel, signal_name, event_time, timestamp_s, timestamp_ns, signal_value, signal_str FROM r WHERE hi = 1""")
def plot_downsample(spark, sf):
    return viewer.fetch_signals(gold(spark, sf), KEYS, 40, time_range=(200000.0, 2000000.0)).rows


@query(f"WITH {GOLD_SQL} SELECT _source_file AS source_file, min(timestamp_s) AS t_min, max(timestamp_s) AS t_max, min(event_time) AS t0 FROM gold WHERE _source_file IN ('drive0.blf', 'drive2.blf') AND {KEY_SQL} GROUP BY 1")
def per_file_ranges(spark, sf):
    return viewer.per_file_ranges(gold(spark, sf), ["drive0.blf", "drive2.blf"], KEYS)


@query(f"""WITH {GOLD_SQL}, l AS (SELECT _source_file, timestamp_ns, signal_value AS lat FROM gold WHERE signal_name = 'click'), r AS (SELECT _source_file, timestamp_ns AS rns, signal_value AS lon FROM gold WHERE signal_name = 'view'),
b AS (SELECT l.*, r.rns AS b_ns, r.lon AS b_lon FROM l ASOF LEFT JOIN r ON l._source_file = r._source_file AND l.timestamp_ns >= r.rns),
a AS (SELECT b.*, r.rns AS a_ns, r.lon AS a_lon FROM b ASOF LEFT JOIN r ON b._source_file = r._source_file AND b.timestamp_ns <= r.rns)
SELECT _source_file, timestamp_ns, lat, CASE WHEN a_ns IS NULL OR timestamp_ns - b_ns <= a_ns - timestamp_ns THEN b_ns ELSE a_ns END AS right_timestamp_ns, CASE WHEN a_ns IS NULL OR timestamp_ns - b_ns <= a_ns - timestamp_ns THEN b_lon ELSE a_lon END AS right_lon FROM a""")
def asof_nearest(spark, sf):
    g = gold(spark, sf)
    left = g.where("signal_name = 'click'").select("_source_file", "timestamp_ns", F.col("signal_value").alias("lat"))
    right = g.where("signal_name = 'view'").select("_source_file", "timestamp_ns", F.col("signal_value").alias("lon"))
    return viewer.asof_nearest(left, right, "timestamp_ns", "lon", ["_source_file"])


@query("""WITH x AS (SELECT event_id, value * 3 - 700 AS v FROM events), t AS (SELECT event_id, (v + 90) - 360 * floor((v + 90) / 360) - 90 AS lat, (v + 180) - 360 * floor((v + 180) / 360) - 180 AS lon FROM x)
SELECT event_id, round(CASE WHEN lat > 90 THEN 180 - lat ELSE lat END, 6) AS lat, round(lon, 6) AS lon FROM t""")
def latlon_wrap(spark, sf):
    v = F.col("value") * 3 - 700
    return table(spark, sf, "events").select("event_id", F.round(viewer.wrap_lat(v), 6).alias("lat"), F.round(viewer.wrap_lon(v), 6).alias("lon"))


@query(f"""WITH {GOLD_SQL}, m AS (SELECT *, min(signal_value) OVER w AS lo, max(signal_value) OVER w AS hi, max(signal_str IS NOT NULL) OVER w AS text FROM gold WHERE {KEY_SQL} WINDOW w AS (PARTITION BY signal_source, channel, signal_name))
SELECT signal_source, channel, signal_name, timestamp_ns, round(CASE WHEN text OR lo = hi THEN signal_value ELSE (signal_value - (hi + lo) / 2) / ((hi - lo) / 2) END, 9) AS scaled FROM m""")
def trace_scaling(spark, sf):
    rows = viewer.scale_traces(gold(spark, sf).where(viewer.any_key(KEYS)))
    return rows.select("signal_source", "channel", "signal_name", "timestamp_ns", F.round("scaled", 9).alias("scaled"))


@query(f"""WITH {GOLD_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY signal_source, channel, signal_name ORDER BY timestamp_ns, signal_value, signal_str) AS position FROM gold WHERE {KEY_SQL})
SELECT position::INT AS position, max(CASE WHEN signal_name = 'click' THEN timestamp_s END) AS time, max(CASE WHEN signal_name = 'click' THEN CAST(signal_value AS VARCHAR) END) AS "CAN1::click",
  max(CASE WHEN signal_name = 'signup' THEN CAST(signal_value AS VARCHAR) END) AS "ETH0::signup", max(CASE WHEN signal_name = 'error' THEN signal_str END) AS "ETH2::error" FROM p GROUP BY p.position""")
def pivot_grid(spark, sf):
    return viewer.pivot_grid(gold(spark, sf), KEYS)


@query(f"""WITH {GOLD_SQL}, v AS (SELECT 'videos/drive' || n_nationkey || '.mp4' AS path FROM nation), s AS (SELECT path, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS stem FROM v)
SELECT f.source_file, s.path AS _video_path FROM (SELECT DISTINCT _source_file AS source_file FROM gold) f LEFT JOIN s ON regexp_extract('/' || f.source_file, '([^/]+)\\.[^./]+$', 1) = s.stem""")
def video_match(spark, sf):
    listing = table(spark, sf, "nation").select(F.concat(F.lit("videos/drive"), F.col("n_nationkey").cast("string"), F.lit(".mp4")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(1).cast("long").alias("length"))
    files = tables.source_files(gold(spark, sf)).select(F.col("_source_file").alias("source_file"))
    return viewer.match_videos(files, tables.video_files(listing)).select("source_file", "_video_path")


@query(f"""WITH {GOLD_SQL}, k(signal_source, channel, signal_name) AS (VALUES ('CAN', 1, 'click'), ('CAN', 9, 'nothing'), ('ETH', 7, 'error')) SELECT count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.signal_source = k.signal_source AND g.channel = k.channel AND g.signal_name = k.signal_name)""")
def unfetched_keys(spark, sf):
    keys = spark.createDataFrame([("CAN", 1, "click"), ("CAN", 9, "nothing"), ("ETH", 7, "error")], "signal_source string, channel int, signal_name string")
    return viewer.unfetched(keys, gold(spark, sf))


# ── scenes ──────────────────────────────────────────────────────────────────

SCOPED_SQL = f"""{GOLD_SQL}, scoped AS (SELECT *, signal_source || '|' || coalesce(CAST(channel AS VARCHAR), '-') || '|' || signal_name AS signal_key FROM gold WHERE signal_source IN ('CAN', 'SOMEIP')),
stats AS (SELECT _source_file, signal_key, signal_source, channel, signal_name, count(*) AS n_samples, min(timestamp_s) AS t_min_s, max(timestamp_s) AS t_max_s, quantile_disc(signal_value, 0.5) AS median_value,
  greatest((quantile_disc(signal_value, 0.75) - quantile_disc(signal_value, 0.25)) / 1.349, 1e-9) AS robust_sigma FROM scoped GROUP BY ALL)"""
SPAN_SQL = "span AS (SELECT _source_file, min(t_min_s) AS t0, max(t_max_s) AS t1 FROM stats GROUP BY 1)"
#: the plain grid: one scene per day from the file's first sample
GRID_SQL = f"""{SCOPED_SQL}, {SPAN_SQL},
n AS (SELECT *, CAST(greatest(ceil((t1 - t0) / 86400.0), 1) AS INT) AS cells FROM span),
g AS (SELECT _source_file, i AS segment_index, t0 + 86400.0 * i AS seg_start_s, CASE WHEN i = cells - 1 THEN t1 ELSE t0 + 86400.0 * (i + 1) END AS seg_end_s, i = cells - 1 AS is_last FROM n, LATERAL unnest(range(cells)) u(i)),
tail AS (SELECT _source_file, max(CASE WHEN is_last AND seg_end_s - seg_start_s < 3600 THEN segment_index END) AS runt FROM g GROUP BY 1),
scene AS (SELECT g._source_file, g.segment_index, g.seg_start_s, CASE WHEN g.segment_index + 1 = runt THEN (SELECT t1 FROM span s WHERE s._source_file = g._source_file) ELSE g.seg_end_s END AS seg_end_s,
  g.is_last OR coalesce(g.segment_index + 1 = runt, false) AS is_last, g._source_file || '#' || g.segment_index AS scene_id FROM g JOIN tail USING (_source_file) WHERE runt IS NULL OR g.segment_index < runt)"""
GRID = PARAMS.__class__(**{**PARAMS.__dict__, "changepoint_signals": ("none",)})


def _grid(spark, sf, p=GRID):
    g = gold(spark, sf)
    return g, scenes.boundaries(g, scenes.signal_stats(g, p), p)


@query(f"WITH {SCOPED_SQL} SELECT _source_file, signal_key, channel, n_samples, t_min_s, t_max_s, median_value, round(robust_sigma, 9) AS robust_sigma FROM stats")
def scene_signal_stats(spark, sf):
    s = scenes.signal_stats(gold(spark, sf), PARAMS)
    return s.select("_source_file", "signal_key", "channel", "n_samples", "t_min_s", "t_max_s", "median_value", F.round("robust_sigma", 9).alias("robust_sigma"))


CHANGE_SQL = f"""{SCOPED_SQL}, lagged AS (SELECT s.*, robust_sigma, lag(signal_value) OVER w AS prev FROM scoped s JOIN stats USING (_source_file, signal_key) WHERE s.signal_name IN ('click', 'signup') WINDOW w AS (PARTITION BY _source_file, signal_key ORDER BY s.timestamp_ns, signal_value)),
change AS (SELECT _source_file, round(timestamp_s / 60.0) * 60.0 AS boundary_s, max(abs(signal_value - prev) / robust_sigma) AS strength FROM lagged WHERE abs(signal_value - prev) / robust_sigma > 1.2 GROUP BY 1, 2)"""


@query(f"WITH {CHANGE_SQL} SELECT _source_file, boundary_s, round(strength, 6) AS strength FROM change")
def scene_changepoints(spark, sf):
    g = gold(spark, sf)
    return scenes.changepoints(g, scenes.signal_stats(g, PARAMS), PARAMS).withColumn("strength", F.round("strength", 6))


@query(f"""WITH RECURSIVE {CHANGE_SQL}, {SPAN_SQL},
cand AS (SELECT c._source_file, boundary_s AS t, true AS cp FROM change c JOIN span s USING (_source_file) WHERE boundary_s > t0 AND boundary_s < t1
  UNION ALL SELECT _source_file, t0 + 86400.0 * i, false FROM span, LATERAL unnest(range(1, CAST(greatest(ceil((t1 - t0) / 86400.0), 1) AS INT))) u(i) WHERE t0 + 86400.0 * i < t1),
walk AS (SELECT _source_file, t0 AS t, false AS cp, 0 AS k FROM span
  UNION ALL SELECT w._source_file, x.t, x.cp, w.k + 1 FROM walk w, LATERAL (SELECT c.t, c.cp FROM cand c WHERE c._source_file = w._source_file AND c.t - w.t >= 3600.0 ORDER BY c.t, c.cp LIMIT 1) x),
kept AS (SELECT w.* FROM walk w JOIN span s USING (_source_file) WHERE k = 0 OR t1 - t >= 3600.0)
SELECT _source_file, CAST(k AS INT) AS segment_index, round(t, 6) AS seg_start_s, round(coalesce(lead(t) OVER (PARTITION BY _source_file ORDER BY k), t1), 6) AS seg_end_s, cp AS from_changepoint,
  lead(t) OVER (PARTITION BY _source_file ORDER BY k) IS NULL AS is_last, _source_file || '#' || k AS scene_id FROM kept JOIN span USING (_source_file)""")
def scene_boundaries(spark, sf):
    _, b = _grid(spark, sf, PARAMS)
    return b.select("_source_file", "segment_index", F.round("seg_start_s", 6).alias("seg_start_s"), F.round("seg_end_s", 6).alias("seg_end_s"), "from_changepoint", "is_last", "scene_id")


@query(f"WITH {GRID_SQL} SELECT s._source_file, s.timestamp_ns, s.signal_key, scene_id FROM scoped s JOIN scene c ON s._source_file = c._source_file AND s.timestamp_s >= c.seg_start_s AND (s.timestamp_s < c.seg_end_s OR (c.is_last AND s.timestamp_s = c.seg_end_s))")
def scene_range_join(spark, sf):
    g, b = _grid(spark, sf)
    return interval_join(scenes.in_scope(g, GRID), b, GRID.window_s).select("_source_file", "timestamp_ns", "signal_key", "scene_id")


FEATURE_SQL = f"""{GRID_SQL}, ordered AS (SELECT *, CAST(signal_value AS VARCHAR) AS state, lag(signal_value) OVER w AS prev, lead(timestamp_s) OVER w AS nxt FROM scoped WINDOW w AS (PARTITION BY _source_file, signal_key ORDER BY timestamp_ns, signal_value)),
cut AS (SELECT o.*, c.scene_id, c.segment_index, c.seg_start_s, c.seg_end_s, greatest(least(coalesce(nxt, c.seg_end_s), c.seg_end_s) - timestamp_s, 0) AS dt
  FROM ordered o JOIN scene c ON o._source_file = c._source_file AND o.timestamp_s >= c.seg_start_s AND (o.timestamp_s < c.seg_end_s OR (c.is_last AND o.timestamp_s = c.seg_end_s))),
feat AS (SELECT _source_file, scene_id, segment_index, seg_start_s, seg_end_s, signal_key, signal_source, channel, signal_name, count(*) AS n_samples, avg(signal_value) AS mean_v, stddev_samp(signal_value) AS std_v,
  min(signal_value) AS min_v, max(signal_value) AS max_v, arg_min(signal_value, timestamp_ns) AS first_v, arg_max(signal_value, timestamp_ns) AS last_v, min(event_time) AS event_time_start,
  CASE WHEN count(*) < 2 OR regr_sxx(signal_value, timestamp_s) = 0 THEN 0 ELSE regr_slope(signal_value, timestamp_s) END AS slope_per_s,
  CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> signal_value THEN 1 ELSE 0 END) AS BIGINT) AS n_transitions, sum(CASE WHEN signal_value <> 0 THEN dt ELSE 0 END) AS on_s, sum(dt) AS cover_s FROM cut GROUP BY ALL),
features AS (SELECT *, last_v - first_v AS delta_v, max_v - min_v AS range_v, CASE WHEN cover_s = 0 THEN 0 ELSE on_s / cover_s END AS duty_cycle, n_transitions / (seg_end_s - seg_start_s) AS transition_rate_hz, n_samples / (seg_end_s - seg_start_s) AS sample_rate_hz FROM feat)"""


def _features(spark, sf, several: bool = False):
    """The features and the scenes; kept where ``several`` steps read them."""
    g, b = _grid(spark, sf)
    f = scenes.signal_features(g, b, GRID)
    return f.persist() if several else f, b


@query(f"""WITH {FEATURE_SQL} SELECT scene_id, signal_key, n_samples, round(mean_v, 6) AS mean_v, round(std_v, 6) AS std_v, min_v, max_v, first_v, last_v, round(slope_per_s, 9) AS slope_per_s, n_transitions, round(delta_v, 6) AS delta_v, round(range_v, 6) AS range_v,
  round(duty_cycle, 6) AS duty_cycle, round(transition_rate_hz, 9) AS transition_rate_hz, round(sample_rate_hz, 9) AS sample_rate_hz, event_time_start FROM features""")
def scene_signal_features(spark, sf):
    f, _ = _features(spark, sf)
    digits = {"mean_v": 6, "std_v": 6, "slope_per_s": 9, "delta_v": 6, "range_v": 6, "duty_cycle": 6, "transition_rate_hz": 9, "sample_rate_hz": 9}
    return f.select("scene_id", "signal_key", "n_samples", "min_v", "max_v", "first_v", "last_v", "n_transitions", "event_time_start", *(F.round(c, d).alias(c) for c, d in digits.items()))


LONG_SQL = f"""{FEATURE_SQL}, long AS (SELECT _source_file, scene_id, signal_key || '.' || feature AS feature_key, feature_value FROM (SELECT _source_file, scene_id, signal_key,
  unnest(['mean_v', 'std_v', 'delta_v', 'range_v', 'slope_per_s', 'duty_cycle', 'transition_rate_hz']) AS feature, unnest([mean_v, std_v, delta_v, range_v, slope_per_s, duty_cycle, transition_rate_hz]) AS feature_value FROM features) WHERE feature_value IS NOT NULL)"""


@query(f"WITH {LONG_SQL} SELECT feature_key, count(DISTINCT scene_id) AS n_scenes, round(quantile_disc(feature_value, 0.5), 6) AS median_value FROM long GROUP BY 1")
def scene_feature_medians(spark, sf):
    f, _ = _features(spark, sf, several=True)
    index = scenes.feature_index(f, GRID)
    counts = scenes.melt(f, scenes.CLUSTER_FEATURES).where("feature_value is not null").groupBy("feature_key").agg(F.countDistinct("scene_id").alias("n_scenes"))
    return index.select(F.explode("median_map").alias("feature_key", "m")).join(counts, "feature_key").select("feature_key", "n_scenes", F.round("m", 6).alias("median_value"))


@query(f"""WITH {LONG_SQL}, med AS (SELECT feature_key, quantile_disc(feature_value, 0.5) AS m FROM long GROUP BY 1),
x AS (SELECT s.scene_id, med.feature_key, coalesce(l.feature_value, med.m, 0) AS v FROM (SELECT DISTINCT scene_id FROM long) s CROSS JOIN med LEFT JOIN long l ON l.scene_id = s.scene_id AND l.feature_key = med.feature_key)
SELECT scene_id, count(*) AS n, round(sum(v), 3) AS total FROM x GROUP BY 1""")
def scene_vectors(spark, sf):
    f, _ = _features(spark, sf, several=True)
    v = scenes.vectors(f, scenes.feature_index(f, GRID))
    total = F.aggregate("feature_vector", F.lit(0.0), lambda a, x: a + x)
    return v.select("scene_id", F.size("feature_vector").cast("long").alias("n"), F.round(total, 3).alias("total"))


Z_SQL = f"""{LONG_SQL}, med AS (SELECT feature_key, quantile_disc(feature_value, 0.5) AS m FROM long GROUP BY 1), mad AS (SELECT feature_key, quantile_disc(abs(feature_value - m), 0.5) AS mad FROM long JOIN med USING (feature_key) GROUP BY 1),
z AS (SELECT scene_id, feature_key, feature_value, m, mad, (feature_value - m) / greatest(1.4826 * mad, 1e-9) AS z FROM long JOIN med USING (feature_key) JOIN mad USING (feature_key))"""


@query(f"WITH {Z_SQL} SELECT scene_id, feature_key, CASE WHEN mad < 1e-6 THEN CASE WHEN abs(feature_value - m) < 1e-6 THEN 0.0 ELSE 10.0 END ELSE round(least(abs(z), 10.0), 4) END::DOUBLE AS abs_z FROM z")
def scene_feature_z(spark, sf):
    """Over a MAD of 0 the last digit of a value would decide: such features have
    0 at the median and the limit elsewhere."""
    f, _ = _features(spark, sf, several=True)
    z = scenes.feature_z(f, GRID)
    flat = F.when(F.abs(F.col("feature_value") - F.col("median_value")) < 1e-6, 0.0).otherwise(10.0)
    return z.select("scene_id", "feature_key", F.when(F.col("mad") < 1e-6, flat).otherwise(F.round("abs_z", 4)).alias("abs_z"))


RULES = [
    dict(rule_id="high_click", condition_index=0, label="clicked high", priority=2, signal_source="CAN", channel="", signal_name="click", feature="max_v", op="gt", value_a=400, value_b="", negate="false"),
    dict(rule_id="high_click", condition_index=1, label="clicked high", priority=2, signal_source="CAN", channel="1", signal_name="view", feature="min_v", op="between", value_a=5, value_b=120, negate="false"),
    dict(rule_id="falls", condition_index=0, label="fell", priority=1, signal_source="CAN", channel="", signal_name="purchase", feature="delta_v", op="abs_ge", value_a=300, value_b="", negate=""),
    dict(rule_id="not_low", condition_index=0, label="never low", priority=9, signal_source="SOMEIP", channel="2", signal_name="signup", feature="min_v", op="le", value_a=30, value_b="", negate="yes"),
]
LABEL_SQL = f"""{FEATURE_SQL}, fired AS (
  SELECT scene_id, 'high_click' AS rule_id, 'clicked high' AS label, 2 AS priority FROM features GROUP BY scene_id HAVING max(CASE WHEN signal_source = 'CAN' AND signal_name = 'click' AND max_v > 400 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN signal_source = 'CAN' AND signal_name = 'view' AND channel = 1 AND min_v BETWEEN 5 AND 120 THEN 1 ELSE 0 END) = 1
  UNION ALL SELECT scene_id, 'falls', 'fell', 1 FROM features WHERE signal_source = 'CAN' AND signal_name = 'purchase' AND abs(delta_v) >= 300 GROUP BY scene_id
  UNION ALL SELECT scene_id, 'not_low', 'never low', 9 FROM features WHERE signal_source = 'SOMEIP' AND signal_name = 'signup' AND channel = 2 AND NOT min_v <= 30 GROUP BY scene_id),
labels AS (SELECT scene_id, string_agg(label, ',' ORDER BY label) AS action_labels, string_agg(rule_id, ',' ORDER BY rule_id) AS matched_rule_ids, arg_min(label, priority) AS primary_action_label FROM fired GROUP BY 1)"""


def _labels(f, b):
    return scenes.labels(f, b, scenes.compile_rules(RULES), GRID)


@query(f"WITH {LABEL_SQL} SELECT * FROM labels")
def scene_labels(spark, sf):
    f, b = _features(spark, sf)
    return _labels(f, b).select("scene_id", F.array_join("action_labels", ",").alias("action_labels"), F.array_join("matched_rule_ids", ",").alias("matched_rule_ids"), "primary_action_label")


@query("SELECT event_id, round(100.0 * (1.0 - exp(-(0.45 * greatest(value / 100 - 2, 0) + 0.40 * greatest(value / 200, 0) + 0.15 * greatest(-log2(greatest(value / 1000, 1e-9)), 0)) / 3.0)), 6) AS score FROM events")
def anomaly_score(spark, sf):
    v = F.col("value")
    score = scenes.anomaly_score(v / 100 - 2, v / 200, -F.log2(F.greatest(v / 1000, F.lit(1e-9))), PARAMS.weights, PARAMS.anomaly_scale)
    return table(spark, sf, "events").select("event_id", F.round(score, 6).alias("score"))


@query()
def scene_clusters_full(spark, sf):
    """The whole scene table with clusters and scores; k-means is beyond SQL."""
    f, b = _features(spark, sf, several=True)
    v = scenes.vectors(f, scenes.feature_index(f, GRID)).cache()
    return scenes.scenes(f, scenes.feature_z(f, GRID), scenes.cluster_assignments(v, GRID), _labels(f, b), GRID).orderBy("scene_id")


@query()
def scene_cluster_profile(spark, sf):
    return scenes.clusters(scene_clusters_full(spark, sf))


@query(f"""WITH {LABEL_SQL}, d AS (SELECT DISTINCT scene_id, _source_file, seg_start_s, seg_end_s FROM features), s AS (SELECT d.*, coalesce(primary_action_label, 'idle') AS label, seg_end_s - seg_start_s AS duration_s FROM d LEFT JOIN labels USING (scene_id))
SELECT label AS primary_action_label, count(*) AS n_scenes, round(avg(duration_s), 2) AS mean_duration_s FROM s GROUP BY 1""")
def report_primary_labels(spark, sf):
    f, b = _features(spark, sf)
    s = f.select("scene_id", "_source_file", (F.col("seg_end_s") - F.col("seg_start_s")).alias("duration_s")).distinct().join(_labels(f, b).drop("_source_file"), "scene_id", "left")
    s = s.withColumns({"primary_action_label": F.coalesce("primary_action_label", F.lit("idle")), "anomaly_score": F.lit(0.0)})
    return reports.primary_label_counts(s).drop("mean_anomaly")


@query(f"WITH {LABEL_SQL} SELECT label, count(*) AS n_scenes FROM fired GROUP BY 1")
def report_label_counts(spark, sf):
    f, b = _features(spark, sf)
    return reports.label_counts(_labels(f, b))


@query(f"WITH {GRID_SQL} SELECT _source_file, count(*) AS n_scenes, round(min(seg_end_s - seg_start_s), 3) AS min_duration_s, round(avg(seg_end_s - seg_start_s), 2) AS mean_duration_s, round(max(seg_end_s - seg_start_s), 2) AS max_duration_s, round(min(seg_start_s), 2) AS t_start_s, round(max(seg_end_s), 2) AS t_end_s, 0.0::DOUBLE AS changepoint_pct FROM scene GROUP BY 1")
def report_segmentation(spark, sf):
    return reports.segmentation_by_file(_grid(spark, sf)[1])


@query("SELECT 0::BIGINT AS gaps, 0::BIGINT AS overlaps")
def report_tiling(spark, sf):
    return reports.tiling(_grid(spark, sf, PARAMS)[1])


# ── buses ───────────────────────────────────────────────────────────────────

BUS_SQL = f"""{FRAMES_SQL}, observed AS (SELECT _source_file, 'CAN' AS signal_source, channel, can_id AS message_id, count(*) AS msg_count FROM frames WHERE NOT (channel = 3 AND can_id > 259) GROUP BY ALL),
native AS (SELECT DISTINCT 'CAN' AS signal_source, 'bus' || (n_regionkey % 3) AS bus_name, CAST(257 + n_nationkey % 9 AS BIGINT) AS message_id FROM nation),
pairs AS (SELECT o._source_file, o.signal_source, o.channel, b.bus_name, (SELECT count(*) FROM observed x WHERE x._source_file = o._source_file AND x.channel = o.channel AND x.message_id IN (SELECT message_id FROM native n WHERE n.bus_name = b.bus_name)) AS n, o.n AS no, b.n AS nb
  FROM (SELECT _source_file, signal_source, channel, count(*) AS n FROM observed GROUP BY ALL) o JOIN (SELECT signal_source, bus_name, count(*) AS n FROM native GROUP BY ALL) b USING (signal_source)),
scored AS (SELECT _source_file, signal_source, channel, bus_name, n / nb AS recall, n / no AS precision, n / (no + nb - n) AS jaccard FROM pairs)"""


def _bus(spark, sf):
    f = frames(spark, sf).where("not (channel = 3 and can_id > 259)")
    n = table(spark, sf, "nation")
    ecu = F.concat(F.lit("ecu"), F.col("n_nationkey").cast("string"))
    wired = n.select(ecu.alias("ecu"), F.concat(F.lit("bus"), (F.col("n_regionkey") % 3).cast("string")).alias("bus_name"))
    sent = n.select(F.concat(F.lit("0x"), F.hex(257 + F.col("n_nationkey") % 9)).alias("message_id"), ecu.alias("sender_ecu"))
    return busmap.observed(f), busmap.native_sets(spark, wired, sent)


@query(f"WITH {BUS_SQL} SELECT * FROM observed")
def bus_observed(spark, sf):
    return _bus(spark, sf)[0]


@query(f"WITH {BUS_SQL} SELECT * FROM native")
def bus_native(spark, sf):
    return _bus(spark, sf)[1]


@query(f"WITH {BUS_SQL} SELECT _source_file, signal_source, channel, bus_name, round(CASE WHEN recall + precision = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END, 9) AS score, round(recall, 9) AS recall, round(precision, 9) AS precision, round(jaccard, 9) AS jaccard FROM scored")
def bus_scores(spark, sf):
    s = busmap.scores(*_bus(spark, sf))
    return s.select("_source_file", "signal_source", "channel", "bus_name", *(F.round(c, 9).alias(c) for c in ("score", "recall", "precision", "jaccard")))


@query()
def bus_mapping(spark, sf):
    """The assignment of greatest weight; ties may be matched either way."""
    return busmap.assign_buses(busmap.scores(*_bus(spark, sf))).orderBy("_source_file", "channel")


@query(f"""WITH {GOLD_SQL} SELECT _source_file, signal_source, channel, timestamp_ns, CASE WHEN signal_source = 'CAN' AND channel < 2 THEN 'bus' || channel END AS bus_name, CASE WHEN signal_source = 'CAN' AND channel < 2 THEN 0.5 + channel / 4 END AS bus_match_score FROM gold""")
def gold_with_bus(spark, sf):
    g = gold(spark, sf)
    mapping = g.where("signal_source = 'CAN' and channel < 2").select("_source_file", "signal_source", "channel").distinct()
    mapping = mapping.select("*", F.concat(F.lit("bus"), F.col("channel").cast("string")).alias("matched_bus"), (0.5 + F.col("channel") / 4).alias("score"), F.lit("").alias("note"))
    return busmap.gold_with_bus(g, mapping).select("_source_file", "signal_source", "channel", "timestamp_ns", "bus_name", "bus_match_score")


# ── sinks as queries ────────────────────────────────────────────────────────


@query(f"""WITH {FRAMES_SQL} SELECT timestamp_ns || ',' || strftime(TIMESTAMP '2024-01-01' + to_microseconds(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(timestamp_ns % 1000000000 AS VARCHAR), 9, '0') || 'Z,CAN,'
  || channel || ',' || CASE dir WHEN 0 THEN 'Tx' WHEN 1 THEN 'Rx' WHEN 2 THEN 'TxRq' ELSE 'Unknown(3)' END || ',,,,' || printf('0x%X', can_id) || ',false,8,' || data_hex AS line FROM frames""")
def raw_csv_lines(spark, sf):
    from wirelake.sinks.csv import raw_lines

    f = frames(spark, sf)
    none = {c: F.lit(None).cast(t) for c, t in (("src_addr", "binary"), ("dst_addr", "binary"), ("ether_type", "int"), ("vlan_id", "int"), ("mf4_value", "double"), ("mf4_unit", "string"))}
    return raw_lines(f.withColumns(none | {"is_ext_id": F.lit(False), "dlc": F.lit(8)})).select("line")


@query("""WITH base AS (SELECT p_partkey AS message_id, p_name AS signal_name, p_size AS scale FROM part), overlay AS (SELECT p_partkey AS message_id, p_name AS signal_name, p_size + 1000 AS scale FROM part WHERE p_partkey % 10 = 0)
SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM overlay o WHERE o.message_id = b.message_id AND o.signal_name = b.signal_name) UNION ALL SELECT * FROM overlay""")
def definition_merge(spark, sf):
    from wirelake.sources.definitions import merge

    base = table(spark, sf, "part").select(F.col("p_partkey").alias("message_id"), F.col("p_name").alias("signal_name"), F.col("p_size").alias("scale"))
    return merge(base, base.where("message_id % 10 = 0").withColumn("scale", F.col("scale") + 1000))


@query("""WITH d AS (SELECT p_partkey AS i, p_partkey % 7 AS k FROM part)
SELECT CAST(i + 1 AS BIGINT) AS line, CASE k WHEN 1 THEN 'invalid message_id: "zz"' WHEN 2 THEN 'invalid byte_order: "Big", expected Intel or Motorola' WHEN 3 THEN 'invalid start_byte: "1.5" (must be a whole number, not a decimal; if this came from a spreadsheet, format the column as integer or text)'
  WHEN 4 THEN 'invalid scale: "x"' ELSE 'bit_length 65 is over 64' END AS message FROM d WHERE k BETWEEN 1 AND 5""")
def definition_check(spark, sf):
    from wirelake.sources.definitions import check

    k = F.col("p_partkey") % 7
    rows = table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("line"),
        F.lit(9).alias("n_fields"),
        F.when(k == 1, "zz").otherwise(F.concat(F.lit("0x"), F.hex("p_partkey"))).alias("message_id"),
        F.col("p_name").alias("signal_name"),
        F.when(k == 3, "1.5").otherwise("0").alias("start_byte"),
        F.lit("0").alias("start_bit"),
        F.when(k == 5, "65").otherwise("8").alias("bit_length"),
        F.when(k == 2, "Big").otherwise("Motorola").alias("byte_order"),
        F.lit("false").alias("is_signed"),
        F.when(k == 4, "x").otherwise("").alias("scale"),
        F.lit("").alias("offset"),
        F.lit("").alias("pdu_id"),
    )
    return check(rows, "can")


@query("""WITH t AS (SELECT doc_id, sha256(lang || '||' || source || '||' || n_chars || '||' || doc_id) AS section_id FROM documents) SELECT doc_id, section_id FROM t WHERE doc_id % 2 = 1""")
def docs_insert_only(spark, sf):
    """Sections that an insert-only merge appends: those whose id is new."""
    from wirelake.sources.documents import new_sections

    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("||", "lang", "source", F.col("n_chars").cast("string"), F.col("doc_id").cast("string")), 256).alias("section_id"))
    return new_sections(d, d.where("doc_id % 2 = 0"))


@query("SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS first_qty FROM lineitem GROUP BY 1")
def conditional_pivot(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("first_qty"))


@query(f"""WITH {GOLD_SQL} SELECT _source_file, signal_name, timestamp_ns, lag(signal_value) OVER w AS prev, lead(timestamp_ns) OVER w AS next_ns, (row_number() OVER w)::INT AS n, (ntile(4) OVER w)::INT AS quarter FROM gold WINDOW w AS (PARTITION BY _source_file, signal_name ORDER BY timestamp_ns, signal_value)""")
def window_functions(spark, sf):
    w = Window.partitionBy("_source_file", "signal_name").orderBy("timestamp_ns", "signal_value")
    return gold(spark, sf).select("_source_file", "signal_name", "timestamp_ns", F.lag("signal_value").over(w).alias("prev"), F.lead("timestamp_ns").over(w).alias("next_ns"), F.row_number().over(w).alias("n"), F.ntile(4).over(w).alias("quarter"))


@query(f"WITH {GOLD_SQL} SELECT signal_source, round(min(timestamp_ns / 1e9), 6) AS first_s, count(*) AS n FROM gold WHERE signal_source IN ('CAN', 'ETH') GROUP BY 1")
def source_filter(spark, sf):
    g = gold(spark, sf).where(F.col("signal_source").isin("CAN", "ETH"))
    return g.groupBy("signal_source").agg(F.round(F.min(seconds()), 6).alias("first_s"), F.count(F.lit(1)).alias("n"))


# ── more protocol and table queries ─────────────────────────────────────────


def _conversations(spark, sf):
    """Line items as ISO-TP: per order a first frame of 9 bytes and its
    consecutive frame, out of sequence for every fifth order; single frames for
    even part keys."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    k, p = F.col("l_orderkey"), F.col("l_partkey")

    def h(value, digits):
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    first = F.concat(F.lit("100962F1"), h(k % 65536, 4), F.lit("AABB"))
    second = F.concat(F.when(k % 5 == 0, "22").otherwise("21"), h(p % 65536, 4), F.lit("CC0000000000"))
    single = F.concat(F.lit("0322"), h(p % 65536, 4), F.lit("00000000"))
    frames = F.array(
        F.struct(F.lit(0).alias("step"), F.lit(0x7E8).alias("can_id"), F.unhex(first).alias("data")),
        F.struct(F.lit(1).alias("step"), F.lit(0x7E8).alias("can_id"), F.unhex(second).alias("data")),
        F.struct(F.lit(2).alias("step"), F.when(p % 2 == 0, 0x7E0).otherwise(0x100).alias("can_id"), F.unhex(single).alias("data")),
    )
    rows = li.select(k, F.concat(F.lit("f"), (k % 4).cast("string")).alias("_source_file"), F.col("l_suppkey").cast("int").alias("channel"), F.inline(frames))
    return rows.select("_source_file", F.lit(1).cast("long").alias("start_ns"), (k * 10 + F.col("step")).alias("row_in_file"), (k * 1000 + F.col("step")).alias("timestamp_ns"), F.lit("CAN").alias("message_type"), "channel", F.col("can_id").cast("long").alias("can_id"), F.lit(1).cast("byte").alias("dir"), "data", F.lit(None).cast("int").alias("ether_type"))


CONVERSATION_SQL = """c AS (SELECT l_orderkey AS k, min(l_partkey) AS p, min(l_suppkey) AS channel FROM lineitem GROUP BY 1),
uds AS (SELECT 'f' || (k % 4) AS _source_file, CAST(channel AS INT) AS channel, 2024::BIGINT AS can_id, k * 1000 AS timestamp_ns, 'PositiveResponse' AS uds_type, 'F1' || printf('%04X', k % 65536) || 'AABB' || printf('%04X', p % 65536) || 'CC' AS data_hex FROM c WHERE k % 5 <> 0
  UNION ALL SELECT 'f' || (k % 4), CAST(channel AS INT), 2016, k * 1000 + 2, 'Request', printf('%04X', p % 65536) FROM c WHERE p % 2 = 0)"""


@query(f"WITH {CONVERSATION_SQL} SELECT *, 'ReadDataByIdentifier' AS service_name FROM uds")
def isotp_reassembly(spark, sf):
    from wirelake.operators.diagnostics import uds_rows

    return uds_rows(_conversations(spark, sf)).select("_source_file", "channel", "can_id", "timestamp_ns", "uds_type", F.hex("data").alias("data_hex"), "service_name")


@query("""SELECT o_orderkey, o_orderkey % 65536 AS doip_src_addr, o_custkey % 65536 AS doip_target_addr, '22' || printf('%04X', o_custkey % 65536) AS uds_hex FROM orders WHERE o_orderkey % 2 = 0""")
def doip_parse(spark, sf):
    """Orders as DoIP over TCP; odd ones on another port."""
    from wirelake.operators.network import parse_doip

    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def h(value, digits):
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    doip = F.concat(F.lit("02FD800100000007"), h(k % 65536, 4), h(c % 65536, 4), F.lit("22"), h(c % 65536, 4))
    tcp = F.concat(F.when(k % 2 == 0, "3458").otherwise("3459"), F.lit("0001000000000000000050180000"), F.lit("00000000"), doip)
    ip = F.concat(F.lit("450000370000000040060000"), F.lit("0A000001C0A80001"), tcp)
    eth = table(spark, sf, "orders").select(k, F.lit(0x0800).alias("ether_type"), F.unhex(ip).alias("data"))
    rows = parse_doip(eth, drop=("data", "ether_type"))
    return rows.select("o_orderkey", F.col("doip_src_addr").cast("long").alias("doip_src_addr"), F.col("doip_target_addr").cast("long").alias("doip_target_addr"), F.hex("uds").alias("uds_hex"))


@query(f"""WITH {FRAMES_SQL} SELECT timestamp_ns, part, 'Days' AS signal_name, (CAST('0x' || substr(data_hex, 9, 2) AS BIGINT) + 256 * CAST('0x' || substr(data_hex, 11, 2) AS BIGINT))::DOUBLE AS signal_value FROM frames WHERE can_id <= 260""")
def container_signals(spark, sf):
    """The last four bytes of a frame as PDU 5 of a container, decoded."""
    f = frames(spark, sf).withColumn("data", F.concat(F.unhex(F.lit("00000504")), F.substring("data", 5, 4)))
    d = spark.createDataFrame([(257 + i, "Days", 0, 16, "Intel", False, 1.0, 0.0, 5) for i in range(4)], "message_id long, signal_name string, start_bit int, bit_length int, byte_order string, is_signed boolean, scale double, offset double, pdu_id long")
    pdus = D.demux(f.select("timestamp_ns", "part", "can_id", "data"), d)
    return D.decode_pdus(pdus, d, drop=("pdu_payload", "pdu_id", "can_id")).drop("signal_str")


@query("""SELECT o_orderkey, 'Key' AS signal_name, (o_orderkey % 4294967296)::DOUBLE AS signal_value FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 65535 < 500""")
def someip_signals(spark, sf):
    m = parse_someip(_datagrams(spark, sf)).select("o_orderkey", "someip_service_id", "someip_method_id", "payload")
    ids = m.where("someip_service_id < 500").select(F.col("someip_service_id").alias("service_id"), F.col("someip_method_id").alias("method_id")).distinct()
    d = ids.select("service_id", "method_id", F.lit("Key").alias("signal_name"), F.lit(7).alias("start_bit"), F.lit(32).alias("bit_length"), F.lit("Motorola").alias("byte_order"), F.lit(False).alias("is_signed"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"))
    return D.decode_someip(m, d, drop=("payload", "someip_service_id", "someip_method_id")).drop("signal_str")


@query(f"""WITH {FRAMES_SQL}, n(channel, name) AS (VALUES (1, 'Body'), (3, 'Chassis')) SELECT timestamp_ns, part, coalesce(name, f.channel::VARCHAR) AS shown FROM frames f LEFT JOIN n USING (channel)""")
def channel_names(spark, sf):
    from wirelake.sinks.csv import _channel

    names = spark.createDataFrame([("CAN", 1, "Body"), ("CAN", 3, "Chassis"), ("Ethernet", 0, "no")], "type string, channel int, name string")
    return _channel(frames(spark, sf), names).select("timestamp_ns", "part", F.col("__channel").alias("shown"))


@query("""SELECT p_partkey AS message_id, p_name AS signal_name, (p_partkey % 5 * 8 + p_partkey % 8)::INT AS start_bit, p_size AS bit_length, CASE WHEN p_partkey % 2 = 0 THEN 'Intel' ELSE 'Motorola' END AS byte_order, p_partkey % 3 = 0 AS is_signed,
  CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS scale, CASE WHEN p_partkey % 6 = 0 THEN -40.5 ELSE 0 END::DOUBLE AS "offset", CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 7 END AS pdu_id FROM part""")
def typed_definitions(spark, sf):
    from wirelake.sources.definitions import load

    p = F.col("p_partkey")
    text = table(spark, sf, "part").select(
        F.concat(F.lit("0x"), F.hex(p)).alias("message_id"), F.col("p_name").alias("signal_name"), (p % 5).cast("string").alias("start_byte"), (p % 8).cast("string").alias("start_bit"), F.col("p_size").cast("string").alias("bit_length"),
        F.when(p % 2 == 0, "INTEL").otherwise("motorola").alias("byte_order"), F.when(p % 3 == 0, "TRUE").otherwise("0").alias("is_signed"), F.when(p % 4 == 0, "").otherwise("0.25").alias("scale"), F.when(p % 6 == 0, "-40.5").otherwise("").alias("offset"),
        F.when(p % 10 == 0, (p % 7).cast("string")).otherwise("").alias("pdu_id"),
    )
    return load(spark, text, "can")


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT _source_file, part, timestamp_ns, lag(timestamp_ns) OVER (PARTITION BY _source_file ORDER BY part, timestamp_ns) AS previous_ns FROM frames) SELECT _source_file, timestamp_ns, previous_ns, previous_ns - timestamp_ns AS delta_ns FROM l WHERE timestamp_ns < previous_ns""")
def time_runs_back(spark, sf):
    from wirelake.cli import boundary_warnings

    order = Window.partitionBy("_source_file").orderBy("part", "timestamp_ns")
    return boundary_warnings(frames(spark, sf).withColumn("row_in_file", F.row_number().over(order))).drop("row_in_file")


@query("""SELECT 'n' || n_regionkey AS folder, string_agg('n' || n_regionkey || '/' || n_nationkey || '.blf', ',' ORDER BY 'n' || n_regionkey || '/' || n_nationkey || '.blf') AS files FROM nation GROUP BY 1""")
def file_folders(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"), F.lit(".blf")).alias("_source_file"))
    return viewer.folders(n).withColumn("files", F.array_join("files", ","))


@query("SELECT 'c' || c_custkey AS _source_file FROM customer ORDER BY 1 LIMIT 200")
def source_file_list(spark, sf):
    return viewer.source_files(table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("_source_file")))


# orders as scenes: clusters by customer, scores by price
SCENES_SQL = """s AS (SELECT o_orderkey AS scene_id, 'f' || (o_custkey % 9) AS _source_file, CAST(o_custkey % 4 AS INT) AS cluster_id, o_totalprice / 5000 AS anomaly_score, 10.0 + o_custkey % 7 AS duration_s, o_totalprice / 1000 AS centroid_distance,
  CASE WHEN o_orderstatus = 'F' THEN 'idle' ELSE o_orderpriority END AS primary_action_label FROM orders)"""


def _scenes(spark, sf):
    o = table(spark, sf, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "idle").otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("scene_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 9).cast("string")).alias("_source_file"), (F.col("o_custkey") % 4).cast("int").alias("cluster_id"), (F.col("o_totalprice") / 5000).alias("anomaly_score"), (10.0 + F.col("o_custkey") % 7).alias("duration_s"), (F.col("o_totalprice") / 1000).alias("centroid_distance"), label.alias("primary_action_label"))


@query(f"""WITH {SCENES_SQL} SELECT count(*) AS n_scenes, count(DISTINCT _source_file) AS n_files, count(DISTINCT cluster_id) AS n_clusters, round(avg(duration_s), 2)::DOUBLE AS mean_duration_s, round(100.0 * avg(CASE WHEN primary_action_label <> 'idle' THEN 1 ELSE 0 END), 1) AS labeled_pct, round(max(anomaly_score), 1) AS max_anomaly FROM s""")
def report_overview(spark, sf):
    out = reports.overview(_scenes(spark, sf).withColumn("n_features_present", F.lit(1)))
    return out.select("n_scenes", "n_files", "n_clusters", "mean_duration_s", "labeled_pct", "max_anomaly")


@query(f"""WITH {SCENES_SQL} SELECT scene_id, round(anomaly_score, 1) AS anomaly_score, primary_action_label FROM s ORDER BY s.anomaly_score DESC, scene_id LIMIT 20""")
def report_top_scenes(spark, sf):
    top = F.array(F.struct(F.lit("f").alias("feature"), F.lit(1.0).alias("z")))
    s = _scenes(spark, sf).withColumns({"segment_index": F.lit(0), "seg_start_s": F.lit(0.0), "seg_end_s": F.lit(1.0), "n_features_present": F.lit(1), "z_max": F.lit(1.0), "top_features": top, "scene_summary": F.lit(None).cast("string")})
    return reports.top_scenes(s, 20).select("scene_id", "anomaly_score", "primary_action_label")


@query(f"""WITH {SCENES_SQL} SELECT cluster_id, count(*)::INT AS n_scenes, round(avg(duration_s), 6)::DOUBLE AS mean_duration_s, round(avg(anomaly_score), 6) AS mean_anomaly_score, string_agg(DISTINCT primary_action_label, ',' ORDER BY primary_action_label) AS action_labels FROM s GROUP BY 1""")
def cluster_profile(spark, sf):
    s = _scenes(spark, sf).withColumns({"cluster_share": F.lit(0.25), "k_used": F.lit(4), "speed_mean_kmh": F.lit(1.0)})
    c = scenes.clusters(s)
    return c.select("cluster_id", "n_scenes", F.round("mean_duration_s", 6).alias("mean_duration_s"), F.round("mean_anomaly_score", 6).alias("mean_anomaly_score"), F.array_join("action_labels", ",").alias("action_labels"))


@query("""WITH z AS (SELECT l_orderkey AS scene_id, 'k' || l_linenumber AS feature_key, l_quantity - 25 AS z, least(abs(l_quantity - 25), 10)::DOUBLE AS abs_z FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY abs_z DESC, feature_key DESC, z DESC) AS n FROM z)
SELECT scene_id, round(sqrt(avg(abs_z * abs_z)), 9) AS z_agg, max(abs_z) AS z_max, count(*)::INT AS n_features_present, string_agg(CASE WHEN n <= 5 THEN feature_key END, ',' ORDER BY n) AS top FROM r GROUP BY 1""")
def z_by_scene(spark, sf):
    z = F.col("l_quantity") - 25
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("feature_key"), z.alias("z"), F.least(F.abs(z), F.lit(10.0)).alias("abs_z"))
    out = scenes.z_by_scene(rows)
    return out.select("scene_id", F.round("z_agg", 9).alias("z_agg"), "z_max", "n_features_present", F.array_join(F.transform("top_features", lambda f: f["feature"]), ",").alias("top"))


@query(f"""WITH {SCENES_SQL}, m AS (SELECT cluster_id, quantile_disc(centroid_distance, 0.5) AS d_median FROM s GROUP BY 1) SELECT cluster_id, round(any_value(d_median), 6) AS d_median, round(quantile_disc(abs(centroid_distance - d_median), 0.5), 6) AS d_mad FROM s JOIN m USING (cluster_id) GROUP BY 1""")
def distance_statistics(spark, sf):
    return scenes.distance_stats(_scenes(spark, sf)).select("cluster_id", F.round("d_median", 6).alias("d_median"), F.round("d_mad", 6).alias("d_mad"))


@query(f"""WITH {GOLD_SQL} SELECT timestamp_ns, TIMESTAMP '2024-01-01 10:00:00' + to_microseconds(CAST(round((timestamp_s - 100) * 1e6) AS BIGINT)) AS x FROM gold WHERE signal_name = 'error'""")
def anomaly_markers(spark, sf):
    rows = gold(spark, sf).where("signal_name = 'error'").select("timestamp_ns", "timestamp_s")
    return viewer.marker_times(rows, "2024-01-01 10:00:00", 100.0).select("timestamp_ns", F.col("x").cast("timestamp_ntz").alias("x"))


@query(f"""WITH {GOLD_SQL}, o AS (SELECT _source_file AS f, min(timestamp_s) AS a, max(timestamp_s) AS b, min(event_time) AS t FROM gold WHERE {KEY_SQL} GROUP BY 1), w AS (SELECT _source_file AS f, min(timestamp_s) AS a, max(timestamp_s) AS b, min(event_time) AS t FROM gold GROUP BY 1)
SELECT w.f AS source_file, coalesce(o.a, w.a) AS t_min, coalesce(o.b, w.b) AS t_max, coalesce(o.t, w.t) AS t0, CASE WHEN w.f = 'drive2.blf' THEN 'v/drive2.mp4' END AS _video_path FROM w LEFT JOIN o USING (f) WHERE w.f IN ('drive1.blf', 'drive2.blf')""")
def video_playlist(spark, sf):
    videos = spark.createDataFrame([("v/drive2.mp4", "drive2", None), ("v/zz.mp4", "zz", None)], "_video_path string, _video_stem string, _video_mtime timestamp")
    return viewer.playlist(gold(spark, sf), videos, ["drive1.blf", "drive2.blf"], KEYS).drop("_video_mtime")
