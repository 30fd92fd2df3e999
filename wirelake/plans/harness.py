"""Adapters that present the harness tables as the engine's tables.

The tables are a star schema and an event stream, not logs; these projections
give them the engine's columns, and the engine's own functions run on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from .scenes import Params

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01, the first event
PARAMS = Params(sources=("CAN", "SOMEIP"), window_s=86_400.0, min_segment_s=3_600.0, quantum_s=60.0, changepoint_k=1.2, changepoint_signals=("click", "signup"), k=4, max_segments=0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as gold signals: five files, three channels, one signal per
    event type; errors carry a category."""
    e = table(spark, sf_dir, "events")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) * 1000
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.concat(F.lit("drive"), (F.col("user_id") % 5).cast("string"), F.lit(".blf")).alias("_source_file"),
        F.when(kind == "signup", "SOMEIP").when(kind == "error", "ETH").otherwise("CAN").alias("signal_source"),
        (F.col("user_id") % 3).cast("int").alias("channel"),
        kind.alias("signal_name"),
        ns.alias("timestamp_ns"),
        (ns / 1e9).alias("timestamp_s"),
        F.col("ts").alias("event_time"),
        F.col("value").alias("signal_value"),
        F.when(kind == "error", F.concat(F.lit("E"), (k % 4).cast("string"))).alias("signal_str"),
    )


GOLD_SQL = f"""gold AS (
  SELECT 'drive' || (user_id % 5) || '.blf' AS _source_file,
         CASE event_type WHEN 'signup' THEN 'SOMEIP' WHEN 'error' THEN 'ETH' ELSE 'CAN' END AS signal_source,
         CAST(user_id % 3 AS INT) AS channel, event_type AS signal_name,
         (epoch_us(ts) - {EPOCH_US}) * 1000 AS timestamp_ns,
         (epoch_us(ts) - {EPOCH_US}) * 1000 / 1e9 AS timestamp_s,
         ts AS event_time, value AS signal_value,
         CASE WHEN event_type = 'error' THEN 'E' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) END AS signal_str
  FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as CAN frames: id by line number, payload of eight bytes in
    little-endian order: quantity (16 bit), discount and tax in percent (8 each),
    days of the ship date (32)."""
    li = table(spark, sf_dir, "lineitem")

    def at(value, byte: int):  # the value's lowest byte, as that byte of the payload
        return F.shiftleft(value.cast("long").bitwiseAND(F.lit(255)), 8 * (7 - byte))

    q, days = F.col("l_quantity").cast("long"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    parts = [at(q, 0), at(F.shiftright(q, 8), 1), at(F.round(F.col("l_discount") * 100), 2), at(F.round(F.col("l_tax") * 100), 3), *(at(F.shiftright(days, 8 * i), 4 + i) for i in range(4))]
    whole = reduce(lambda x, y: x.bitwiseOR(y), parts)
    data = F.lpad(F.hex(whole), 16, "0")
    return li.select(
        F.concat(F.lit("log"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".blf")).alias("_source_file"),
        F.lit("CAN").alias("message_type"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber")).alias("timestamp_ns"),
        F.lit(EPOCH_US * 1000).cast("long").alias("start_ns"),
        (F.col("l_suppkey") % 4).cast("int").alias("channel"),
        (F.lit(256) + F.col("l_linenumber")).cast("long").alias("can_id"),
        (F.col("l_orderkey") % 4).cast("byte").alias("dir"),
        F.col("l_partkey").alias("part"),
        F.unhex(data).alias("data"),
    )


FRAMES_SQL = f"""f0 AS (
  SELECT 'log' || (l_suppkey % 3) || '.blf' AS _source_file, l_orderkey * 1000000 + l_linenumber AS timestamp_ns,
         CAST(l_suppkey % 4 AS INT) AS channel, CAST(256 + l_linenumber AS BIGINT) AS can_id, l_orderkey % 4 AS dir, l_partkey AS part,
         CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS days
  FROM lineitem),
frames AS (
  SELECT *,
    printf('%02X%02X%02X%02X%02X%02X%02X%02X', q % 256, q // 256, d, t, days % 256, days // 256 % 256, days // 65536 % 256, days // 16777216) AS data_hex
  FROM f0)"""

#: definitions over those frames: both byte orders, signs, unaligned fields, a
#: signal beyond the payload (never decoded)
DEFS = [
    *((257 + i, "Quantity", 0, 16, "Intel", False, 1.0, 0.0, None) for i in range(4)),
    *((257 + i, "Discount", 16, 8, "Intel", False, 0.01, 0.0, None) for i in range(7)),
    *((257 + i, "Tax", 31, 8, "Motorola", False, 0.01, -1.0, None) for i in range(7)),
    *((257 + i, "Days", 32, 32, "Intel", True, 1.0, 0.0, None) for i in range(7)),
    *((257 + i, "SignedLow", 32, 8, "Intel", True, 0.5, 10.0, None) for i in range(3)),
    *((257 + i, "Swapped", 39, 16, "Motorola", False, 1.0, 0.0, None) for i in range(2)),
    *((257 + i, "Nibbles", 4, 12, "Intel", False, 1.0, 0.0, None) for i in range(2)),
    (257, "Beyond", 60, 16, "Intel", False, 1.0, 0.0, None),
]


def defs(spark: SparkSession) -> DataFrame:
    from wirelake.schema import CAN_DEFS

    return spark.createDataFrame([(m, n, s, b, o, g, c, f, p) for m, n, s, b, o, g, c, f, p in DEFS], CAN_DEFS)


#: the same decode in SQL, from the hexadecimal digits
DECODE_SQL = f"""{FRAMES_SQL},
b AS (SELECT *, {", ".join(f"CAST('0x' || substr(data_hex, {2 * i + 1}, 2) AS BIGINT) AS b{i}" for i in range(8))} FROM frames),
decoded AS (
  SELECT _source_file, timestamp_ns, channel, can_id, part, 'Quantity' AS signal_name, (b0 + b1 * 256) * 1.0 AS signal_value FROM b WHERE can_id BETWEEN 257 AND 260
  UNION ALL SELECT _source_file, timestamp_ns, channel, can_id, part, 'Discount', b2::DOUBLE * 0.01::DOUBLE FROM b WHERE can_id BETWEEN 257 AND 263
  UNION ALL SELECT _source_file, timestamp_ns, channel, can_id, part, 'Tax', b3::DOUBLE * 0.01::DOUBLE - 1.0::DOUBLE FROM b WHERE can_id BETWEEN 257 AND 263
  UNION ALL SELECT _source_file, timestamp_ns, channel, can_id, part, 'Days', b4 + b5 * 256 + b6 * 65536 + b7 * 16777216 - CASE WHEN b7 > 127 THEN 4294967296 ELSE 0 END FROM b WHERE can_id BETWEEN 257 AND 263
  UNION ALL SELECT _source_file, timestamp_ns, channel, can_id, part, 'SignedLow', (b4 - CASE WHEN b4 > 127 THEN 256 ELSE 0 END) * 0.5 + 10.0 FROM b WHERE can_id BETWEEN 257 AND 259
  UNION ALL SELECT _source_file, timestamp_ns, channel, can_id, part, 'Swapped', b4 * 256 + b5 FROM b WHERE can_id BETWEEN 257 AND 258
  UNION ALL SELECT _source_file, timestamp_ns, channel, can_id, part, 'Nibbles', (b0 + b1 * 256) // 16 FROM b WHERE can_id BETWEEN 257 AND 258)"""
