"""Channel-to-bus inference: which physical bus a channel of a log carries,
from the ids seen on it and the ids that the bus's ECUs send."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions.bytes import parse_id_or_hex
from wirelake.operators.assignment import assign

NATIVE = "signal_source string, bus_name string, message_id long"
MAPPING = "_source_file string, signal_source string, channel int, matched_bus string, score double, recall double, precision double, jaccard double, note string"
LOW, NONE = "score below threshold, needs review", "no bus candidate available"


def _source(spark: SparkSession, source: str | DataFrame | None, columns: list[str]) -> DataFrame:
    """A reference CSV or table as text columns; empty where missing."""
    if source is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    if isinstance(source, DataFrame):
        return source
    try:
        return spark.read.option("header", True).csv(source)
    except Exception as e:  # noqa: BLE001
        print(f"{source} not used: {e}")
        return _source(spark, None, columns)


def native_sets(spark: SparkSession, ecu_bus=None, message_sender=None, service_sender=None) -> DataFrame:
    """(signal_source, bus_name, message_id): the ids sent by the ECUs on a bus."""
    wired = _source(spark, ecu_bus, ["ecu", "bus_name"]).select(F.trim("ecu").alias("ecu"), F.trim("bus_name").alias("bus_name")).where("ecu <> '' and bus_name <> ''")
    sent = None
    for kind, source, id_column in (("CAN", message_sender, "message_id"), ("SOMEIP", service_sender, "service_id")):
        rows = _source(spark, source, [id_column, "sender_ecu"]).select(F.lit(kind).alias("signal_source"), F.trim("sender_ecu").alias("ecu"), parse_id_or_hex(id_column).alias("message_id"))
        sent = rows if sent is None else sent.unionByName(rows)
    return wired.join(sent.where("message_id is not null"), "ecu").select("signal_source", "bus_name", "message_id").distinct()


def observed(can: DataFrame, someip: DataFrame | None = None) -> DataFrame:
    """(_source_file, signal_source, channel, message_id, msg_count)."""
    def counted(df, source, column):
        out = df.groupBy("_source_file", "channel", F.col(column).cast("long").alias("message_id")).agg(F.count(F.lit(1)).alias("msg_count"))
        return out.select("_source_file", F.lit(source).alias("signal_source"), "channel", "message_id", "msg_count")

    out = counted(can, "CAN", "can_id")
    return out if someip is None else out.unionByName(counted(someip, "SOMEIP", "someip_service_id"))


def scores(observed: DataFrame, native: DataFrame, beta: float = 2.0) -> DataFrame:
    """Every channel against every bus of its protocol: recall, precision,
    Jaccard and F-beta of the id sets. Common ids are counted by an equi-join on
    the id, so no set is collected."""
    keys = ["_source_file", "signal_source", "channel"]
    channels = observed.groupBy(*keys).agg(F.countDistinct("message_id").alias("n_observed"))
    buses = native.groupBy("signal_source", "bus_name").agg(F.countDistinct("message_id").alias("n_expected"))
    ids = observed.select(*keys, "message_id").distinct()
    common = ids.join(native, ["signal_source", "message_id"]).groupBy(*keys, "bus_name").agg(F.count(F.lit(1)).alias("n"))
    pairs = channels.join(buses, "signal_source").join(common, [*keys, "bus_name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    zero = F.lit(0.0)
    pairs = pairs.withColumns(
        {
            "recall": F.coalesce(F.try_divide("n", "n_expected"), zero),
            "precision": F.coalesce(F.try_divide("n", "n_observed"), zero),
            "jaccard": F.coalesce(F.try_divide(F.col("n"), F.col("n_observed") + F.col("n_expected") - F.col("n")), zero),
        }
    )
    b2, r, p = beta * beta, F.col("recall"), F.col("precision")
    return pairs.select(*keys, "bus_name", F.coalesce(F.try_divide((1 + b2) * p * r, b2 * p + r), zero).alias("score"), "recall", "precision", "jaccard")


def match_channels(rows: list[dict], min_score: float) -> list[tuple]:
    """(channel, bus, score, recall, precision, jaccard, note) of one group."""
    channels, buses = sorted({r["channel"] for r in rows}), sorted({r["bus_name"] for r in rows})
    at = {(r["channel"], r["bus_name"]): r for r in rows}
    weights = np.array([[at[c, b]["score"] if (c, b) in at else 0.0 for b in buses] for c in channels])
    matched = {channels[i]: buses[j] for i, j in assign(weights)}
    out = []
    for c in channels:
        if c in matched and (r := at.get((c, matched[c]))):
            out.append((c, matched[c], r["score"], r["recall"], r["precision"], r["jaccard"], "" if r["score"] >= min_score else LOW))
        else:
            out.append((c, None, 0.0, 0.0, 0.0, 0.0, NONE))
    return out


def assign_buses(scores: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The one-to-one matching of greatest total score, per file and protocol (a
    group is the channels of one log)."""
    names = [x.split()[0] for x in MAPPING.split(", ")]

    def run(key, table):
        rows = match_channels(table.to_pylist(), min_score)
        columns = list(zip(*rows)) or [()] * 7
        types = [pa.int32(), pa.string(), *[pa.float64()] * 4, pa.string()]
        files = [pa.array([k.as_py()] * len(rows), pa.string()) for k in key]
        return pa.Table.from_arrays([*files, *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return scores.where("channel is not null").groupBy("_source_file", "signal_source").applyInArrow(run, MAPPING)


def gold_with_bus(gold: DataFrame, mapping: DataFrame) -> DataFrame:
    buses = mapping.select("_source_file", "signal_source", "channel", F.col("matched_bus").alias("bus_name"), F.col("score").alias("bus_match_score"), F.col("note").alias("bus_match_note"))
    return gold.join(buses, ["_source_file", "signal_source", "channel"], "left")
